"""Scalar column expressions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Hour buckets (inclusive ranges, everything else is night),
# and their presentation order.
TIME_BUCKETS = (("morning", 6, 11), ("afternoon", 12, 17), ("evening", 18, 22))
NIGHT = "night"
TIME_BUCKET_ORDER = ("morning", "afternoon", "evening", "night")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_literal(df: DataFrame, col: str, text: str) -> Column:
    """A UTC wall-time literal typed like ``df[col]`` (no session-zone dependence
    for TIMESTAMP_NTZ columns; an explicit UTC instant for TIMESTAMP columns)."""
    dt = df.schema[col].dataType.simpleString()
    if dt == "timestamp_ntz":
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text.replace(" ", "T") + "Z").cast("timestamp")


def micros_since(ts, origin: str, ts_type: str = "timestamp_ntz") -> Column:
    """Microseconds from a UTC wall-time ``origin`` to ``ts``.

    For TIMESTAMP_NTZ the difference is taken as a day-time interval and its
    fields are summed, so no session time zone (and no DST shift) is involved;
    for TIMESTAMP it is plain epoch arithmetic."""
    if ts_type == "timestamp_ntz":
        iv = _c(ts) - F.lit(origin).cast("timestamp_ntz")
        part = lambda f: F.extract(F.lit(f), iv)
        return (part("DAY").cast("long") * F.lit(86_400_000_000) + part("HOUR").cast("long") * F.lit(3_600_000_000)
                + part("MINUTE").cast("long") * F.lit(60_000_000) + (part("SECOND") * 1_000_000).cast("long"))
    return F.unix_micros(_c(ts)) - F.unix_micros(F.lit(origin.replace(" ", "T") + "Z").cast("timestamp"))


# F1
def from_epoch_ms(ms) -> Column:
    """Epoch milliseconds -> UTC wall time as TIMESTAMP_NTZ (keeps ms, no session-zone dependence)."""
    return F.timestamp_add("MILLISECOND", _c(ms), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def to_epoch_ms(ts, ts_type: str = "timestamp_ntz") -> Column:
    return F.floor(micros_since(ts, "1970-01-01 00:00:00", ts_type) / F.lit(1000)).cast("long")


# F2
def major_minor(version) -> Column:
    """'16.11.123.4' -> '16.11'; fewer than two parts -> unchanged."""
    parts = F.split(_c(version), r"\.")
    return F.when(F.size(parts) < 2, _c(version)).otherwise(F.array_join(F.slice(parts, 1, 2), "."))


def version_sort_keys(version: str) -> list[Column]:
    """Natural order: major and minor as integers (NULL when not numeric).
    ``split_part`` past the end gives '' and ``try_cast`` keeps ANSI mode from throwing."""
    return [F.expr(f"try_cast(split_part(`{version}`, '.', {i}) as int)") for i in (1, 2)]


# F3
def kda(kills, deaths, assists) -> Column:
    """(k + a) / max(d, 1); NULL deaths stay NULL (greatest() would skip them)."""
    d = _c(deaths)
    return F.when(d.isNotNull(), (_c(kills) + _c(assists)) / F.greatest(d, F.lit(1)))


# F4
def per_minute(count, duration_sec) -> Column:
    d = _c(duration_sec)
    return F.when(d > 0, _c(count) / (d / F.lit(60.0))).otherwise(F.lit(0.0))


# F5
def sum_missing_zero(*cols) -> Column:
    out = None
    for c in cols:
        x = F.coalesce(_c(c), F.lit(0))
        out = x if out is None else out + x
    return out


# F6
def blank_to_null(x) -> Column:
    return F.nullif(_c(x), F.lit(""))


def first_present(*cols) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


# F7
def tick_of(ms, tick_ms: int = 60_000) -> Column:
    return F.floor(_c(ms) / F.lit(tick_ms)).cast("int")


# F8
def time_bucket(hour) -> Column:
    h = _c(hour)
    expr = None
    for name, lo, hi in TIME_BUCKETS:
        expr = (F.when(h.between(lo, hi), F.lit(name)) if expr is None
                else expr.when(h.between(lo, hi), F.lit(name)))
    return expr.otherwise(F.lit(NIGHT))


def time_bucket_ord(bucket) -> Column:
    b = _c(bucket)
    expr = None
    for i, name in enumerate(TIME_BUCKET_ORDER):
        expr = F.when(b == name, F.lit(i)) if expr is None else expr.when(b == name, F.lit(i))
    return expr


# F9 / F10
def local_hour(ts, offset_hours: int = 0) -> Column:
    """Hour of day after a fixed offset (weekday is deliberately left in UTC by callers)."""
    return F.hour(F.timestamp_add("HOUR", F.lit(offset_hours), _c(ts)))


# F11
def off_corridor(x, y, width: int) -> Column:
    return _c(x).isNotNull() & _c(y).isNotNull() & (F.abs(_c(x) - _c(y)) >= F.lit(width))


# F12
def below_band(value, mean, std, mult: float) -> Column:
    return F.coalesce(_c(value) < _c(mean) - F.lit(mult) * F.coalesce(_c(std), F.lit(0.0)), F.lit(False))


# F13
def clamp(x, lo=None, hi=None) -> Column:
    out = _c(x)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return out


# F14 / F22
def round_half_even(x, digits: int) -> Column:
    return F.bround(_c(x), digits)


# F17
def padded_id(prefix: str, n, width: int = 4) -> Column:
    """'GAME_0001'; grows past ``width`` digits instead of truncating."""
    return F.format_string(f"{prefix}%0{width}d", _c(n))


# F18
def split_handle(handle, tag=None) -> Column:
    """'name#tag' -> struct(name, tag, valid): first '#' only, trimmed, explicit tag
    wins, NULL name/tag when empty; a handle without a name or a tag is not valid
    (callers reject it)."""
    parts = F.split(_c(handle), "#", 2)
    name = F.nullif(F.trim(F.get(parts, 0)), F.lit(""))
    tag_in = F.nullif(F.trim(F.get(parts, 1)), F.lit(""))
    explicit = F.nullif(F.trim(_c(tag)), F.lit("")) if tag is not None else F.lit(None).cast("string")
    tag_out = F.coalesce(explicit, tag_in)
    return F.struct(name.alias("name"), tag_out.alias("tag"), (name.isNotNull() & tag_out.isNotNull()).alias("valid"))


# F19
def first_label(pairs, default: str) -> Column:
    """Priority CASE: ``pairs`` is [(condition, label)], first true wins."""
    expr = None
    for cond, label in pairs:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


# F20
def cut(x, edges, labels) -> Column:
    """Left-closed bins [e_i, e_{i+1}); values outside all bins -> NULL."""
    expr = None
    v = _c(x)
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (v >= F.lit(lo)) & (v < F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


# F21 / F23
def pct_of(part, total, digits: int = 1) -> Column:
    return F.round(safe_ratio(_c(part) * F.lit(100.0), total), digits)


def safe_ratio(num, den) -> Column:
    """num / den, 0 when den is 0 (ANSI-safe)."""
    return F.when(_c(den) == 0, F.lit(0.0)).otherwise(_c(num) / _c(den))
