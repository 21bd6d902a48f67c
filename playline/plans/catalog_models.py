"""Publish (D8) and clustering (M1-M7) keys of the query registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from playline.config import ADAPTER as CFG, FEATURE_COLUMNS
from playline.operators import clustering as CL, features as FT
from playline.plans.catalog import FEAT, R, T3, register
from playline.plans.publish import PUBLISHED_SESSION_COLUMNS, publish, publish_counts
from playline.session import shared_path
from playline.sources import adapter

IDM = ("idm AS (SELECT match_id AS original_match_id, printf('GAME_%04d', row_number() OVER "
       "(ORDER BY game_datetime, match_id)) AS surrogate_match_id FROM scoped)")
PUB = FEAT + "," + IDM


def _published(s, sf):
    se, ti, inc = T3(s, sf)
    fm = FT.feature_matrix(se, ti, inc, CFG)
    labels = adapter.fixed_labels(FT.scope(se, CFG))
    tables = {"sessions": se, "ticks": ti, "incidents": inc, "feature_matrix": fm, "cluster_labels": labels}
    return publish(s, tables, shared_path(s, "published"), CFG)


_SESS = ", ".join(c for c in PUBLISHED_SESSION_COLUMNS if c != "match_id")
register("publish_sessions", R(
    f"SELECT i.surrogate_match_id AS match_id, {_SESS} FROM scoped s "
    "JOIN idm i ON i.original_match_id = s.match_id", "kda", "cs_per_min", extra=PUB))(
    lambda s, sf: _published(s, sf).read("sessions"))
register("publish_ticks", R(
    "SELECT t.* REPLACE (i.surrogate_match_id AS match_id) FROM ticks t "
    "JOIN idm i ON i.original_match_id = t.match_id", extra=PUB))(lambda s, sf: _published(s, sf).read("ticks"))
register("publish_incidents", R(
    "SELECT d.* REPLACE (i.surrogate_match_id AS match_id) FROM incidents d "
    "JOIN idm i ON i.original_match_id = d.match_id", extra=PUB))(
    lambda s, sf: _published(s, sf).read("incidents"))
register("publish_features", R(
    "SELECT f.* REPLACE (i.surrogate_match_id AS match_id) FROM fm f "
    "JOIN idm i ON i.original_match_id = f.match_id",
    "tilt_index", "gold_delta", "tilt_spiral_ratio", "avg_cs_sacrifice", "roam_impact_rate", extra=PUB))(
    lambda s, sf: _published(s, sf).read("feature_matrix"))
register("publish_labels", R(
    "SELECT i.surrogate_match_id AS match_id, l.cluster_id FROM labels_fixed l "
    "JOIN idm i ON i.original_match_id = l.match_id", extra=PUB))(
    lambda s, sf: _published(s, sf).read("cluster_labels"))
register("publish_counts", R(
    "SELECT 'sessions' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM scoped UNION ALL "
    "SELECT 'ticks', CAST(count(*) AS BIGINT) FROM scoped_ticks UNION ALL "
    "SELECT 'incidents', CAST(count(*) AS BIGINT) FROM scoped_incidents UNION ALL "
    "SELECT 'feature_matrix', CAST(count(*) AS BIGINT) FROM fm UNION ALL "
    "SELECT 'cluster_labels', CAST(count(*) AS BIGINT) FROM labels_fixed", extra=FEAT))(
    lambda s, sf: publish_counts(_published(s, sf)))

# ---------------------------------------------------------------- M1, M2 ---
_VAL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
    f"count(*) FILTER (WHERE isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE))) AS non_finite FROM fm"
    for c in FEATURE_COLUMNS)
register("feature_validation", R(_VAL, extra=FEAT))(
    lambda s, sf: CL.validation_report(FT.feature_matrix(*T3(s, sf), CFG), CFG.features))

_STATS = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
                   for c in FEATURE_COLUMNS)
_SCALED = ", ".join(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE (CAST({c} AS DOUBLE) - m_{c}) / s_{c} END AS {c}"
                    for c in FEATURE_COLUMNS)
register("standardize", R(f"SELECT match_id, {_SCALED} FROM fm, (SELECT {_STATS} FROM fm) st",
                          *FEATURE_COLUMNS, extra=FEAT))(
    lambda s, sf: CL.standardize(FT.feature_matrix(*T3(s, sf), CFG), CFG.features))


# ------------------------------- M3-M5, M7 with given centroids: plain SQL -------
_N = len(FEATURE_COLUMNS)
FIXED = FEAT + "," + f"""
st AS (SELECT {_STATS} FROM fm),
z AS (SELECT match_id, [{", ".join(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE (CAST({c} AS DOUBLE) - m_{c}) / s_{c} END" for c in FEATURE_COLUMNS)}] AS x
  FROM fm, st),
cen AS (SELECT cluster_id, [{", ".join(f"avg(x[{i + 1}])" for i in range(_N))}] AS c
  FROM labels_fixed JOIN z USING (match_id) GROUP BY cluster_id),
dis AS (SELECT match_id, x, cluster_id, list_sum(list_transform(range(1, {_N + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d
  FROM z, cen),
lab AS (SELECT match_id, x, cluster_id, d FROM dis QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY d, cluster_id) = 1),
pairs AS (SELECT a.match_id, a.cluster_id AS own, b.cluster_id AS other, count(*) AS n, sum(list_sum(list_transform(
  range(1, {_N + 1}), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))) AS t FROM lab a, lab b GROUP BY ALL),
sil AS (SELECT match_id, max(n) FILTER (own = other) AS n, max(t / greatest(n - 1, 1)) FILTER (own = other) AS a,
  min(t / n) FILTER (own <> other) AS b FROM pairs GROUP BY match_id)"""


def _fixed(s, sf):
    """Standardised features and the centroids of the fixed labels, which stand in for a fitted model."""
    se, ti, inc = T3(s, sf)
    z = CL.standardize(FT.feature_matrix(se, ti, inc, CFG), CFG.features).checkpoint(eager=True)
    return z, CL.group_centroids(z, adapter.fixed_labels(FT.scope(se, CFG)), CFG.features)


def _assigned(s, sf):
    z, cen = _fixed(s, sf)
    return z, CL.nearest_centroid(z, cen, CFG.features)


register("assign_clusters", R("SELECT match_id, cluster_id, d AS distance FROM lab", "distance", extra=FIXED))(
    lambda s, sf: _assigned(s, sf)[1])
register("fixed_centroids", R(
    f"SELECT cluster_id, unnest([{', '.join(repr(c) for c in FEATURE_COLUMNS)}]) AS feature, unnest(c) AS value FROM cen",
    "value", extra=FIXED))(lambda s, sf: CL.long_centroids(_fixed(s, sf)[1], CFG.features))


@register("assigned_silhouette", R(
    "SELECT avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM sil",
    "silhouette", extra=FIXED))
def _assigned_silhouette(s, sf):
    z, lab = _assigned(s, sf)
    return CL.silhouette_squared(z, lab.select("match_id", "cluster_id"), CFG.features)


@register("assigned_profile", R(
    "SELECT l.cluster_id, CAST(count(*) AS INTEGER) AS size, " + ", ".join(f"avg(CAST(f.{c} AS DOUBLE)) AS {c}" for c in FEATURE_COLUMNS)
    + " FROM lab l JOIN fm f USING (match_id) GROUP BY l.cluster_id", *FEATURE_COLUMNS, extra=FIXED))
def _assigned_profile(s, sf):
    from playline.operators.reports import cluster_summary
    return cluster_summary(FT.feature_matrix(*T3(s, sf), CFG), _assigned(s, sf)[1].select("match_id", "cluster_id"))


# ------------------------------------ M3-M7 of a fitted model: the same starts and passes in SQL
_K, _RESTARTS, _SEED, _TOL = CFG.k, CFG.restarts, CFG.seed, 1e-4


def _sq(p: str, c: str) -> str:
    return " + ".join(f"({p}[{i + 1}] - {c}[{i + 1}]) * ({p}[{i + 1}] - {c}[{i + 1}])" for i in range(_N))


def _drawn(step: int) -> str:
    """Centroids of every restart after one more draw."""
    u = f"(('0x' || substr(md5('{_SEED}:' || r || ':{step}:' || match_id), 1, 8))::BIGINT + 0.5) / 4294967296.0"
    if step == 0:
        src = f"SELECT match_id, x, r, [] AS cs, 1.0 AS d FROM z, range({_RESTARTS}) t(r)"
    else:
        src = (f"SELECT match_id, x, r, cs, least({', '.join(_sq('x', f'cs[{j + 1}]') for j in range(step))}) AS d "
               f"FROM z, d{step - 1}")
    key = f"CASE WHEN d > 0 THEN -ln({u}) / d ELSE {u} END"
    return (f"d{step} AS MATERIALIZED (SELECT r, list_append(cs, x) AS cs FROM ({src}) "
            f"QUALIFY row_number() OVER (PARTITION BY r ORDER BY d <= 0, {key}, match_id) = 1)")


_NEAR = ", ".join("{" + f"'d': {_sq('x', f'cs[{j + 1}]')}, 'c': {j + 1}" + "}" for j in range(_K))
_MEANS = ", ".join(f"avg(x[{i + 1}])" for i in range(_N))
FITTED = FIXED + "," + ",\n".join(_drawn(k) for k in range(_K)) + f""",
moves AS (SELECT 0 AS it, r, cs, 1e300::DOUBLE AS moved FROM d{_K - 1}
  UNION ALL SELECT it + 1, r, new, list_max(list_transform(range(1, {_K + 1}), lambda j: list_sum(list_transform(range(1, {_N + 1}),
      lambda i: (new[j][i] - cs[j][i]) * (new[j][i] - cs[j][i])))))
  FROM (SELECT it, r, any_value(cs) AS cs, list_transform(range(1, {_K + 1}), lambda j: coalesce(
      list_filter(list({{'c': c, 'm': m}}), lambda y: y.c = j)[1].m, any_value(cs)[j])) AS new
    FROM (SELECT it, r, c, any_value(cs) AS cs, [{_MEANS}] AS m
      FROM (SELECT it, r, cs, x, list_min([{_NEAR}]).c AS c FROM moves, z WHERE moved > {_TOL * _TOL} AND it < 300)
      GROUP BY it, r, c) GROUP BY it, r)),
ends AS (SELECT r, max_by(cs, it) AS cs FROM moves GROUP BY r),
fit AS (SELECT list_sort(cs) AS cs FROM (SELECT r, any_value(cs) AS cs, round(sum(list_min([{_NEAR}]).d), 9) AS cost
  FROM ends, z GROUP BY r) ORDER BY cost, r LIMIT 1),
fcen AS (SELECT unnest(range({_K}))::INTEGER AS cluster_id, unnest(cs) AS c FROM fit),
flab AS (SELECT match_id, x, (list_min([{_NEAR}]).c - 1)::INTEGER AS cluster_id FROM z, fit),
fpairs AS (SELECT a.match_id, a.cluster_id AS own, b.cluster_id AS other, count(*) AS n, sum({_sq('a.x', 'b.x')}) AS t
  FROM flab a, flab b GROUP BY ALL),
fsil AS (SELECT match_id, max(n) FILTER (own = other) AS n, max(t / greatest(n - 1, 1)) FILTER (own = other) AS a,
  min(t / n) FILTER (own <> other) AS b FROM fpairs GROUP BY match_id)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _model(s, sf):
    fm = FT.feature_matrix(*T3(s, sf), CFG)
    fm = fm.checkpoint(eager=True)   # one materialised input for all passes
    return fm, CL.fit_clusters(fm, CFG)


@register("cluster_sessions", _recursive(R("SELECT match_id, cluster_id FROM flab", extra=FITTED)))
def _clusters(s, sf):
    fm, model = _model(s, sf)
    return model.labels(fm)


@register("scaled_centroids", _recursive(R(
    f"SELECT cluster_id, unnest([{', '.join(repr(c) for c in FEATURE_COLUMNS)}]) AS feature, unnest(c) AS value FROM fcen",
    "value", extra=FITTED)))
def _centroids(s, sf):
    _, model = _model(s, sf)
    return CL.scaled_centroids(s, model)


@register("silhouette_sq", _recursive(R(
    "SELECT avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM fsil",
    "silhouette", extra=FITTED)))
def _silhouette(s, sf):
    fm, model = _model(s, sf)
    return s.range(1).select(F.lit(CL.silhouette(model, fm)).alias("silhouette"))


@register("cluster_profile", _recursive(R(
    "SELECT l.cluster_id, CAST(count(*) AS INTEGER) AS size, " + ", ".join(f"avg(CAST(f.{c} AS DOUBLE)) AS {c}" for c in FEATURE_COLUMNS)
    + " FROM flab l JOIN fm f USING (match_id) GROUP BY l.cluster_id", *FEATURE_COLUMNS, extra=FITTED)))
def _profile(s, sf):
    from playline.operators.reports import cluster_summary
    fm, model = _model(s, sf)
    return cluster_summary(fm, model.labels(fm))
