"""Conversation structure repair by a shortest path with scalar big-integer weights.

The nodes are (row, last role kept: none, s, u or a), the edges Keep, Rerole,
Delete and Insert, and a conversation may end where nothing or an assistant's
turn came last. The weight of the best way from a node to the end is one integer:
its high digits are the cost, below them every audit letter takes a digit of
three bits from the left, and zeros pad the end. So the ordinary minimum of
integers decides cost first and then the ASCII-least audit. Going backwards,
a letter is put in front by moving the low digits one place down.

Numbers have the digits of BLOCK rows. Between blocks the audits of the four
nodes give way to their rank, one digit; every way through a block ends with the
letter of its last row, so no audit is the beginning of another and ranks keep
the order. Time and memory follow the number of rows.

1. The rows after damage go to their conversations without their texts, in
   order; a task holds about 20 bytes for each row of one conversation and yields its
   figures and audit.
2. The texts follow with the audit in front of them and are hashed as they
   pass. A digest of a whole conversation is a sequence, so the rows of one
   conversation pass one task, which never holds them.

Rows of one turn are taken by role, then by the SHA-256 of the text.

Defined cases: nulls in texts, roles and the key of the damage count as one
space; null conv_ids are one conversation; a role that is empty has no initial and cannot be
kept; conversations whose rows all fall to the damage have zeros, an empty audit and the
digest of the empty string; repeated rows are rows; an empty table gives no rows;
extra columns are ignored; conversations and texts of any length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from playline.llm.arrow import small_batches

BLOCK = 64
RENAME, DELETE, INSERT, OPEN_END = 3, 4, 3, 3       # costs; the last is added to truncated rows that stay
D, I, K, R = 1, 2, 3, 4                             # digits of the letters, in ASCII order
LETTERS = " DIKR"
DIGITS = BLOCK + 2 * (BLOCK + 1) + 1                # a row each, two insertions at most at every place, a rank
TOP, WIDTH = 3 * (DIGITS - 1), 3 * DIGITS
LOW = (1 << WIDTH) - 1
NONE, SYSTEM, USER, ASSISTANT = range(4)            # what came last
TURN = (USER, USER, ASSISTANT, USER)                # the turn that may be inserted or given to a row there
NAMES = {USER: "user", ASSISTANT: "assistant"}
BLANK, TWICE, TRUNCATED = 1, 2, 4


def after(state: int, initial: str) -> int | None:
    """What came last once a row with this initial is kept, if it may be."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    return TURN[state] if initial and initial == " sua"[TURN[state]] else None


_AFTER = {c: tuple(after(s, c) for s in range(4)) for c in "sua"}
_NEVER = (None,) * 4


def _front(letter: int, cost: int, value: int) -> int:
    """The weight of an edge with this letter and cost, and of the way after it."""
    return ((value >> WIDTH) + cost << WIDTH) | letter << TOP | (value & LOW) >> 3


def _insert(v: list) -> list:
    """Best ways when turns may be inserted first; a second insertion always follows the other kind."""
    u, a = v[USER], v[ASSISTANT]
    more_u, more_a = (None if x is None else _front(I, INSERT, x) for x in (a, u))
    least = lambda *xs: min(x for x in xs if x is not None)
    u, a = least(u, more_u), least(a, more_a)
    before = _front(I, INSERT, u)
    return [least(v[NONE], before), least(v[SYSTEM], before), u, a]


def audit(initials: str, faults) -> tuple[int, str]:
    """(cost, letters) of the cheapest repair; ``faults``: BLANK, TWICE, TRUNCATED or 0 for each row."""
    n = len(initials)
    v = _insert([0, None, None, 0])
    starts = []                                     # the four values where each block begins, last block first
    for i in range(n - 1, -1, -1):
        cut = [_front(D, DELETE, x) for x in v]
        if faults[i] not in (BLANK, TWICE):
            more = OPEN_END if faults[i] == TRUNCATED else 0
            keep = _AFTER.get(initials[i], _NEVER)
            u, a = _front(R, RENAME + more, v[USER]), _front(R, RENAME + more, v[ASSISTANT])
            kept = {t: _front(K, more, v[t]) for t in {*keep} - {None}}
            cut = [min(x, a if TURN[s] == ASSISTANT else u, *([kept[keep[s]]] if keep[s] is not None else []))
                   for s, x in enumerate(cut)]
        v = _insert(cut)
        if i % BLOCK == 0:
            starts.append([x & LOW for x in v])
            rank = {x: k + 1 for k, x in enumerate(sorted({x & LOW for x in v}))}
            v = [(x >> WIDTH << WIDTH) | rank[x & LOW] << TOP for x in v]
    out, state, i = [], NONE, 0
    for low in (s for s in reversed(starts)):
        way, end = low[state], min(n, i + BLOCK)
        for shift in range(TOP, -1, -3):
            letter = way >> shift & 7
            if not letter or i == end < n:
                break
            state = _step(state, letter, initials[i] if letter == K else "")
            i += letter != I
            out.append(LETTERS[letter])
    return v[NONE] >> WIDTH, "".join(out)


def _step(state: int, letter: int, initial: str) -> int:
    if letter == D:
        return state
    return after(state, initial) if letter == K else TURN[state]


def repaired(letters: str, rows):
    """(role, text) of the rows of a repaired conversation; ``rows`` are taken as the letters need them."""
    state, rows = NONE, iter(rows)
    for x in letters:
        letter = LETTERS.index(x)
        role, text = next(rows) if letter != I else ("", "")
        state = _step(state, letter, role[:1])
        if letter != D:
            yield (role if letter == K else NAMES[state]), text


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, stays) of every row after damage; dropped rows stay in the table with stays false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    return (rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        (kind != 0).alias("stays"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("col"))


def _conversations(batches, names):
    """(conv_id, iterator over its rows as tuples of the named columns) from rows in order."""
    from itertools import groupby

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in names))

    for conv, group in groupby(rows(), key=lambda r: r[0]):
        yield conv, group


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_ORDER = ("turn", "role", "name")


def _examine(group) -> tuple:
    """Figures of one conversation from (conv_id, stays, turn, role, name, blank, cut), in order."""
    initials, faults, seen = bytearray(), bytearray(), set()
    turns, least, most, before, illegal = 0, None, None, None, 0
    for _, stays, turn, role, name, blank, cut in group:
        if not stays:
            continue
        if turn is not None:
            turns += turn != most
            least, most = turn if least is None else least, turn
        c = role[:1]
        illegal += before is not None and before + c not in ("su", "ua", "au")
        before = c
        initials += c.encode() if c in ("s", "u", "a") else b"-"
        faults.append(BLANK if blank else TWICE if name in seen else TRUNCATED if cut else 0)
        seen.add(name)
    cost, letters = audit(initials.decode(), faults)
    gaps = most - least + 1 - turns if turns else 0
    return gaps, faults.count(BLANK), faults.count(TWICE), faults.count(TRUNCATED), illegal, cost, letters


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _batched(rows, schema: pa.Schema, size: int = 1000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def examine(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of damaged rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = _arrow(f"conv_id {kind}, {FIGURES}")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    light = rows.select("conv_id", "stays", "turn", "role", _name().alias("name"), (last == "").alias("blank"),
                        (~last.isin(".", "!", "?")).alias("cut"))

    def run(batches):
        yield from _batched(((conv, *_examine(group)) for conv, group in _conversations(
            batches, ("conv_id", "stays", "turn", "role", "name", "blank", "cut"))), schema)

    return (light.repartition(_tasks(rows), "conv_id").sortWithinPartitions("conv_id", "stays", *_ORDER)
            .mapInArrow(run, f"conv_id {kind}, {FIGURES}"))


def _name():
    """128 bits for a row's role and text (the length of the role keeps them apart)."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)


def repair(rows: DataFrame) -> DataFrame:
    """Figures, audit and digest of the repaired text of every conversation of damaged rows."""
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    text = rows.filter("stays").select("conv_id", F.lit(True).alias("row"), "turn", "role", _name().alias("name"), "text")
    names = FIGURES.replace(" long", "").replace(" string", "").split(", ")
    head = examine(rows).select("conv_id", F.lit(False).alias("row"), *names)
    both = head.unionByName(text, allowMissingColumns=True)
    schema = _arrow(f"conv_id {kind}, {FIGURES}, repaired_sha256 string")

    def digest(group):
        first = next(group)
        sha, joint = hashlib.sha256(), b""
        for role, said in repaired(first[-1], (r[1:3] for r in group)):
            sha.update(joint + f"{role}:{said}".encode())
            joint = b"\n"
        return (first[0], *first[3:], sha.hexdigest())

    def run(batches):
        yield from _batched((digest(group) for _, group in _conversations(batches, ("conv_id", "role", "text", *names))), schema)

    return (both.repartition(_tasks(rows), "conv_id").sortWithinPartitions("conv_id", "row", *_ORDER)
            .mapInArrow(run, f"conv_id {kind}, {FIGURES}, repaired_sha256 string"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _sql_front(letter: str, cost: int, value: str) -> str:
    return f"printf('%08d', left({value}, 8)::BIGINT + {cost}) || '{letter}' || substr({value}, 9)"


def _sql_rows() -> str:
    """The four values before insertions: rows r with initial c, fault f (0 to 3) and values s0 to s3 behind them."""
    out = []
    for s in range(4):
        ways = [_sql_front("D", DELETE, f"s{s}")]
        stay = "if(f = 3, 3, 0)"
        turn = f"s{TURN[s]}"
        ways.append(f"CASE WHEN f IN (0, 3) THEN {_sql_front('R', RENAME, turn).replace(f'+ {RENAME})', f'+ {RENAME} + {stay})')} END")
        for c in "sua":
            t = after(s, c)
            if t is not None:
                ways.append(f"CASE WHEN f IN (0, 3) AND c = '{c}' THEN {_sql_front('K', 0, f's{t}').replace('+ 0)', f'+ {stay})')} END")
        out.append(f"least({', '.join(ways)}) AS b{s}")
    return ", ".join(out)


_UA = f"least(b2, {_sql_front('I', INSERT, 'b3')}) AS s2, least(b3, {_sql_front('I', INSERT, 'b2')}) AS s3"
_S0, _S1 = (f"least(b{s}, {_sql_front('I', INSERT, 's2')}) AS s{s}" for s in (0, 1))
ORACLE = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
m AS MATERIALIZED (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''),
    lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END),
    4294967295::BIGINT) % 20 AS kind FROM (SELECT DISTINCT k FROM o)),
d AS MATERIALIZED (SELECT conv_id, turn, if(kind = 4, 'user', role) AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM o JOIN m USING (k) WHERE kind <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text)) AS r,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM d),
g AS MATERIALIZED (SELECT coalesce(conv_id::VARCHAR, 'none') AS id, r, turn, role, text, left(role, 1) AS c,
  CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 2
    WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) AS p FROM e),
st AS (SELECT id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank,
  count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
  count(*) FILTER (p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY id),
ways AS (SELECT id, n + 1 AS r, '00000000' AS s0, '00000006II' AS s1, '00000003I' AS s2, '00000000' AS s3 FROM st
  UNION ALL SELECT id, r, {_S0}, {_S1}, s2, s3 FROM (SELECT id, r, b0, b1, {_UA} FROM (
    SELECT w.id, g.r, {_sql_rows()} FROM ways w JOIN g ON g.id = w.id AND g.r = w.r - 1))),
best AS MATERIALIZED (SELECT id, left(s0, 8)::BIGINT AS cost, substr(s0, 9) AS audit FROM ways WHERE r = 1),
walk AS (SELECT id, 1 AS p, 1::BIGINT AS r, 0 AS s, ''::VARCHAR AS line, 0 AS lines FROM best
  UNION ALL SELECT id, p + 1, r + (x <> 'I')::INT, t, CASE WHEN x = 'D' THEN NULL WHEN x = 'K' THEN role || ':' || text
    ELSE if(t = 2, 'user:', 'assistant:') || if(x = 'I', '', text) END, lines + (x <> 'D')::INT
  FROM (SELECT w.*, x, role, text, CASE x WHEN 'D' THEN s WHEN 'K' THEN CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
      ELSE if(s = 2, 3, 2) END AS t
    FROM (SELECT walk.*, substr(audit, p, 1) AS x FROM walk JOIN best USING (id) WHERE p <= length(audit)) w
    LEFT JOIN g ON g.id = w.id AND g.r = w.r)),
text AS (SELECT id, string_agg(line, chr(10) ORDER BY p) AS t FROM walk WHERE p > 1 AND line IS NOT NULL GROUP BY id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS id FROM conversations)
LEFT JOIN st USING (id) LEFT JOIN best USING (id) LEFT JOIN text USING (id)"""
