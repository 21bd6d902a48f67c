"""Feature matrix by the delta rule against the matrix computed anew (K8)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from playline.operators import features as FT
from playline.plans import increment as I
from playline.plans.tables import BUCKET, TableStore
from tests.conftest import CFG, fixture_tables, session_row
from tests.test_plans import plan

EXTRA = [session_row(f"x{i}", dt.datetime(2026, 2, 1) + dt.timedelta(hours=11 * ((i * 7) % 24)), i % 3 == 0, cs=100 + i) for i in range(24)]


def tables(spark):
    """The fixture with 24 more sessions of the same player, starts out of id order; some have no positions."""
    ticks = [[f"x{i}", t, 300 * t + 40 * i, (5 + i % 4) * t - (30 if t in (7, 8, 9) and i % 5 == 0 else 0), 1, t // 5,
              None if i % 2 else 6000 + 20 * t + (4000 if 6 <= t <= 8 else 0), None if i % 2 else 6000 + 20 * t]
             for i in range(24) for t in range(19)]
    se, ti, de = fixture_tables(spark, extra_sessions=EXTRA, extra_ticks=ticks)
    more = [(f"x{i}", n + 1, t * 60_000, t, 300 * t + 40 * i, 0) for i in range(0, 24, 2) for n, t in enumerate((3, 5, 5, 12, 16))]
    return {"sessions": se, "ticks": ti, "incidents": de.unionByName(spark.createDataFrame(more, de.schema))}


def part(t, where, max_tick=99):
    return {"sessions": t["sessions"].where(where),
            **{n: t[n].where(where).where(F.col("timestamp_min") <= max_tick) for n in ("ticks", "incidents")}}


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def full(store, cfg=CFG):
    return FT.feature_matrix(*(store.read(n) for n in I.SOURCES), cfg)


def check(store, cfg=CFG):
    got, want = I.refresh_features(store, cfg), full(store, cfg)
    assert got.columns == want.columns and rows(got) == rows(want)
    return got


def test_three_landings_equal_the_whole_matrix(spark, tmp_path):
    t, store = tables(spark), TableStore(spark, str(tmp_path / "s"), buckets=4)
    first = "match_id IN ('old','n1','n4') OR (match_id LIKE 'x%' AND substr(match_id, 2) % 3 = 0)"
    assert check(store).count() == 0                                        # nothing landed yet
    store.commit(part(t, first, 9))
    # the rest, some of it between sessions already there; then the minutes missing so far
    I.advance_state(store, CFG)
    store.commit(part(t, f"NOT ({first}) AND match_id <> 'n5'"))
    check(store)
    late = {n: t[n].where(first).where("timestamp_min > 9") for n in ("ticks", "incidents")}
    store.commit(late | {"sessions": t["sessions"].where("match_id = 'n5'")})
    store.commit({n: t[n].where("match_id = 'n5'") for n in ("ticks", "incidents")})
    # files of a step that never reached the commit table
    t["ticks"].write.parquet(f"{store.root}/data/{I.BASELINE}/commit=c-features-{store.version()}")
    got = check(store)
    assert got.count() == 29 and rows(got) == rows(FT.feature_matrix(*(t[n] for n in I.SOURCES), CFG))
    version = store.version()
    assert rows(I.refresh_features(store, CFG)) == rows(got) and store.version() == version     # no news, no commit
    form = I.latest(store.read(I.FORM), "entity", "match_id")
    assert sorted(r[0] for r in form.select("game_number").collect()) == list(range(1, 30))


def test_a_step_reads_its_buckets_and_the_matrix_only_state(spark, tmp_path):
    t, store = tables(spark), TableStore(spark, str(tmp_path / "s"), buckets=4)
    store.commit(part(t, "match_id <> 'x5'"))
    done = I.advance_state(store, CFG)
    store.commit(part(t, "match_id = 'x5'"))
    step = I.step_frames(store, done, CFG)
    bucket = spark.createDataFrame([("x5",)], "match_id string").select(store.bucket("match_id")).first()[0]
    for name in (I.STATE, I.BASELINE):
        scans = [line for line in plan(step[name]).splitlines() if "FileScan" in line]
        assert scans and all(f"({BUCKET}" in s and f"= {bucket})" in s for s in scans)
    assert [r[0] for r in step[I.STATE].select("match_id").collect()] == ["x5"]
    # only the sessions behind the new one, and it, get a new form row
    when = {s[0]: s[2] for s in EXTRA}
    behind = {r[0] for r in step[I.FORM].select("match_id").collect()}
    later = {r[0] for r in FT.scope(t["sessions"], CFG).where(F.col("game_datetime") > F.lit(when["x5"])).select("match_id").collect()}
    assert later | {"x5"} == behind
    I.advance_state(store, CFG)
    matrix = I.matrix_from_state(*(store.read(n) for n in (I.STATE, I.FORM, I.BASELINE)), CFG)
    assert {f.split("/data/")[1].split("/")[0] for f in matrix.inputFiles()} == {I.STATE, I.FORM, I.BASELINE}
    assert "Python" not in plan(matrix)


def test_replaced_tables_and_other_parameters_start_anew(spark, tmp_path):
    t, store = tables(spark), TableStore(spark, str(tmp_path / "s"), buckets=4)
    store.commit(part(t, "match_id LIKE 'n%'"))
    I.advance_state(store, CFG)
    check(store, CFG.with_(swing_threshold=120, rolling_window=2, laning_end=11))
    store.commit(part(t, "match_id LIKE 'x%'"), mode="replace")
    check(store)
    assert I.refresh_features(store, CFG).where("match_id LIKE 'n%'").count() == 0


def test_ticks_before_their_session(spark, tmp_path):
    t, store = tables(spark), TableStore(spark, str(tmp_path / "s"), buckets=4)
    store.commit(part(t, "match_id LIKE 'n%'") | {"ticks": t["ticks"]})
    I.advance_state(store, CFG)
    store.commit({n: t[n].where("match_id LIKE 'x%'") for n in ("sessions", "incidents")})
    check(store)
