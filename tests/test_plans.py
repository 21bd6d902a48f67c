"""Physical-plan checks: no Python UDFs in feature plans, filters reach the scan,
no whole-table single-partition windows in entity/global sequence operators."""

from __future__ import annotations

from playline.operators import features as FT
from playline.sources import landing as L
from tests.conftest import CFG, fixture_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_matrix_has_no_python_udf(spark, tmp_path):
    se, ti, de = fixture_tables(spark)
    for name, df in (("sessions", se), ("ticks", ti), ("incidents", de)):
        df.write.parquet(str(tmp_path / name))
    se, ti, de = (spark.read.parquet(str(tmp_path / n)) for n in ("sessions", "ticks", "incidents"))
    p = plan(FT.feature_matrix(se, ti, de, CFG))
    assert "Python" not in p and "Pandas" not in p and "Arrow" not in p
    scope_plan = plan(FT.scope(se, CFG))
    assert "PushedFilters: [IsNotNull(game_datetime), IsNotNull(team_position)" in scope_plan
    ex = plan(FT.excursions(se, ti, CFG))
    assert "ReadSchema: struct<match_id:string,timestamp_min:int,cs:int,kills:int,position_x:int,position_y:int>" in ex


def test_session_windows_are_partitioned(spark):
    se, ti, de = fixture_tables(spark)
    for df in (FT.excursions(se, ti, CFG), FT.incident_context(se, ti, de, CFG)):
        p = plan(df)
        for line in p.splitlines():
            if line.strip().startswith("Window ["):
                assert "windowspecdefinition(match_id" in line, line


def test_landing_status_rules(spark):
    keys = spark.createDataFrame([(k,) for k in "abcde"], "match_id string")
    before = spark.createDataFrame([("a", "detail"), ("a", "timeline")], "match_id string, kind string")
    after = spark.createDataFrame([("a", "detail"), ("a", "timeline"), ("b", "detail"), ("b", "timeline"),
                                   ("c", "detail"), ("d", "timeline")], "match_id string, kind string")
    st = {r.match_id: r.status for r in L.landing_status(keys, before, after).collect()}
    assert st == {"a": "skipped", "b": "saved", "c": "timeline missing", "d": "detail missing", "e": "missing"}


def test_first_n_distinct_and_new_keys(spark):
    pages = spark.createDataFrame([("m3", 0), ("m1", 1), ("m3", 2), ("m2", 3), ("m4", 4)], "match_id string, pos int")
    assert [r.match_id for r in L.first_n_distinct(pages, "match_id", "pos", 3).collect()] == ["m3", "m1", "m2"]
    landed = spark.createDataFrame([("m1",)], "match_id string")
    assert sorted(r.match_id for r in L.new_keys(pages.select("match_id").distinct(), landed).collect()) == \
        ["m2", "m3", "m4"]
