"""Session tables dealt alike: no exchange of ticks or incidents, the same results."""

from __future__ import annotations

import re

import pytest

from playline.config import ADAPTER as CFG
from playline.operators import features as FT
from playline.plans import dealt as DL
from playline.sources import adapter, copartitioned as CP
from tests.conftest import fixture_tables

SF = "/root/testdata/sf0.001"


def exchanges(df) -> list[str]:
    """Hash exchanges on the session's key or on the tick, in the plan before runtime changes."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((?:match_id|timestamp_min)[^\n]*", plan)


@pytest.fixture()
def tables(spark, tmp_path):
    """Plain and dealt tables; only the baselines (1.7 kB) pass the size check of a broadcast, as at scale."""
    ev = adapter.load_events(spark, SF)
    adapter.sessions(ev).write.parquet(f"{tmp_path}/p/sessions")
    adapter.ticks(ev).write.parquet(f"{tmp_path}/p/ticks")
    adapter.incidents(ev, spark.read.parquet(f"{tmp_path}/p/ticks")).write.parquet(f"{tmp_path}/p/incidents")
    plain = {t: spark.read.parquet(f"{tmp_path}/p/{t}") for t in CP.TABLES}
    dealt = CP.write_copartitioned(plain, str(tmp_path / "t"), f"cp_{tmp_path.name}", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")
    yield plain, dealt
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows(df):
    def rough(v):
        return round(v, 6) if isinstance(v, float) else v
    return sorted(str([rough(v) for v in r]) for r in df.collect())


def test_session_features_without_exchange(spark, tmp_path, tables):
    plain, dealt = tables
    base = DL.stored_baselines(spark, dealt, f"{tmp_path}/base", CFG)
    se, ti, inc = (dealt[t] for t in CP.TABLES)
    for a, b in ((FT.excursions(plain["sessions"], plain["ticks"], CFG), FT.excursions(se, ti, CFG, baselines=base)),
                 (FT.swing_games(plain["sessions"], plain["ticks"], CFG), FT.swing_games(se, ti, CFG)),
                 (FT.incident_context(*plain.values(), CFG), FT.incident_context(se, ti, inc, CFG, baselines=base))):
        assert exchanges(a) and not exchanges(b)
        assert rows(a) == rows(b)


def test_feature_matrix_moves_one_row_a_session(spark, tmp_path, tables):
    """What is left to exchange is each session's rolling form, which is worked out by player."""
    plain, dealt = tables
    a, b = FT.feature_matrix(*plain.values(), CFG), DL.dealt_feature_matrix(spark, dealt, f"{tmp_path}/base", CFG)
    assert len(exchanges(a)) > 10 and len(exchanges(b)) == 1
    assert rows(a) == rows(b)


def test_attach_and_one_file_per_bucket(spark, tmp_path):
    tables = dict(zip(CP.TABLES, fixture_tables(spark)))
    CP.write_copartitioned(tables, str(tmp_path / "t"), "cp_first", 2)
    for t in CP.TABLES:
        assert len(list((tmp_path / "t" / t).glob("*.parquet"))) <= 2
    got = CP.attach(spark, str(tmp_path / "t"), "cp_second", 2, {t: df.schema for t, df in tables.items()})
    for t, df in tables.items():
        assert sorted(map(str, got[t].select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert not exchanges(got["ticks"].groupBy("match_id").count())
