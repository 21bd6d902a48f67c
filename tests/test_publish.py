"""Pseudonymised publishing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from playline.operators import features as FT
from playline.plans.publish import EmptyScopeError, publish, publish_counts
from playline.schemas import SchemaContractError
from tests.conftest import CFG, fixture_tables


def tables(spark):
    se, ti, de = fixture_tables(spark)
    fm = FT.feature_matrix(se, ti, de, CFG)
    labels = FT.scope(se, CFG).select("match_id", F.lit(1).alias("cluster_id"))
    return {"sessions": se, "ticks": ti, "incidents": de, "feature_matrix": fm, "cluster_labels": labels}


def test_publish_rekeys_every_table(spark, tmp_path):
    store = publish(spark, tables(spark), str(tmp_path / "pub"), CFG)
    sess = store.read("sessions").orderBy("game_datetime").collect()
    assert [r.match_id for r in sess] == [f"GAME_000{k}" for k in range(1, 6)]
    assert "puuid" not in store.read("sessions").columns
    originals = {"old", "n1", "n2", "n3", "n4", "n5"}
    for t in ("sessions", "ticks", "incidents", "feature_matrix", "cluster_labels"):
        ids = {r.match_id for r in store.read(t).select("match_id").distinct().collect()}
        assert not ids & originals
    counts = {r.table_name: r.row_count for r in publish_counts(store).collect()}
    assert counts == {"sessions": 5, "ticks": 95, "incidents": 13, "feature_matrix": 5, "cluster_labels": 5}


def test_publish_rejects_contract_break_and_leaves_nothing(spark, tmp_path):
    t = tables(spark)
    t["feature_matrix"] = t["feature_matrix"].withColumn("unexpected_column", F.lit(1))
    with pytest.raises(SchemaContractError, match="unexpected_column"):
        publish(spark, t, str(tmp_path / "pub"), CFG)
    assert not (tmp_path / "pub").exists()


def test_publish_empty_scope(spark, tmp_path):
    t = tables(spark)
    t["sessions"] = t["sessions"].where("team_position = 'NONE'")
    with pytest.raises(EmptyScopeError):
        publish(spark, t, str(tmp_path / "pub"), CFG)


def test_coarsened_time(spark, tmp_path):
    store = publish(spark, tables(spark), str(tmp_path / "pub"), CFG, coarsen_time="day")
    assert all(r.game_datetime.hour == 0 for r in store.read("sessions").collect())
