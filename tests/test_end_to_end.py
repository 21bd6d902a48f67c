"""End to end over one store: ingest -> features -> train -> publish."""

from __future__ import annotations

import datetime as dt

from playline.cli import build_features, feature_summary, publish_store, train
from playline.config import AnalysisConfig
from playline.plans.tables import TableStore
from tests.conftest import fixture_tables


def test_stages_chain_through_the_store(spark, tmp_path):
    se, ti, de = fixture_tables(spark)
    store = TableStore(spark, str(tmp_path / "store"))
    rows = [r.asDict() for r in se.collect()]
    base = dt.datetime(2026, 4, 1)     # six more scoped sessions so clustering has > k rows
    more = [dict(r, match_id=f"X{i}", game_datetime=base + dt.timedelta(days=i), win=i % 2 == 0) for i, r in
            enumerate([rows[1]] * 6)]
    se2 = se.unionByName(spark.createDataFrame(more, se.schema))
    ti2 = ti.unionByName(ti.where("match_id = 'n1'").selectExpr(
        "explode(array('X0','X1','X2','X3','X4','X5')) AS match_id", "timestamp_min", "gold", "cs", "xp", "kills",
        "position_x", "position_y"))
    store.commit({"sessions": se2, "ticks": ti2, "incidents": de})
    fm = build_features(store)
    s = feature_summary(fm).first()
    assert s.rows == 11
    cfg = AnalysisConfig(restarts=2)
    model, labels = train(spark, store, str(tmp_path / "models"), cfg)
    assert labels.count() == 11 and store.read("cluster_labels").count() == 11
    pub = publish_store(spark, store, str(tmp_path / "pub"), cfg)
    assert pub.read("feature_matrix").count() == 11
    assert {r.match_id[:5] for r in pub.read("cluster_labels").collect()} == {"GAME_"}
