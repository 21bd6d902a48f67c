"""Clustering and cluster reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from playline.config import FEATURE_COLUMNS, AnalysisConfig
from playline.operators import clustering as CL, reports as RP

CFG = AnalysisConfig(restarts=4)


CENTRES = (-6.0, 0.0, 5.0, 17.0)
MEMBERS = "abcde"


def feature_frame(spark):
    """Four tight clouds of five members around CENTRES; odd features run downwards."""
    rows = []
    for g, c in enumerate(CENTRES):
        for s, name in enumerate(MEMBERS):
            jitter = (s - 2) * 0.07
            rows.append((f"{name}{g}", *[(c + jitter) * (1 if i % 2 == 0 else -1) for i in range(len(FEATURE_COLUMNS))]))
    return spark.createDataFrame(rows, ["match_id", *FEATURE_COLUMNS])


def test_fit_labels_profile_and_persistence(spark, tmp_path):
    fm = feature_frame(spark)
    from playline.plans.tables import TableStore
    store = TableStore(spark, str(tmp_path / "store"))
    model, labels = CL.train_and_save(spark, fm, str(tmp_path / "model"), CFG, store=store)
    assert store.tables() == ["cluster_labels"] and store.version() == 1
    lab = {r.match_id: r.cluster_id for r in labels.collect()}
    # canonical ids follow the centres of the first feature
    assert lab == {f"{m}{g}": g for g in range(len(CENTRES)) for m in MEMBERS}
    prof = {r.cluster_id: r for r in RP.cluster_summary(fm, labels).collect()}
    assert prof[2].size == 5 and prof[2].gold_delta == pytest.approx(5.0)
    loaded = CL.ClusteringModel.load(spark, str(tmp_path / "model"))
    again = {r.match_id: r.cluster_id for r in loaded.labels(fm).collect()}
    assert again == lab
    assert 0.0 <= CL.silhouette(model, fm) <= 1.0
    cents = CL.scaled_centroids(spark, model).collect()
    assert len(cents) == 4 * len(FEATURE_COLUMNS)


def test_population_scaling(spark):
    fm = feature_frame(spark)
    z = CL.standardize(fm, FEATURE_COLUMNS).agg(F.avg("gold_delta"), F.stddev_pop("gold_delta")).first()
    assert z[0] == pytest.approx(0.0, abs=1e-12) and z[1] == pytest.approx(1.0)
    const = fm.withColumn("tilt_index", F.lit(0.5))
    assert {r.tilt_index for r in CL.standardize(const, FEATURE_COLUMNS).collect()} == {0.0}


def test_rejects_nulls_and_small_input(spark):
    fm = feature_frame(spark)
    bad = fm.withColumn("gold_delta", F.when(F.col("match_id") == "c1", None).otherwise(F.col("gold_delta")))
    with pytest.raises(CL.FeatureValidationError, match="without a value"):
        CL.validate(bad, CFG)
    with pytest.raises(CL.FeatureValidationError, match="at least 5 rows"):
        CL.validate(fm.limit(4), CFG)
    with pytest.raises(CL.FeatureValidationError, match="lacks"):
        CL.validate(fm.drop("tilt_index"), CFG)


def test_pace_curves_drop_thin_ticks(spark):
    """Clusters of 5 need round(2.5) = 3 members at a tick; tick 7 has two, tick 8 three."""
    labels = spark.createDataFrame([(f"{m}{g}", g) for g in range(4) for m in MEMBERS], "match_id string, cluster_id int")
    ticks = [(f"{m}{g}", t, 1000 * g + 10 * t) for g in range(4) for m in MEMBERS for t in range(7)]
    ticks += [(f"{m}{g}", 7, 1) for g in range(4) for m in "ab"] + [(f"{m}{g}", 8, 2) for g in range(3) for m in "abc"]
    curves = RP.pace_curves(spark.createDataFrame(ticks, "match_id string, timestamp_min int, gold long"), labels)
    got = {(r.cluster_id, r.timestamp_min): r.avg_gold for r in curves.collect()}
    assert sorted(got) == [(g, t) for g in range(4) for t in [*range(7), *([8] if g < 3 else [])]]
    assert got[(2, 3)] == 2030.0
    assert RP.missing_members(curves, labels).count() == 0
    assert RP.missing_members(curves.where("cluster_id <> 3"), labels).first().cluster_id == 3


def cloud(spark, n=400):
    import random
    rng = random.Random(8)
    rows = [(f"s{k}", *[rng.gauss((k % 5) * (1 if i % 2 else -1), 1.3) for i in range(len(FEATURE_COLUMNS))]) for k in range(n)]
    return spark.createDataFrame(rows, ["match_id", *FEATURE_COLUMNS])


def test_all_restarts_match_plain_k_means(spark):
    """Starts, passes and costs against numpy, restart by restart."""
    import hashlib

    import numpy as np
    fm = cloud(spark)
    rows = [(r["match_id"], r["p"]) for r in CL.standardize(fm, FEATURE_COLUMNS).select("match_id", F.array(*FEATURE_COLUMNS).alias("p")).collect()]
    ids, x = [i for i, _ in rows], np.array([p for _, p in rows])
    points = spark.createDataFrame(rows, "match_id string, p array<double>")
    starts = CL.starting_points(points, 4, 5, 42)
    ends = CL.lloyd(points, starts)
    costs = CL.restart_costs(points, ends)
    for r in range(5):
        chosen = []
        for step in range(4):
            u = np.array([(int(hashlib.md5(f"42:{r}:{step}:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2 ** 32 for i in ids])
            d = np.min([((x - c) ** 2).sum(1) for c in chosen], axis=0) if chosen else np.ones(len(x))
            chosen.append(x[np.argmin(np.where(d > 0, -np.log(u) / np.where(d > 0, d, 1), np.inf))])
        assert np.allclose(starts[r], chosen)
        c = np.array(chosen)
        for _ in range(300):
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(4)])
            done, c = ((new - c) ** 2).sum(1).max() <= 1e-8, new
            if done:
                break
        assert np.allclose(ends[r], c) and costs[r] == pytest.approx(((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())


def test_cost_is_no_higher_than_of_separate_fits(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    fm = cloud(spark)
    model = CL.fit_clusters(fm, AnalysisConfig(restarts=20))
    vec = VectorAssembler(inputCols=list(FEATURE_COLUMNS), outputCol="features").transform(CL.standardize(fm, FEATURE_COLUMNS)).cache()
    other = min(KMeans(k=4, seed=42 + i, maxIter=300, tol=1e-4).fit(vec).summary.trainingCost for i in range(4))
    assert model.cost <= other * (1 + 1e-3)
    assert model.centers() == sorted(model.centers())


def test_one_pass_serves_all_restarts(spark):
    points = spark.createDataFrame([("a", [0.0]), ("b", [1.0])], "match_id string, p array<double>")
    rows = CL._per_restart(points, {r: [[0.0], [1.0]] for r in range(20)})
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 40 and plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1
    # fewer distinct rows than clusters: a start is repeated, an empty cluster stays
    same = spark.createDataFrame([(f"k{i}", [float(i % 2)]) for i in range(6)], "match_id string, p array<double>")
    ends = CL.lloyd(same, CL.starting_points(same, 3, 2, 1))
    assert all({c[0] for c in cs} == {0.0, 1.0} and len(cs) == 3 for cs in ends.values())
