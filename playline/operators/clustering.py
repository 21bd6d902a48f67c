"""Session clustering on the feature matrix (M1-M7).

* ``validate``     - one aggregate pass: NULL and non-finite counts per feature,
                     row count vs k (M1);
* ``standardize``  - population mean/std per feature (the analysed
                     application's scaler), constant column -> 0 (M2);
* ``fit_clusters`` - K-Means with all restarts in one job: every pass over the
                     rows serves every restart that has not settled, and its
                     aggregate is one row per restart and cluster. Starting
                     points are drawn in proportion to the squared distance by
                     a hash of restart, step and session, so a fit can be
                     repeated anywhere; the lowest cost wins (M3); cluster ids
                     canonicalised by sorting centroids (M5);
* ``silhouette``   - mean silhouette with squared Euclidean distances (M4);
* ``ClusteringModel`` save / load (M6), ``scaled_centroids`` (M7).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playline.config import DEFAULT, AnalysisConfig


class FeatureValidationError(ValueError):
    pass


# ---------------------------------------------------------------- M1 -------
def validation_report(fm: DataFrame, features) -> DataFrame:
    """Per feature: NULL count and non-finite (NaN/inf) count; plus row count."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in features:
        x = F.col(c).cast("double")
        aggs += [F.sum(x.isNull().cast("long")).alias(f"{c}|null"),
                 F.sum((F.isnan(x) | (F.abs(x) == float("inf"))).cast("long")).alias(f"{c}|nonfinite")]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("rows").alias("rows"),
                              F.coalesce(F.col(f"`{c}|null`"), F.lit(0)).alias("nulls"),
                              F.coalesce(F.col(f"`{c}|nonfinite`"), F.lit(0)).alias("non_finite"))
                     for c in features])
    return fm.agg(*aggs).select(F.inline(rows))


def check_report(rep, cfg: AnalysisConfig) -> None:
    """Raise unless the per-feature counts allow a fit."""
    n = rep[0]["rows"] if rep else 0
    if n <= cfg.k:
        raise FeatureValidationError(f"{cfg.k} clusters need at least {cfg.k + 1} rows, got {n}")
    nulls = [r["feature"] for r in rep if r["nulls"]]
    if nulls:
        raise FeatureValidationError(f"rows without a value in {', '.join(nulls)}")
    if any(r["non_finite"] for r in rep):
        raise FeatureValidationError("a feature is NaN or infinite")


def check_columns(fm: DataFrame, cfg: AnalysisConfig) -> None:
    missing = [c for c in cfg.features if c not in fm.columns]
    if missing:
        raise FeatureValidationError(f"the feature table lacks {', '.join(missing)}")


def validate(fm: DataFrame, cfg: AnalysisConfig = DEFAULT) -> None:
    check_columns(fm, cfg)
    check_report(validation_report(fm, cfg.features).collect(), cfg)   # one row per feature (metadata-sized)


# ---------------------------------------------------------------- M2 -------
def scaler_stats(fm: DataFrame, features) -> DataFrame:
    """One row: population mean and std of every feature."""
    return fm.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in features],
                  *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in features])


def standardize(fm: DataFrame, features, stats: DataFrame | None = None, keep=("match_id",)) -> DataFrame:
    """(x - mean) / std with population std; a constant column scales to 0."""
    st = stats if stats is not None else scaler_stats(fm, features)
    row = st.select(F.struct(*st.columns)).scalar()        # one scalar subquery, reused by every column
    out = [F.col(k) for k in keep]
    for c in features:
        sd = row[f"s_{c}"]
        out.append(F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c).cast("double") - row[f"m_{c}"]) / sd).alias(c))
    return fm.select(*out)


# ---------------------------------------------------------------- M3/M5 ----
@dataclass
class ClusteringModel:
    features: tuple
    stats: DataFrame          # one row of means / stds
    centroids: list           # canonical order: centroid of cluster 0, 1, ... in scaled features
    cost: float

    def labels(self, fm: DataFrame) -> DataFrame:
        scaled = standardize(fm, self.features, self.stats)
        return nearest_centroid(scaled, self.table(fm.sparkSession), self.features).select("match_id", "cluster_id")

    def table(self, spark: SparkSession) -> DataFrame:
        """(cluster_id, x): one row per cluster."""
        return spark.createDataFrame(list(enumerate(self.centroids)), "cluster_id int, x array<double>")

    def centers(self) -> list:
        return self.centroids

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        self.stats.write.mode("overwrite").parquet(f"{path}/scaler")
        meta = {"features": list(self.features), "cost": self.cost}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ClusteringModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cluster_id").collect()      # one row per cluster
        return ClusteringModel(tuple(meta["features"]), spark.read.parquet(f"{path}/scaler"),
                               [list(r["x"]) for r in rows], float(meta["cost"]))


def _per_restart(points: DataFrame, centers: dict[int, list]) -> DataFrame:
    """Rows (match_id, p) once for each restart, with the index ``c`` of the nearest of
    its centroids and the squared distance ``d``; ties to the lower index.
    ``centers``: restart -> centroids, a few numbers that travel as a literal."""
    every = F.from_json(F.lit(json.dumps([{"r": r, "cs": cs} for r, cs in sorted(centers.items())])),
                        "array<struct<r:int,cs:array<array<double>>>>")
    # a small lambda, not k times n terms: generated code of that length is no longer compiled by the JVM
    least = F.expr("array_min(transform(x.cs, (q, j) -> named_struct('d', "
                   "aggregate(zip_with(p, q, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v), 'c', j)))")
    return points.select("match_id", "p", F.explode(every).alias("x")).select("match_id", "p", "x.r", least.alias("m")).select(
        "match_id", "p", "r", "m.d", "m.c")


def _cluster_sums(points: DataFrame, centers: dict[int, list]) -> list:
    """One row per restart and cluster: (r, c, n, s: sum of its points), each point with its nearest
    centroid, ties to the lower index. Tasks add up their rows in numpy; what is shuffled is a
    row per task, restart and cluster."""
    held = {r: np.array(cs, dtype=float) for r, cs in sorted(centers.items())}

    def run(batches):
        n = {r: np.zeros(len(c), dtype=np.int64) for r, c in held.items()}
        total = {r: np.zeros(c.shape) for r, c in held.items()}
        for batch in batches:
            p = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for r, cs in held.items():
                near = np.argmin(np.stack([((p - c) ** 2).sum(axis=1) for c in cs]), axis=0) if batch.num_rows else np.empty(0, dtype=np.int64)
                n[r] += np.bincount(near, minlength=len(cs))
                for i in range(p.shape[1] if batch.num_rows else 0):
                    total[r][:, i] += np.bincount(near, p[:, i], len(cs))
        rows = [(r, c, int(n[r][c]), total[r][c].tolist()) for r in held for c in np.flatnonzero(n[r]).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*rows) if rows else [()] * 4, (
            pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())))], names=["r", "c", "n", "s"])

    width = len(next(iter(centers.values()))[0])
    return (points.select("p").mapInArrow(run, "r int, c int, n long, s array<double>").groupBy("r", "c")
            .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s")).collect())


def hash_uniform(seed: int, restart, step: int, key: str = "match_id") -> Column:
    """A number in (0, 1) that every engine with MD5 gives alike."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(restart).cast("string"), F.lit(str(step)), F.col(key))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 32)


def starting_points(points: DataFrame, k: int, restarts: int, seed: int) -> dict[int, list]:
    """k starting centroids for each restart, one pass for each of the k.

    The first is any row, the next are drawn with a chance proportional to the squared
    distance to those drawn so far: the row with the least -ln(u) / distance.
    Rows at distance 0 come last, by u."""
    chosen: dict[int, list] = {}
    for step in range(k):
        if step:
            rows = _per_restart(points, chosen)
        else:
            rows = points.select("match_id", "p", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("r"), F.lit(1.0).alias("d"))
        u = hash_uniform(seed, F.col("r"), step)
        rank = F.struct((F.col("d") <= 0).alias("again"), F.when(F.col("d") > 0, -F.log(u) / F.col("d")).otherwise(u).alias("key"), "match_id")
        for x in rows.groupBy("r").agg(F.min_by("p", rank).alias("p")).collect():          # one row per restart
            chosen.setdefault(x["r"], []).append(list(x["p"]))
    return chosen


def lloyd(points: DataFrame, centers: dict[int, list], max_iter: int = 300, tol: float = 1e-4) -> dict[int, list]:
    """Centroids of every restart once none of its centroids moves further than
    ``tol``. A pass aggregates to one row per restart and cluster; restarts that have settled
    take part in no further pass; an empty cluster stays where it is."""
    settled: dict[int, list] = {}
    live = dict(centers)
    for _ in range(max_iter):
        if not live:
            break
        now = {r: [list(c) for c in cs] for r, cs in live.items()}
        for x in _cluster_sums(points, live):
            now[x["r"]][x["c"]] = [v / x["n"] for v in x["s"]]
        for r, cs in now.items():
            moved = max(sum((a - b) ** 2 for a, b in zip(new, old)) for new, old in zip(cs, live[r]))
            if moved <= tol * tol:
                settled[r] = cs
        live = {r: cs for r, cs in now.items() if r not in settled}
    return settled | live


def restart_costs(points: DataFrame, centers: dict[int, list]) -> dict[int, float]:
    return {x["r"]: x["cost"] for x in _per_restart(points, centers).groupBy("r").agg(F.sum("d").alias("cost")).collect()}


def fit_clusters(fm: DataFrame, cfg: AnalysisConfig = DEFAULT, restarts: int | None = None,
                 max_iter: int = 300, tol: float = 1e-4, partitions: int | None = None) -> ClusteringModel:
    """K-Means with ``restarts`` starts, lowest cost wins (ties to the earlier start).

    One pass over the persisted features validates them and gives the scaler; k passes
    draw the starting points of all restarts, then one pass an iteration moves all of them.
    The fit input is dealt by session id over ``partitions`` (the session's
    shuffle partitions by default), whatever its size."""
    check_columns(fm, cfg)
    restarts = cfg.restarts if restarts is None else restarts
    feats = tuple(cfg.features)
    n = partitions or int(fm.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = fm.select("match_id", *feats).repartition(n, "match_id").persist(StorageLevel.MEMORY_AND_DISK)
    points = None
    try:
        rows, moments = validation_report(base, feats), scaler_stats(base, feats)
        one_pass = base.sparkSession.range(1).select(
            rows.select(F.collect_list(F.struct("*"))).scalar().alias("rep"),
            moments.select(F.struct("*")).scalar().alias("stats")).first()
        check_report(one_pass["rep"], cfg)
        stats = fm.sparkSession.createDataFrame([tuple(one_pass["stats"])], moments.schema)   # freeze: one row of metadata
        points = standardize(base, feats, stats).select("match_id", F.array(*feats).alias("p")).persist(StorageLevel.MEMORY_AND_DISK)
        centers = lloyd(points, starting_points(points, cfg.k, restarts, cfg.seed), max_iter, tol)
        costs = restart_costs(points, centers)
    finally:
        base.unpersist()
        if points is not None:
            points.unpersist()
    best = min(costs, key=lambda r: (round(costs[r], 9), r))     # equal ends found from two starts differ in the last bits
    return ClusteringModel(feats, stats, sorted(centers[best]), float(costs[best]))


# ---------------------------------------------------------------- M4 -------
def silhouette(model: ClusteringModel, fm: DataFrame) -> float:
    """Mean silhouette of the model's labels (squared Euclidean distances)."""
    return float(silhouette_squared(standardize(fm, model.features, model.stats), model.labels(fm), model.features).first()[0])


# ---------------------------------------------------------------- M7 -------
def scaled_centroids(spark: SparkSession, model: ClusteringModel) -> DataFrame:
    """Long form (cluster_id, feature, value) of the canonical centroids."""
    return long_centroids(model.table(spark), model.features)


# ------------------------------------------- M3-M5 with given centroids ----
def group_centroids(scaled: DataFrame, labels: DataFrame, features) -> DataFrame:
    """(cluster_id, x: array of the mean of every feature), one row per cluster."""
    return (labels.join(scaled, "match_id").groupBy("cluster_id")
            .agg(F.array(*[F.avg(c) for c in features]).alias("x")))


def nearest_centroid(scaled: DataFrame, centroids: DataFrame, features) -> DataFrame:
    """(match_id, cluster_id, distance): the centroid with the least squared distance, ties to the lower id.

    The k centroids travel as one scalar."""
    every = centroids.select(F.sort_array(F.collect_list(F.struct("cluster_id", "x")))).scalar()
    here = F.array(*[F.col(c) for c in features])
    d = scaled.select("match_id", here.alias("_p"), every.alias("_c"))
    best = F.array_min(F.transform("_c", lambda c: F.struct(
        F.aggregate(F.zip_with("_p", c["x"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v).alias("distance"),
        c["cluster_id"].alias("cluster_id"))))
    return d.select("match_id", best.alias("_b")).select("match_id", "_b.cluster_id", "_b.distance")


def silhouette_squared(scaled: DataFrame, labels: DataFrame, features) -> DataFrame:
    """One row: the mean silhouette with squared Euclidean distances, from the size, sum
    and square sum of every cluster (k rows); a cluster of one scores 0."""
    rows = labels.join(scaled, "match_id").select(
        "cluster_id", F.array(*[F.col(c) for c in features]).alias("_p"))
    rows = rows.withColumn("_sq", F.aggregate("_p", F.lit(0.0), lambda s, v: s + v * v))
    sums = labels.join(scaled, "match_id").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in features]).alias("sum"),
        F.sum(sum((F.col(c) * F.col(c) for c in features), F.lit(0.0))).alias("sq"))
    every = sums.select(F.collect_list(F.struct("cluster_id", "n", "sum", "sq"))).scalar()
    far = F.transform("_c", lambda c: F.struct(
        c["cluster_id"].alias("id"), c["n"].alias("n"),
        (c["n"] * F.col("_sq") - 2 * F.aggregate(F.zip_with("_p", c["sum"], lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
         + c["sq"]).alias("t")))
    d = rows.withColumn("_c", every).withColumn("_t", far)
    own = F.element_at(F.filter("_t", lambda t: t["id"] == F.col("cluster_id")), 1)
    others = F.array_min(F.transform(F.filter("_t", lambda t: t["id"] != F.col("cluster_id")), lambda t: t["t"] / t["n"]))
    d = d.select(own["n"].alias("n"), (own["t"] / F.greatest(own["n"] - 1, F.lit(1))).alias("a"), others.alias("b"))
    top = F.greatest("a", "b")
    return d.agg(F.avg(F.when((F.col("n") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(F.lit(0.0))).alias("silhouette"))


def long_centroids(centroids: DataFrame, features) -> DataFrame:
    """(cluster_id, feature, value) from (cluster_id, x)."""
    names = F.array(*[F.lit(c) for c in features])
    return centroids.select("cluster_id", F.explode(F.arrays_zip(names.alias("feature"), F.col("x").alias("value"))).alias("_z")) \
        .select("cluster_id", "_z.feature", "_z.value")


def train_and_save(spark: SparkSession, fm: DataFrame, path: str, cfg: AnalysisConfig = DEFAULT,
                   restarts: int | None = None, store=None) -> tuple[ClusteringModel, DataFrame]:
    """Fit, persist the model, and return (model, labels). With a ``TableStore``
    the labels table is replaced in one new store version (K4)."""
    model = fit_clusters(fm, cfg, restarts)
    model.save(spark, path)
    labels = model.labels(fm)
    if store is not None:
        store.commit({"cluster_labels": labels}, mode="append", replace=("cluster_labels",))
        labels = store.read("cluster_labels")
    return model, labels
