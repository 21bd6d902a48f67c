"""Command line for the end-to-end flow over one table store.

    python -m playline.cli ingest   --raw RAW --store STORE --player ID [--layout files|lines] [--full]
    python -m playline.cli stream   --raw RAW --store STORE --checkpoint CKPT --player ID [--layout files|lines]
    python -m playline.cli features --store STORE [--incremental]
    python -m playline.cli train    --store STORE --models DIR [--restarts N]
    python -m playline.cli publish  --store STORE --out OUT [--coarsen day]

Every stage reads and writes whole tables through the store's manifest, so a
failed stage leaves the previous version visible. Settings such as the
checkpoint folder come from the submitting cluster's Spark configuration.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from playline.config import DEFAULT, AnalysisConfig
from playline.operators import clustering as CL, features as FT
from playline.plans.increment import refresh_features
from playline.plans.ingest import ingest
from playline.plans.publish import publish, publish_counts
from playline.plans.tables import TableStore


def feature_summary(fm: DataFrame) -> DataFrame:
    """Rows in the feature matrix and throw / comeback totals (one pass)."""
    return fm.agg(F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.sum(F.col("is_throw").cast("int")), F.lit(0)).alias("throws"),
                  F.coalesce(F.sum(F.col("is_comeback").cast("int")), F.lit(0)).alias("comebacks"))


def build_features(store: TableStore, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Replace ``feature_matrix`` in the store (K3) from its three session tables."""
    fm = FT.feature_matrix(store.read("sessions"), store.read("ticks"), store.read("incidents"), cfg)
    store.commit({"feature_matrix": fm}, replace=("feature_matrix",))
    return store.read("feature_matrix")


def train(spark: SparkSession, store: TableStore, models_dir: str, cfg: AnalysisConfig = DEFAULT,
          restarts: int | None = None):
    """Fit the clustering on the stored feature matrix; replace ``cluster_labels`` (K4, K5)."""
    fm = store.read("feature_matrix")
    model, labels = CL.train_and_save(spark, fm, models_dir, cfg, restarts, store=store)
    return model, labels


def publish_store(spark: SparkSession, store: TableStore, out: str, cfg: AnalysisConfig = DEFAULT,
                  coarsen_time: str | None = None) -> TableStore:
    tables = {t: store.read(t) for t in ("sessions", "ticks", "incidents", "feature_matrix", "cluster_labels")}
    return publish(spark, tables, out, cfg, coarsen_time)


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="playline")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("ingest", "stream", "features", "train", "publish"):
        s = sub.add_parser(name)
        s.add_argument("--store", required=True)
        if name in ("ingest", "stream"):
            s.add_argument("--raw", required=True)
            s.add_argument("--player", required=True)
            s.add_argument("--tick-ms", type=int, default=DEFAULT.tick_ms)
            s.add_argument("--layout", default="files", choices=("files", "lines"))
        if name == "ingest":
            s.add_argument("--full", action="store_true")
        if name == "features":
            s.add_argument("--incremental", action="store_true")
        if name == "stream":
            s.add_argument("--checkpoint", required=True)
        if name == "train":
            s.add_argument("--models", required=True)
            s.add_argument("--restarts", type=int, default=None)
        if name == "publish":
            s.add_argument("--out", required=True)
            s.add_argument("--coarsen", default=None)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"playline-{a.cmd}").getOrCreate()
    from playline.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    store = TableStore(spark, a.store)
    if a.cmd == "ingest":
        out = ingest(spark, a.raw, store, a.player, a.tick_ms, a.layout, "full" if a.full else "incremental")
        print(json.dumps(out["summary"].first().asDict()))
    elif a.cmd == "stream":
        from playline.streaming.ingest_stream import ingest_stream
        ingest_stream(spark, a.raw, store, a.checkpoint, a.player, a.tick_ms, layout=a.layout)
    elif a.cmd == "features":
        fm = refresh_features(store) if a.incremental else build_features(store)
        print(json.dumps(feature_summary(fm).first().asDict()))
    elif a.cmd == "train":
        model, _ = train(spark, store, a.models, restarts=a.restarts)
        print(json.dumps({"cost": model.cost, "centroids": model.centers()}))
    elif a.cmd == "publish":
        pub = publish_store(spark, store, a.out, coarsen_time=a.coarsen)
        print(json.dumps({r.table_name: r.row_count for r in publish_counts(pub).collect()}))


if __name__ == "__main__":
    main()
