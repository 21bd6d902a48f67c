"""Benchmark the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Inputs are materialised once the way production would hold them (the adapter
writes sessions/ticks/incidents as Parquet, documents are landed as JSON
Lines); each timed query then runs to completion through the ``noop`` sink
(full execution, nothing collected to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    restarts = int(os.environ.get("BENCH_RESTARTS", "20"))
    from playline.session import get_spark, shared_path
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus)

    from playline.config import ADAPTER as CFG
    from playline.operators import clustering as CL, explore as X, features as FT, reports as RP
    from playline.plans.ingest import ingest
    from playline.plans.publish import publish
    from playline.plans.tables import TableStore
    from playline.checks import landing_docs
    from playline.plans.catalog_ingest import player
    from playline.plans.catalog_reports import NUMERIC_FM
    from playline.sources import adapter

    timings: dict[str, float] = {}

    def run(name, fn):
        t0 = time.time()
        out = fn()
        if out is not None:
            out.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
        return out

    root = shared_path(spark, "bench")
    # untimed warm-up: JVM start, code generation, first file listing
    adapter.sessions(adapter.load_events(spark, sf)).write.format("noop").mode("overwrite").save()

    def build_tables():
        ev = adapter.load_events(spark, sf)
        adapter.sessions(ev).write.parquet(f"{root}/sessions")
        adapter.ticks(ev).write.parquet(f"{root}/ticks")
        adapter.incidents(ev, spark.read.parquet(f"{root}/ticks")).write.parquet(f"{root}/incidents")

    run("adapter_tables", build_tables)
    se, ti, inc = (spark.read.parquet(f"{root}/{n}") for n in ("sessions", "ticks", "incidents"))

    raw = f"{root}/landing"
    landing_docs.write_landing({"sessions": se, "ticks": ti, "incidents": inc}, raw, CFG.tick_ms)
    run("document_ingest", lambda: ingest(spark, raw, TableStore(spark, f"{root}/store"), player(), CFG.tick_ms)
        ["summary"])

    run("incident_context", lambda: FT.incident_context(se, ti, inc, CFG))
    run("excursions", lambda: FT.excursions(se, ti, CFG))
    run("swing_games", lambda: FT.swing_games(se, ti, CFG))
    run("rolling_form", lambda: FT.rolling_form(se, CFG))
    run("rival_matchups", lambda: FT.rival_matchups(se, CFG))

    def fm_build():
        FT.feature_matrix(se, ti, inc, CFG).write.parquet(f"{root}/feature_matrix")

    run("feature_matrix", fm_build)
    fm = spark.read.parquet(f"{root}/feature_matrix")
    labels = adapter.fixed_labels(FT.scope(se, CFG))
    run("kpi_overview", lambda: RP.kpi_overview(se, CFG))
    run("swing_summary", lambda: RP.swing_summary(fm))
    run("delta_quartiles", lambda: X.delta_quartiles(FT.swing_games(se, ti, CFG)))
    run("pace_curves", lambda: RP.pace_curves(ti, labels, CFG.curve_min_count, CFG.curve_min_share))
    run("feature_corr", lambda: X.pairwise_corr(fm, NUMERIC_FM))

    def clusters():
        model = CL.fit_clusters(fm, CFG, restarts=restarts)
        return model.labels(fm)

    run("cluster_sessions", clusters)

    def pub():
        publish(spark, {"sessions": se, "ticks": ti, "incidents": inc, "feature_matrix": fm,
                        "cluster_labels": labels}, f"{root}/published", CFG)

    run("publish", pub)
    total = round(sum(timings.values()), 3)
    label = os.path.basename(sf).replace("sf", "")
    try:
        sf_value = float(label)
    except ValueError:
        sf_value = label
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": timings,
                      "sf": sf_value, "cpus": cpus, "restarts": restarts}))


if __name__ == "__main__":
    main()
