"""Write PLANS.md: the static physical plan shape of the headline queries.

AQE and auto-broadcast are switched off so the report shows the plan a large
cluster starts from (worst case: no table is small enough to broadcast); at
run time AQE may turn shuffle joins with small sides into broadcasts.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = re.compile(r"Exchange|ReusedExchange|Window \[|SortMergeJoin|BroadcastHashJoin|BroadcastNestedLoop|"
                  r"FileScan|HashAggregate|SortAggregate|ObjectHashAggregate|MapInPandas|Generate|Subquery")


def summarize(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r", \[plan_id=\d+\]", "", line)
            line = re.sub(r"Location: [^,]*, ", "", line)
            out.append(line.rstrip()[:180])
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from playline.config import ADAPTER as CFG
    from playline.checks import landing_docs
    from playline.operators import features as FT, reports as RP
    from playline.plans.catalog_ingest import player
    from playline.plans.publish import surrogate_ids
    from playline.session import get_spark, shared_path
    from playline.sources import adapter, documents
    spark = get_spark()
    root = shared_path(spark, "plans")
    ev = adapter.load_events(spark, sf)
    adapter.sessions(ev).write.parquet(f"{root}/sessions")
    adapter.ticks(ev).write.parquet(f"{root}/ticks")
    adapter.incidents(ev, spark.read.parquet(f"{root}/ticks")).write.parquet(f"{root}/incidents")
    raw = landing_docs.write_landing({k: spark.read.parquet(f"{root}/{k}") for k in ("sessions", "ticks", "incidents")},
                                     f"{root}/landing", CFG.tick_ms)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    se, ti, inc = (spark.read.parquet(f"{root}/{k}") for k in ("sessions", "ticks", "incidents"))
    queries = {
        "excursions": FT.excursions(se, ti, CFG),
        "incident_context": FT.incident_context(se, ti, inc, CFG),
        "incident_agg": FT.incident_agg(FT.incident_context(se, ti, inc, CFG)),
        "feature_matrix (after the numbering checkpoints)": FT.feature_matrix(se, ti, inc, CFG),
        "ingest: paired documents": documents.flatten(documents.read_documents(spark, raw), player(), CFG.tick_ms)["sessions"],
        "swing_games": FT.swing_games(se, ti, CFG),
        "rival_matchups": FT.rival_matchups(se, CFG),
        "pace_curves": RP.pace_curves(ti, adapter.fixed_labels(FT.scope(se, CFG))),
        "surrogate_ids (after the range-partitioned checkpoint)": surrogate_ids(FT.scope(se, CFG)),
    }
    print("# Physical plan shapes (static: AQE and auto-broadcast off)\n")
    print("Generated by `tools/plan_report.py` on tables materialised from the driver's sf0.01 `events`.")
    print("Only exchanges, joins, windows, aggregates, scans and subqueries are kept; expression ids removed.\n")
    for name, df in queries.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = summarize(plan)
        n_ex = sum(1 for x in lines if re.search(r"\bExchange hashpartitioning|\bExchange rangepartitioning", x))
        print(f"## {name}\n\nscans: {sum('FileScan' in x for x in lines)}; shuffle exchanges: {n_ex}; broadcast exchanges: "
              f"{sum('BroadcastExchange' in x for x in lines)}; reused: {sum('ReusedExchange' in x for x in lines)}\n")
        print("```")
        print("\n".join(lines))
        print("```\n")


if __name__ == "__main__":
    main()
