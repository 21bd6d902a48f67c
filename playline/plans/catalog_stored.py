"""Keys over stored tables: tables dealt alike, mergeable sketches, replaced tables, strict documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from playline.checks import landing_docs as LD
from playline.cli import build_features, feature_summary
from playline.config import ADAPTER as CFG
from playline.operators import features as FT, sketches as S
from playline.plans.catalog import FEAT, R, T2, T3, register
from playline.plans.catalog_ingest import player
from playline.plans.dealt import dealt_feature_matrix, stored_baselines
from playline.plans.tables import TableStore
from playline.session import shared_path
from playline.sources import adapter, copartitioned as CP, documents as D

BUCKETS = 8
_FM = ("tilt_index", "gold_delta", "tilt_spiral_ratio", "avg_cs_sacrifice", "roam_impact_rate")


# ---------------------------------------------------------------- D1-D3, D6 on tables dealt alike
def _dealt(s, sf):
    path = shared_path(s, "dealt")
    return CP.write_copartitioned(dict(zip(CP.TABLES, T3(s, sf))), path, path.rsplit("/", 1)[1].replace("-", "_"), BUCKETS)


register("feature_matrix_copartitioned", R("SELECT * FROM fm", *_FM, extra=FEAT))(
    lambda s, sf: dealt_feature_matrix(s, _dealt(s, sf), shared_path(s, "baselines"), CFG))


@register("excursion_agg_copartitioned", R(
    "SELECT match_id, CAST(count(*) AS INTEGER) AS total_roams, avg(cs_sacrifice) AS avg_cs_sacrifice, "
    "avg(CASE WHEN roam_result = 'impact' THEN 1.0 ELSE 0.0 END) AS roam_impact_rate FROM ex GROUP BY match_id",
    "avg_cs_sacrifice", "roam_impact_rate", extra=FEAT))
def _excursions_dealt(s, sf):
    t = _dealt(s, sf)
    base = stored_baselines(s, t, shared_path(s, "baselines"), CFG)
    return FT.excursion_agg(FT.excursions(t["sessions"], t["ticks"], CFG, baselines=base))


# ---------------------------------------------------------------- E9, sketches
def _deltas(s, sf):
    se, ti = T2(s, sf)
    return FT.swing_games(se, ti, CFG).select("match_id", "win", "gold_delta").join(
        se.select("match_id", "game_version"), "match_id")


_RANGE = ("SELECT win, {r} AS versions, quantile_disc(gold_delta, 0.25) AS q1, quantile_disc(gold_delta, 0.5) AS median, "
          "quantile_disc(gold_delta, 0.75) AS q3, count(gold_delta) AS n FROM (SELECT w.match_id, w.win, w.gold_delta, s.game_version "
          "FROM sw w JOIN sessions s USING (match_id)) x GROUP BY ALL HAVING count(gold_delta) > 0")


@register("quartiles_merged", R(f"{_RANGE.format(r='game_version')} UNION ALL {_RANGE.format(r=chr(39) + 'all' + chr(39))}",
                                "q1", "median", "q3", extra=FEAT))
def _merged(s, sf):
    """Slices by result and version, stored; then each version and all of them from the stored slices alone."""
    path = shared_path(s, "slices")
    S.sketch_slices(_deltas(s, sf), "gold_delta", ["win", "game_version"]).write.parquet(path)
    slices = s.read.parquet(path).select("win", S.SKETCH, F.explode(F.array("game_version", F.lit("all"))).alias("versions"))
    return S.sketched_quartiles(slices, ["win", "versions"])


@register("quartiles_rank_error", R("SELECT win, count(gold_delta) AS n, true AS within FROM sw GROUP BY win", extra=FEAT))
def _rank_error(s, sf, k=256):
    """Small sketches, merged over versions: each quartile's true rank lies within twice the stated error."""
    df = _deltas(s, sf)
    quart = S.sketched_quartiles(S.sketch_slices(df, "gold_delta", ["win", "game_version"], k), ["win"], k)
    off = S.measured_rank_error(df, "gold_delta", quart, ["win"])
    return off.select("win", "n", (F.greatest("q1", "median", "q3") <= 2 * S.rank_error(k)).alias("within"))


# ---------------------------------------------------------------- K3, K4, R11
@register("stored_features", R("SELECT * FROM fm", *_FM, extra=FEAT))
def _stored_features(s, sf):
    """The matrix of a half of the sessions, replaced by that of all of them."""
    store, t = TableStore(s, shared_path(s, "store")), dict(zip(CP.TABLES, T3(s, sf)))
    store.commit(t | {"sessions": t["sessions"].where(F.crc32("match_id") % 2 == 0)})
    build_features(store, CFG)
    store.commit({"sessions": t["sessions"]}, replace=("sessions",))
    return build_features(store, CFG)


@register("stored_labels", R("SELECT * FROM labels_fixed", extra=FEAT))
def _stored_labels(s, sf):
    """Labels of an earlier fit, replaced as a whole."""
    store, labels = TableStore(s, shared_path(s, "store")), adapter.fixed_labels(FT.scope(T2(s, sf)[0], CFG))
    store.commit({"cluster_labels": labels.withColumn("cluster_id", F.col("cluster_id") + 1)}, replace=("cluster_labels",))
    store.commit({"cluster_labels": labels}, replace=("cluster_labels",))
    return store.read("cluster_labels")


register("feature_summary", R(
    "SELECT count(*) AS rows, CAST(coalesce(sum(CAST(is_throw AS INTEGER)), 0) AS BIGINT) AS throws, "
    "CAST(coalesce(sum(CAST(is_comeback AS INTEGER)), 0) AS BIGINT) AS comebacks FROM fm", extra=FEAT))(
    lambda s, sf: feature_summary(FT.feature_matrix(*T3(s, sf), CFG)))


# ---------------------------------------------------------------- N8
@register("ingest_explicit_null", R(
    "SELECT match_id, CASE CAST(puuid AS BIGINT) % 3 WHEN 0 THEN kills WHEN 1 THEN 0 END AS kills, "
    "CASE WHEN CAST(puuid AS BIGINT) % 3 = 2 THEN 'null counter' END AS reason FROM sessions"))
def _explicit_null(s, sf):
    """A third of the documents lacks a counter (it counts as 0), a third has it as null (rejected when strict)."""
    t = dict(zip(CP.TABLES, T3(s, sf)))
    path = LD.write_null_counters(t, shared_path(s, "landing"), CFG.tick_ms)
    p = D.pair_documents(D.read_documents(s, path, "lines"), player(), strict=True)
    kept = D.session_facts(p["pairs"]).select("match_id", "kills", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(p["quarantine"].select(F.col("doc_key").alias("match_id"), F.lit(None).cast("int").alias("kills"), "reason"))
