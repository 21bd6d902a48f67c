"""Report (R*), exploration (E*) and scalar-family keys of the query registry."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from playline.config import ADAPTER as CFG, FEATURE_COLUMNS
from playline.functions import scalars as S
from playline.operators import explore as X, features as FT, reports as RP
from playline.plans.catalog import FEAT, R, T2, T3, feature_matrix_df, register
from playline.sources import adapter

RM = """
rm AS (
  SELECT champion_name, opp_champion_name, count(*) AS games,
         avg(cs_total) AS our_avg_cs, avg(opp_cs_total) AS opp_avg_cs,
         avg(cs_total) - avg(opp_cs_total) AS cs_diff,
         avg(CASE WHEN win THEN 1.0 ELSE 0.0 END) AS our_winrate, avg(kda) AS our_avg_kda,
         avg(CASE WHEN opp_deaths IS NULL THEN NULL
                  ELSE (opp_kills + opp_assists) / greatest(opp_deaths, 1) END) AS opp_avg_kda
  FROM scoped WHERE opp_champion_name IS NOT NULL AND opp_cs_total IS NOT NULL
  GROUP BY champion_name, opp_champion_name HAVING count(*) >= 2
),
cs_sum AS (
  SELECT l.cluster_id, CAST(count(*) AS INTEGER) AS size,
         """ + ", ".join(f"avg(f.{c}) AS {c}" for c in FEATURE_COLUMNS) + """
  FROM labels_fixed l JOIN fm f ON f.match_id = l.match_id GROUP BY l.cluster_id
),
pc AS (
  SELECT p.cluster_id, p.timestamp_min, p.avg_gold FROM (
    SELECT l.cluster_id, t.timestamp_min, count(*) AS match_count, avg(CAST(t.gold AS DOUBLE)) AS avg_gold
    FROM labels_fixed l JOIN ticks t ON t.match_id = l.match_id GROUP BY l.cluster_id, t.timestamp_min) p
  JOIN (SELECT cluster_id, count(*) AS cluster_size FROM labels_fixed GROUP BY cluster_id) s
    ON s.cluster_id = p.cluster_id
  WHERE p.match_count >= greatest(3, round(s.cluster_size * 0.5))
),
gt AS (
  SELECT match_id, CASE WHEN is_throw THEN 'throw' WHEN is_comeback THEN 'comeback' ELSE 'neutral' END AS game_type
  FROM sw
)"""
EXTRA = FEAT + "," + RM

BREAKDOWN = " UNION ALL ".join(
    f"SELECT '{lab}' AS category, CAST(coalesce(sum(CAST({c} AS INTEGER)), 0) AS BIGINT) AS deaths, "
    f"{i} AS category_order FROM ic"
    for i, (lab, c) in enumerate(RP.INCIDENT_CATEGORIES))


def _labels(se):
    return adapter.fixed_labels(FT.scope(se, CFG))


def _ctx(s, sf):
    return FT.incident_context(*T3(s, sf), CFG)


def _ex(s, sf):
    se, ti = T2(s, sf)
    return FT.excursions(se, ti, CFG)


def _swing(s, sf):
    se, ti = T2(s, sf)
    return FT.swing_games(se, ti, CFG)


# ---------------------------------------------------------------- R1-R4 ----
register("kpi_overview", R(
    "SELECT CAST(count(*) AS INTEGER) AS total_games, avg(CAST(win AS INTEGER)) AS win_rate, "
    "avg(kda) AS avg_kda, avg(cs_per_min) AS avg_cs_per_min FROM scoped",
    "win_rate", "avg_kda", "avg_cs_per_min"))(lambda s, sf: RP.kpi_overview(T2(s, sf)[0], CFG))

register("version_stats", R(
    "SELECT game_version, CAST(count(*) AS INTEGER) AS games, avg(CAST(win AS INTEGER)) AS win_rate, "
    "TRY_CAST(split_part(game_version, '.', 1) AS INTEGER) AS version_major, "
    "TRY_CAST(split_part(game_version, '.', 2) AS INTEGER) AS version_minor "
    "FROM scoped GROUP BY game_version", "win_rate"))(lambda s, sf: RP.version_stats(T2(s, sf)[0], CFG))

register("time_bucket_stats", R(
    "SELECT time_bucket, CAST(count(*) AS INTEGER) AS games, avg(CAST(win AS INTEGER)) AS win_rate, "
    "CASE time_bucket WHEN 'morning' THEN 0 WHEN 'afternoon' THEN 1 WHEN 'evening' THEN 2 "
    "WHEN 'night' THEN 3 END AS bucket_order FROM fm GROUP BY time_bucket", "win_rate", extra=FEAT))(
    lambda s, sf: RP.time_bucket_stats(feature_matrix_df(s, sf)))

register("swing_summary", R(
    "SELECT CAST(coalesce(sum(CAST(is_throw AS INTEGER)), 0) AS INTEGER) AS throws, "
    "CAST(coalesce(sum(CAST(is_comeback AS INTEGER)), 0) AS INTEGER) AS comebacks, "
    "CAST(count(*) AS INTEGER) AS total, "
    "CASE WHEN count(*) = 0 THEN 0.0 ELSE coalesce(sum(CAST(is_throw AS INTEGER)), 0) / count(*) END AS throw_rate "
    "FROM fm", "throw_rate", extra=FEAT))(lambda s, sf: RP.swing_summary(feature_matrix_df(s, sf)))

# ---------------------------------------------------------------- R5, R8 ---
register("matchup_table", R(
    "SELECT champion_name, opp_champion_name, games, round(our_winrate * 100, 2) AS our_winrate_pct, "
    "round(cs_diff, 2) AS cs_diff, round(our_avg_kda, 2) AS our_avg_kda, round(opp_avg_kda, 2) AS opp_avg_kda, "
    "cs_diff >= 0 AS cs_ahead FROM rm", "our_winrate_pct", "cs_diff", "our_avg_kda", "opp_avg_kda", extra=EXTRA))(
    lambda s, sf: RP.matchup_table(FT.rival_matchups(T2(s, sf)[0], CFG)))

register("matchup_table_one", R(
    "SELECT champion_name, opp_champion_name, games, round(our_winrate * 100, 2) AS our_winrate_pct, "
    "round(cs_diff, 2) AS cs_diff, round(our_avg_kda, 2) AS our_avg_kda, round(opp_avg_kda, 2) AS opp_avg_kda, "
    "cs_diff >= 0 AS cs_ahead FROM rm WHERE champion_name = 'C3'",
    "our_winrate_pct", "cs_diff", "our_avg_kda", "opp_avg_kda", extra=EXTRA))(
    lambda s, sf: RP.matchup_table(FT.rival_matchups(T2(s, sf)[0], CFG), "C3"))
register("matchup_order", R(
    "SELECT champion_name, opp_champion_name, games, cs_diff, CAST(row_number() OVER (ORDER BY cs_diff, champion_name, "
    "opp_champion_name) AS INTEGER) AS diff_order FROM rm", "cs_diff", extra=EXTRA))(
    lambda s, sf: RP.signed_order(FT.rival_matchups(T2(s, sf)[0], CFG)).select(
        "champion_name", "opp_champion_name", "games", "cs_diff", "diff_order"))


@register("rival_matchups_some", R(
    "SELECT champion_name, opp_champion_name, count(*) AS games, avg(cs_total) AS our_avg_cs, avg(opp_cs_total) AS opp_avg_cs, "
    "avg(cs_total) - avg(opp_cs_total) AS cs_diff, avg(CASE WHEN win THEN 1.0 ELSE 0.0 END) AS our_winrate, avg(kda) AS our_avg_kda, "
    "avg(CASE WHEN opp_deaths IS NULL OR CAST(puuid AS BIGINT) % 5 = 1 THEN NULL ELSE (opp_kills + opp_assists) / "
    "greatest(opp_deaths, 1) END) AS opp_avg_kda FROM scoped WHERE CAST(puuid AS BIGINT) % 3 <> 0 "
    "GROUP BY champion_name, opp_champion_name HAVING count(*) >= 2",
    "our_avg_cs", "opp_avg_cs", "cs_diff", "our_winrate", "our_avg_kda", "opp_avg_kda"))
def _some_rivals(s, sf):
    """Rivals missing for a third of the players, their incident counts for a fifth."""
    p = F.col("puuid").cast("long")
    se = T2(s, sf)[0]
    se = se.withColumns({c: F.when(p % 3 != 0, F.col(c)) for c in se.columns if c.startswith("opp_")})
    return FT.rival_matchups(se.withColumn("opp_deaths", F.when(p % 5 != 1, F.col("opp_deaths"))), CFG)


register("dimension_members", R(
    "SELECT DISTINCT champion_name FROM rm WHERE champion_name IS NOT NULL", extra=EXTRA))(
    lambda s, sf: RP.dimension_members(FT.rival_matchups(T2(s, sf)[0], CFG), "champion_name"))

# ---------------------------------------------------------------- R6, R7 ---
register("cluster_summary", R("SELECT * FROM cs_sum", *FEATURE_COLUMNS, extra=EXTRA))(
    lambda s, sf: RP.cluster_summary(feature_matrix_df(s, sf), _labels(T2(s, sf)[0])))

_Z = ", ".join(
    f"({c} - (SELECT avg({c}) FROM cs_sum)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 "
    f"ELSE stddev_pop({c}) END FROM cs_sum) AS {c}" for c in FEATURE_COLUMNS)
register("centroid_z", R(f"SELECT cluster_id, {_Z} FROM cs_sum", *FEATURE_COLUMNS, extra=EXTRA))(
    lambda s, sf: RP.centroid_z(RP.cluster_summary(feature_matrix_df(s, sf), _labels(T2(s, sf)[0]))))


@register("pace_curves", R("SELECT * FROM pc", "avg_gold", extra=EXTRA))
def _pace(s, sf):
    se, ti = T2(s, sf)
    return RP.pace_curves(ti, _labels(se), CFG.curve_min_count, CFG.curve_min_share)


NAMES = {0: "zero", 1: "one", 3: "three"}      # cluster 2 has no name
PC_LOW = """
pc_low AS (
  SELECT p.cluster_id, p.timestamp_min, p.avg_gold FROM (
    SELECT l.cluster_id, t.timestamp_min, count(*) AS match_count, avg(CAST(t.gold AS DOUBLE)) AS avg_gold
    FROM labels_fixed l JOIN ticks t ON t.match_id = l.match_id GROUP BY l.cluster_id, t.timestamp_min) p
  JOIN (SELECT cluster_id, count(*) AS cluster_size FROM labels_fixed GROUP BY cluster_id) s
    ON s.cluster_id = p.cluster_id
  WHERE p.match_count >= greatest(3, round(s.cluster_size * 0.1))
)"""


@register("pace_curves_named", R(
    "SELECT cluster_id, timestamp_min, avg_gold, CASE cluster_id WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 3 THEN 'three' "
    "END AS cluster_name FROM pc_low",
    "avg_gold", extra=PC_LOW))
def _pace_named(s, sf):
    """J17 (cluster id -> display name, one cluster without a name) on pace curves with a 10 % support share, so that at the check scale both
    retained and dropped (cluster, tick) cells occur."""
    se, ti = T2(s, sf)
    curves = RP.pace_curves(ti, _labels(se), CFG.curve_min_count, 0.1)
    return RP.named(curves, NAMES)


@register("missing_members_some", R(
    "SELECT DISTINCT cluster_id FROM labels_fixed WHERE cluster_id NOT IN (SELECT cluster_id FROM pc_low WHERE cluster_id <> 2)",
    extra=PC_LOW))
def _missing_some(s, sf):
    """Curves of some clusters: exactly the others are missing."""
    se, ti = T2(s, sf)
    curves = RP.pace_curves(ti, _labels(se), CFG.curve_min_count, 0.1)
    return RP.missing_members(curves.where("cluster_id <> 2"), _labels(se))


register("cluster_names", R(
    "SELECT cluster_id, CASE WHEN z >= 0 THEN 'high ' ELSE 'low ' END || f AS cluster_name FROM (SELECT cluster_id, f, z, "
    "row_number() OVER (PARTITION BY cluster_id ORDER BY round(abs(z), 9) DESC, f DESC) AS n FROM ("
    + " UNION ALL ".join(f"SELECT cluster_id, '{c}' AS f, ({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 "
                         f"THEN 1.0 ELSE stddev_pop({c}) OVER () END AS z FROM cs_sum" for c in FEATURE_COLUMNS)
    + ")) WHERE n = 1", extra=EXTRA))(
    lambda s, sf: RP.profile_names(RP.cluster_summary(feature_matrix_df(s, sf), _labels(T2(s, sf)[0]))))


@register("missing_members", R(
    "SELECT DISTINCT cluster_id FROM labels_fixed WHERE cluster_id NOT IN (SELECT cluster_id FROM pc)", extra=EXTRA))
def _missing(s, sf):
    se, ti = T2(s, sf)
    lab = _labels(se)
    return RP.missing_members(RP.pace_curves(ti, lab, CFG.curve_min_count, CFG.curve_min_share), lab)


# ---------------------------------------------------------------- R9, R10 --
register("incident_breakdown", R(BREAKDOWN, extra=FEAT))(lambda s, sf: RP.incident_breakdown(_ctx(s, sf)))


@register("table_counts", R(
    "SELECT 'sessions' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM sessions UNION ALL "
    "SELECT 'ticks', CAST(count(*) AS BIGINT) FROM ticks UNION ALL "
    "SELECT 'incidents', CAST(count(*) AS BIGINT) FROM incidents UNION ALL "
    "SELECT 'feature_matrix', CAST(count(*) AS BIGINT) FROM fm UNION ALL "
    "SELECT 'cluster_labels', CAST(count(*) AS BIGINT) FROM labels_fixed", extra=FEAT))
def _counts(s, sf):
    se, ti, inc = T3(s, sf)
    return RP.table_counts({"sessions": se, "ticks": ti, "incidents": inc,
                            "feature_matrix": FT.feature_matrix(se, ti, inc, CFG), "cluster_labels": _labels(se)})


# ---------------------------------------------------------------- E1, A12 --
register("profile_counts", R(
    "SELECT (SELECT count(*) FROM sessions) AS total_matches, (SELECT count(*) FROM incidents) AS total_deaths, "
    "(SELECT count(*) FROM ticks) AS total_timeline_rows, "
    "(SELECT count(position_x) FROM ticks) AS rows_with_position, "
    "(SELECT count(opp_champion_name) FROM sessions) AS matches_with_opp_mid"))(
    lambda s, sf: X.profile_counts(*T3(s, sf)))

register("distinct_counts", R(
    "SELECT (SELECT count(DISTINCT match_id) FROM ic) AS sessions_with_incidents, "
    "(SELECT count(DISTINCT match_id) FROM ex) AS sessions_with_excursions", extra=FEAT))(
    lambda s, sf: X.distinct_counts(_ctx(s, sf), _ex(s, sf)))


# ---------------------------------------------------------------- E2-E6 ----
def _unit_hist(expr: str, src: str, lo: int, nb: int, by: str = "") -> str:
    sel_by = f"{by}, " if by else ""
    return (f"SELECT {sel_by}bin, CAST(bin + {lo} AS DOUBLE) AS bin_lo, CAST(bin + {lo} + 1 AS DOUBLE) AS bin_hi, "
            f"count(*) AS count FROM (SELECT {sel_by}CAST(least({expr} - {lo}, {nb - 1}) AS INTEGER) AS bin "
            f"FROM {src} WHERE {expr} BETWEEN {lo} AND {lo + nb}) h GROUP BY {sel_by}bin")


def _width_hist(col: str, src: str, nb: int, by: str = "") -> str:
    sel_by = f"{by}, " if by else ""
    return f"""
SELECT {sel_by}bin, lo + bin * w AS bin_lo, lo + (bin + 1) * w AS bin_hi, count(*) AS count FROM (
  SELECT {sel_by}CAST(least(floor(({col} - lo) / w), {nb - 1}) AS INTEGER) AS bin, lo, w FROM {src},
    (SELECT lo, (hi - lo) / {nb} AS w FROM (
       SELECT CASE WHEN max({col}) > min({col}) THEN min({col}) ELSE min({col}) - 0.5 END AS lo,
              CASE WHEN max({col}) > min({col}) THEN max({col}) ELSE max({col}) + 0.5 END AS hi
       FROM {src}) a) b
  WHERE {col} IS NOT NULL) h
GROUP BY {sel_by}bin, lo, w"""


register("hist_incident_tick", R(_unit_hist("timestamp_min", "ic", 0, 44), extra=FEAT))(
    lambda s, sf: X.hist_incident_tick(_ctx(s, sf)))
register("hist_lead", R(_width_hist("gold_lead_approx", "ic", 40), "bin_lo", "bin_hi", extra=FEAT))(
    lambda s, sf: X.hist_lead(_ctx(s, sf)))
register("incident_breakdown_pct", R(
    "SELECT category, deaths AS death_count, CASE WHEN t.n = 0 THEN 0.0 ELSE round(deaths / t.n * 100, 1) END "
    f"AS pct_of_deaths, category_order FROM ({BREAKDOWN}) b, (SELECT count(*) AS n FROM ic) t",
    "pct_of_deaths", extra=FEAT))(lambda s, sf: X.incident_breakdown_pct(_ctx(s, sf)))
register("incident_category", R(
    "SELECT match_id, death_number, timestamp_min, gold_lead_approx, CASE WHEN is_overextension_ahead "
    "THEN 'overextension_ahead' WHEN is_deficit_fight THEN 'deficit_fight' WHEN is_early_death THEN 'early_death' "
    "ELSE 'neutral' END AS category FROM ic WHERE timestamp_min <= 14", "gold_lead_approx", extra=FEAT))(
    lambda s, sf: X.incident_category(_ctx(s, sf), CFG))
register("spiral_sessions", R(
    "SELECT match_id, count(*) AS deaths, CAST(sum(CAST(is_tilt_spiral AS INTEGER)) AS BIGINT) AS tilt_spirals, "
    "sum(CAST(is_tilt_spiral AS INTEGER)) > 0 AS had_tilt_spiral FROM ic GROUP BY match_id", extra=FEAT))(
    lambda s, sf: X.spiral_sessions(_ctx(s, sf)))

# ---------------------------------------------------------------- E8-E11 ---
register("hist_delta_by_win", R(_width_hist("gold_delta", "sw", 30, by="win"), "bin_lo", "bin_hi", extra=FEAT))(
    lambda s, sf: X.hist_delta_by_win(_swing(s, sf)))


def _quart(col, src, by):
    return (f"SELECT {by}, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median, "
            f"quantile_cont({col}, 0.75) AS q3, min({col}) AS min, max({col}) AS max, count({col}) AS n "
            f"FROM {src} GROUP BY {by}")


register("delta_quartiles", R(_quart("gold_delta", "sw", "win"), "q1", "median", "q3", "min", "max", extra=FEAT))(
    lambda s, sf: X.delta_quartiles(_swing(s, sf)))
register("cost_quartiles", R(_quart("cs_sacrifice", "ex", "roam_result"), "q1", "median", "q3", "min", "max",
                             extra=FEAT))(lambda s, sf: X.cost_quartiles(_ex(s, sf)))
register("game_type_share", R(
    "SELECT game_type, count(*) AS count, round(count(*) / (SELECT count(*) FROM sw) * 100, 1) AS pct "
    "FROM gt GROUP BY game_type", "pct", extra=EXTRA))(lambda s, sf: X.game_type_share(_swing(s, sf)))


@register("game_type_curve", R(
    "SELECT g.game_type, t.timestamp_min, avg(CAST(t.gold AS DOUBLE)) AS avg_gold FROM ticks t "
    "JOIN gt g ON g.match_id = t.match_id WHERE t.timestamp_min <= 30 GROUP BY g.game_type, t.timestamp_min",
    "avg_gold", extra=EXTRA))
def _gtc(s, sf):
    se, ti = T2(s, sf)
    return X.game_type_curve(FT.swing_games(se, ti, CFG), ti)


# ---------------------------------------------------------------- E12-E16 --
_H = f"{X.HEX_WIDTH} * sqrt(3.0)"
register("position_hex", R(
    "SELECT CAST(q AS INTEGER) AS hex_q, CAST(r AS INTEGER) AS hex_r, count(*) AS n, "
    f"(q + r / 2.0) * {X.HEX_WIDTH} AS center_x, r / 2.0 * {_H} AS center_y FROM ("
    "SELECT CASE WHEN odd < even THEN floor(fx) - floor(fy) ELSE floor(fx + 0.5) - floor(fy + 0.5) END AS q, "
    "CASE WHEN odd < even THEN 2 * floor(fy) + 1 ELSE 2 * floor(fy + 0.5) END AS r FROM ("
    f"SELECT *, pow(fx - floor(fx) - 0.5, 2) + 3 * pow(fy - floor(fy) - 0.5, 2) AS odd, "
    "pow(fx - floor(fx + 0.5), 2) + 3 * pow(fy - floor(fy + 0.5), 2) AS even FROM ("
    f"SELECT CAST(position_x AS DOUBLE) / {X.HEX_WIDTH} AS fx, CAST(position_y AS DOUBLE) / ({_H}) AS fy FROM ticks "
    "WHERE timestamp_min BETWEEN 4 AND 14 AND position_x IS NOT NULL AND position_y IS NOT NULL))) GROUP BY q, r",
    "center_x", "center_y"))(lambda s, sf: X.position_hex(T3(s, sf)[1], CFG))


register("position_grid", R(
    "SELECT CAST(floor(position_x / 375) AS INTEGER) AS cell_x, CAST(floor(position_y / 375) AS INTEGER) AS cell_y, "
    "count(*) AS n FROM ticks WHERE timestamp_min BETWEEN 4 AND 14 AND position_x IS NOT NULL "
    "GROUP BY 1, 2"))(lambda s, sf: X.position_grid(T3(s, sf)[1], CFG))
register("excursion_duration", R(_unit_hist("(roam_end_min - roam_start_min + 1)", "ex", 1, 8), extra=FEAT))(
    lambda s, sf: X.excursion_duration(_ex(s, sf)))
register("excursion_impact", R(
    "SELECT roam_result, count(*) AS count, count(*) / (SELECT count(*) FROM ex) AS share FROM ex "
    "GROUP BY roam_result", "share", extra=FEAT))(lambda s, sf: X.excursion_impact(_ex(s, sf)))
register("excursion_start", R(_unit_hist("roam_start_min", "ex", 4, 11, by="roam_result"), extra=FEAT))(
    lambda s, sf: X.excursion_start(_ex(s, sf), CFG))
register("top_matchups", R(
    "SELECT * FROM rm ORDER BY games DESC, champion_name, opp_champion_name LIMIT 10",
    "our_avg_cs", "opp_avg_cs", "cs_diff", "our_winrate", "our_avg_kda", "opp_avg_kda", extra=EXTRA))(
    lambda s, sf: X.top_matchups(FT.rival_matchups(T2(s, sf)[0], CFG)))

register("spiral_histogram", R(
    "SELECT CAST(least(n, 18) AS INTEGER) AS bin, had AS had_tilt_spiral, count(*) AS games FROM (SELECT match_id, count(*) AS n, "
    "bool_or(is_tilt_spiral) AS had FROM ic GROUP BY match_id) WHERE n <= 19 GROUP BY ALL", extra=FEAT))(
    lambda s, sf: X.spiral_histogram(_ctx(s, sf)))
register("spiral_flags", R(
    "SELECT match_id, death_number, coalesce(timestamp_min - lag(timestamp_min) OVER (PARTITION BY match_id ORDER BY death_number) "
    "<= 3, false) AS near FROM incidents"))(lambda s, sf: _gap(T3(s, sf)[2]))


def _gap(inc):
    from playline.operators.sequence import gap_flags
    return gap_flags(inc, "match_id", "death_number", "timestamp_min", CFG.spiral_gap, out="near",
                     seq="death_number").select("match_id", "death_number", "near")


# ---------------------------------------------------------------- E19-E24 --
_CUT = " ".join(f"WHEN tilt_index >= {lo} AND tilt_index < {hi} THEN '{lab}'"
                for lo, hi, lab in zip(X.FORM_EDGES[:-1], X.FORM_EDGES[1:], X.FORM_LABELS))
register("form_bucket_rate", R(
    f"SELECT tilt_bucket, avg(CASE WHEN win THEN 1.0 ELSE 0.0 END) AS win_rate, count(*) AS games FROM "
    f"(SELECT CASE {_CUT} END AS tilt_bucket, win FROM rf) b WHERE tilt_bucket IS NOT NULL GROUP BY tilt_bucket",
    "win_rate", extra=FEAT))(lambda s, sf: X.form_bucket_rate(FT.rolling_form(T2(s, sf)[0], CFG)))

_LT = " ".join(f"WHEN h BETWEEN {lo} AND {hi} THEN '{lab}'" for lab, lo, hi in X.LOCAL_TIME_BUCKETS)
register("local_time_rate", R(
    f"SELECT CASE {_LT} ELSE '{X.LOCAL_NIGHT}' END AS time_bucket, "
    "avg(CASE WHEN win THEN 1.0 ELSE 0.0 END) AS win_rate, count(*) AS games FROM "
    f"(SELECT hour(game_datetime + INTERVAL {X.LOCAL_OFFSET_HOURS} HOUR) AS h, win FROM sessions) x GROUP BY 1",
    "win_rate"))(lambda s, sf: X.local_time_rate(T2(s, sf)[0]))

_DAYS = "[" + ", ".join(f"'{d}'" for d in X.WEEKDAY_NAMES) + "]"
register("weekday_rate", R(
    f"SELECT d.day_of_week, {_DAYS}[d.day_of_week + 1] AS day_name, p.win_rate, coalesce(p.games, 0) AS games "
    "FROM (SELECT CAST(range AS INTEGER) AS day_of_week FROM range(7)) d LEFT JOIN "
    "(SELECT CAST(isodow(game_datetime) - 1 AS INTEGER) AS day_of_week, "
    "avg(CASE WHEN win THEN 1.0 ELSE 0.0 END) AS win_rate, count(*) AS games FROM sessions GROUP BY 1) p "
    "ON p.day_of_week = d.day_of_week", "win_rate"))(lambda s, sf: X.weekday_rate(T2(s, sf)[0]))

NUMERIC_FM = ("tilt_index", "hour_of_day", "day_of_week", "gold_delta", "total_deaths", "deaths_while_ahead",
              "tilt_spiral_ratio", "max_death_streak", "total_roams", "avg_cs_sacrifice", "roam_impact_rate")
_PROF = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
    f"avg(CAST({c} AS DOUBLE)) AS mean, min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max, "
    "CAST(NULL AS VARCHAR) AS low, CAST(NULL AS VARCHAR) AS high FROM fm" for c in NUMERIC_FM)
register("column_profile", R(_PROF, "mean", "min", "max", extra=FEAT))(
    lambda s, sf: X.profile(feature_matrix_df(s, sf), NUMERIC_FM))

INCIDENT_NUMBERS = ("death_number", "timestamp_ms", "timestamp_min", "gold_at_death", "cs_at_death")
register("incident_profile", R(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
    + (f"avg(CAST({c} AS DOUBLE)) AS mean, min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max, "
       "CAST(NULL AS VARCHAR) AS low, CAST(NULL AS VARCHAR) AS high" if c != "match_id" else
       "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, "
       "min(match_id) AS low, max(match_id) AS high") + " FROM incidents"
    for c in ("match_id", *INCIDENT_NUMBERS)), "mean", "min", "max"))(lambda s, sf: X.profile(T3(s, sf)[2]))
register("incident_corr", R(" UNION ALL ".join(
    f"SELECT '{b}' AS col_a, '{a}' AS col_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS corr FROM incidents"
    for a, b in combinations(INCIDENT_NUMBERS, 2)), "corr"))(
    lambda s, sf: X.pairwise_corr(T3(s, sf)[2], INCIDENT_NUMBERS))

_CORR = " UNION ALL ".join(
    f"SELECT '{b}' AS col_a, '{a}' AS col_b, CASE WHEN stddev_pop(CAST({a} AS DOUBLE)) > 0 AND "
    f"stddev_pop(CAST({b} AS DOUBLE)) > 0 THEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END AS corr FROM fm"
    for a, b in combinations(NUMERIC_FM, 2))
register("feature_corr", R(_CORR, "corr", extra=FEAT))(
    lambda s, sf: X.pairwise_corr(feature_matrix_df(s, sf), NUMERIC_FM))

register("cluster_outcomes", R(
    "SELECT l.cluster_id, count(*) AS games, avg(CASE WHEN f.win THEN 1.0 ELSE 0.0 END) AS win_rate, "
    "avg(f.gold_delta) AS avg_gold_delta, avg(f.total_deaths) AS avg_deaths FROM labels_fixed l "
    "JOIN fm f ON f.match_id = l.match_id GROUP BY l.cluster_id",
    "win_rate", "avg_gold_delta", "avg_deaths", extra=FEAT))(
    lambda s, sf: X.cluster_outcomes(feature_matrix_df(s, sf), _labels(T2(s, sf)[0])))


@register("pace_curves_raw", R(
    "SELECT l.cluster_id, t.timestamp_min, avg(CAST(t.gold AS DOUBLE)) AS avg_gold FROM labels_fixed l "
    "JOIN ticks t ON t.match_id = l.match_id GROUP BY l.cluster_id, t.timestamp_min", "avg_gold"))
def _pcr(s, sf):
    se, ti = T2(s, sf)
    return X.pace_curves_raw(ti, _labels(se))


# ---------------------------------------------------------------- scalars --
@register("scalar_version", R(
    "SELECT match_id, raw, CASE WHEN len(string_split(raw, '.')) < 2 THEN raw "
    "ELSE array_to_string(string_split(raw, '.')[1:2], '.') END AS version, "
    "CASE WHEN len(string_split(short_raw, '.')) < 2 THEN short_raw "
    "ELSE array_to_string(string_split(short_raw, '.')[1:2], '.') END AS short_version, "
    "TRY_CAST(split_part(raw, '.', 1) AS INTEGER) AS version_major, "
    "TRY_CAST(split_part(raw, '.', 2) AS INTEGER) AS version_minor FROM "
    "(SELECT match_id, game_version || '.' || CAST(vision_score AS VARCHAR) AS raw, "
    "'v' || CAST(vision_score AS VARCHAR) AS short_raw FROM sessions) x"))
def _sv(s, sf):
    se = T2(s, sf)[0]
    x = se.select("match_id", F.concat_ws(".", "game_version", F.col("vision_score").cast("string")).alias("raw"),
                  F.concat(F.lit("v"), F.col("vision_score").cast("string")).alias("short_raw"))
    major, minor = S.version_sort_keys("raw")
    return x.select("match_id", "raw", S.major_minor("raw").alias("version"),
                    S.major_minor("short_raw").alias("short_version"),
                    major.alias("version_major"), minor.alias("version_minor"))


@register("scalar_time", R(
    "SELECT match_id, epoch_us(game_datetime) // 1000 AS epoch_ms, "
    "epoch_ms(epoch_us(game_datetime) // 1000) AS utc_ts, "
    "CAST(hour(game_datetime) AS INTEGER) AS hour_of_day, CAST(isodow(game_datetime) - 1 AS INTEGER) AS day_of_week, "
    "isodow(game_datetime) IN (6, 7) AS is_weekend, "
    "CASE WHEN hour(game_datetime) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(game_datetime) BETWEEN 12 AND 17 "
    "THEN 'afternoon' WHEN hour(game_datetime) BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS time_bucket, "
    "CAST(hour(game_datetime + INTERVAL 7 HOUR) AS INTEGER) AS local_hour, "
    "CAST(game_duration_sec * 1000 // 21600000 AS INTEGER) AS duration_ticks FROM sessions"))
def _st(s, sf):
    se = T2(s, sf)[0]
    ms = S.to_epoch_ms("game_datetime")
    ts = F.col("game_datetime")
    return se.select("match_id", ms.alias("epoch_ms"), S.from_epoch_ms(ms).alias("utc_ts"),
                     F.hour(ts).alias("hour_of_day"), F.weekday(ts).alias("day_of_week"),
                     F.weekday(ts).isin(5, 6).alias("is_weekend"), S.time_bucket(F.hour(ts)).alias("time_bucket"),
                     S.local_hour(ts, 7).alias("local_hour"),
                     S.tick_of(F.col("game_duration_sec") * 1000, adapter.TICK_MS).alias("duration_ticks"))


@register("scalar_ratio", R(
    "SELECT match_id, (kills + assists) / greatest(deaths, 1) AS kda, "
    "CASE WHEN opp_deaths IS NULL THEN NULL ELSE (opp_kills + opp_assists) / greatest(opp_deaths, 1) END AS opp_kda, "
    "CASE WHEN game_duration_sec > 0 THEN cs_total / (game_duration_sec / 60.0) ELSE 0.0 END AS cs_per_min, "
    "least(greatest((kills + assists) / greatest(deaths, 1), 0.5), 5.0) AS kda_clamped, "
    "round_even(assists / 32, 4) AS assist_share, ln(1 + cs_total) AS log_cs, "
    "CASE WHEN deaths = 0 THEN 0.0 ELSE kills / deaths END AS kill_ratio, "
    "coalesce(opp_kills, 0) + coalesce(opp_assists, 0) AS opp_involvement FROM sessions",
    "kda", "opp_kda", "cs_per_min", "kda_clamped", "assist_share", "log_cs", "kill_ratio"))
def _sr(s, sf):
    se = T2(s, sf)[0]
    k = S.kda("kills", "deaths", "assists")
    return se.select("match_id", k.alias("kda"), S.kda("opp_kills", "opp_deaths", "opp_assists").alias("opp_kda"),
                     S.per_minute("cs_total", "game_duration_sec").alias("cs_per_min"),
                     S.clamp(k, 0.5, 5.0).alias("kda_clamped"),
                     S.round_half_even(F.col("assists") / 32, 4).alias("assist_share"),
                     F.log1p("cs_total").alias("log_cs"),
                     S.safe_ratio("kills", "deaths").alias("kill_ratio"),
                     S.sum_missing_zero("opp_kills", "opp_assists").alias("opp_involvement"))


@register("scalar_text", R(
    "SELECT match_id, coalesce(nullif(CASE WHEN kills % 3 = 0 THEN '' ELSE lane END, ''), "
    "nullif(team_position, '')) AS position, "
    "printf('GAME_%04d', vision_score) AS short_id, printf('GAME_%04d', vision_score * 1000) AS long_id, "
    "nullif(trim(split_part(handle, '#', 1)), '') AS handle_name, "
    "coalesce(nullif(trim(CASE WHEN kills % 2 = 0 THEN 'XY' END), ''), "
    "nullif(trim(CASE WHEN instr(handle, '#') > 0 THEN substr(handle, instr(handle, '#') + 1) END), '')) "
    "AS handle_tag, (kills % 5 <> 0 AND (kills % 2 = 0 OR kills % 7 <> 0)) AS handle_ok FROM (SELECT *, CASE WHEN kills % 5 = 0 "
    "THEN ' ' ELSE ' ' || champion_name END || CASE WHEN kills % 7 = 0 THEN ' #' ELSE ' #' || puuid || '#x' END AS handle "
    "FROM sessions) s"))
def _stx(s, sf):
    se = T2(s, sf)[0].withColumn(
        "handle", F.concat(F.lit(" "), F.when(F.col("kills") % 5 != 0, F.col("champion_name")).otherwise(F.lit("")), F.lit(" #"),
                           F.when(F.col("kills") % 7 != 0, F.concat("puuid", F.lit("#x"))).otherwise(F.lit(""))))
    h = S.split_handle("handle", F.when(F.col("kills") % 2 == 0, F.lit("XY")))
    return se.select("match_id",
                     S.first_present(F.when(F.col("kills") % 3 == 0, F.lit("")).otherwise(F.col("lane")),
                                     "team_position").alias("position"),
                     S.padded_id("GAME_", "vision_score").alias("short_id"),
                     S.padded_id("GAME_", F.col("vision_score") * 1000).alias("long_id"),
                     h["name"].alias("handle_name"), h["tag"].alias("handle_tag"),
                     h["valid"].alias("handle_ok"))


@register("scalar_cut", R(
    "SELECT match_id, CASE WHEN kills > deaths THEN 'ahead' WHEN deaths > kills + 5 THEN 'behind' "
    "WHEN assists > 0 THEN 'support' ELSE 'even' END AS label, CASE "
    + " ".join(f"WHEN share >= {lo} AND share < {hi} THEN '{lab}'"
               for lo, hi, lab in zip(X.FORM_EDGES[:-1], X.FORM_EDGES[1:], X.FORM_LABELS))
    + " END AS share_bucket FROM (SELECT *, kills / greatest(kills + deaths, 1) AS share FROM sessions) x"))
def _sc(s, sf):
    se = T2(s, sf)[0]
    lab = S.first_label([(F.col("kills") > F.col("deaths"), "ahead"), (F.col("deaths") > F.col("kills") + 5, "behind"),
                         (F.col("assists") > 0, "support")], "even")
    share = F.col("kills") / F.greatest(F.col("kills") + F.col("deaths"), F.lit(1))
    return se.select("match_id", lab.alias("label"), S.cut(share, X.FORM_EDGES, X.FORM_LABELS).alias("share_bucket"))
