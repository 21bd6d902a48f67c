"""Independent DuckDB formulations of every SQL-expressible query.

Each string runs on the driver's pre-registered views (``events`` etc.).
The adapter is restated here row by row (running window sums over raw
events), not with the Spark side's pre-aggregation, so a bug in one
formulation shows up as a mismatch.
"""

from __future__ import annotations

SEASON = "TIMESTAMP '2024-01-06 00:00:00'"

ADAPTER_CTES = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us
  FROM events
),
ev2 AS (
  SELECT *,
         us // 432000000000 AS blk,
         us % 432000000000 AS off_us,
         CAST((us % 432000000000) // 21600000000 AS INTEGER) AS tick,
         CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(user_id AS VARCHAR) || '-' || CAST(us // 432000000000 AS VARCHAR) AS match_id
  FROM ev
),
own AS (
  SELECT user_id, blk, min(ts) AS start_ts, min(us) AS us_min, max(us) AS us_max,
         CAST(count(*) FILTER (WHERE event_type = 'purchase') AS INTEGER) AS kills,
         CAST(count(*) FILTER (WHERE event_type = 'error') AS INTEGER) AS deaths,
         CAST(count(*) FILTER (WHERE event_type = 'signup') AS INTEGER) AS assists,
         CAST(count(*) FILTER (WHERE event_type IN ('view', 'click')) AS INTEGER) AS cs_total,
         CAST(sum(cents) AS BIGINT) AS gold_earned,
         CAST(sum(k) AS BIGINT) AS damage,
         CAST(count(*) AS INTEGER) AS n_events
  FROM ev2 GROUP BY user_id, blk
),
base AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || CAST(blk AS VARCHAR) AS match_id, user_id, blk,
         CAST(user_id AS VARCHAR) AS puuid,
         start_ts AS game_datetime,
         '16.' || CAST(((user_id + blk) % 12) + 1 AS VARCHAR) AS game_version,
         420 AS queue_id,
         CAST((us_max - us_min) // 1000000 AS INTEGER) AS game_duration_sec,
         CAST(user_id % 7 AS INTEGER) AS champion_id,
         'C' || CAST(user_id % 7 AS VARCHAR) AS champion_name,
         CAST(100 + 100 * (user_id % 2) AS INTEGER) AS team_id,
         CASE WHEN (user_id + blk) % 4 = 3 THEN 'BOTTOM' ELSE 'MIDDLE' END AS team_position,
         CASE WHEN (user_id + blk) % 4 = 3 THEN 'BOTTOM' ELSE 'MIDDLE' END AS lane,
         kills >= deaths AS win, kills, deaths, assists,
         CAST((kills + assists) AS DOUBLE) / greatest(deaths, 1) AS kda,
         cs_total,
         CASE WHEN (us_max - us_min) // 1000000 > 0
              THEN cs_total / (((us_max - us_min) // 1000000) / 60.0) ELSE 0.0 END AS cs_per_min,
         gold_earned, damage AS damage_dealt_to_champions, n_events AS vision_score
  FROM own
),
sessions AS (
  SELECT b.match_id, b.puuid, b.game_datetime, b.game_version, b.queue_id, b.game_duration_sec,
         b.champion_id, b.champion_name, b.team_id, b.team_position, b.lane, b.win,
         b.kills, b.deaths, b.assists, b.kda, b.cs_total, b.cs_per_min, b.gold_earned,
         b.damage_dealt_to_champions, b.vision_score,
         r.champion_name AS opp_champion_name, r.cs_total AS opp_cs_total,
         r.gold_earned AS opp_gold_earned, r.kills AS opp_kills, r.deaths AS opp_deaths,
         r.assists AS opp_assists
  FROM base b LEFT JOIN base r ON r.user_id = xor(b.user_id, 1) AND r.blk = b.blk
),
ev_run AS (
  SELECT match_id, tick, ts, event_id, event_type, user_id, k,
         sum(cents) OVER w AS r_gold,
         sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER w AS r_cs,
         count(*) OVER w AS r_xp,
         sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS r_kills
  FROM ev2
  WINDOW w AS (PARTITION BY match_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
tick_last AS (
  SELECT *, row_number() OVER (PARTITION BY match_id, tick ORDER BY ts DESC, event_id DESC) AS rn
  FROM ev_run WHERE event_type <> 'error'
),
ticks AS (
  SELECT match_id, tick AS timestamp_min,
         CAST(r_gold AS BIGINT) AS gold, CAST(r_cs AS INTEGER) AS cs,
         CAST(r_xp AS INTEGER) AS xp, CAST(r_kills AS INTEGER) AS kills,
         CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(k * 150 AS INTEGER) END AS position_x,
         CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(((event_id * 37) % 100) * 150 AS INTEGER) END AS position_y
  FROM tick_last WHERE rn = 1
),
incidents AS (
  SELECT e.match_id,
         CAST(row_number() OVER (PARTITION BY e.match_id ORDER BY e.ts, e.event_id) AS INTEGER) AS death_number,
         CAST(e.off_us // 1000 AS BIGINT) AS timestamp_ms,
         e.tick AS timestamp_min,
         t.gold AS gold_at_death, t.cs AS cs_at_death
  FROM ev2 e LEFT JOIN ticks t ON t.match_id = e.match_id AND t.timestamp_min = e.tick
  WHERE e.event_type = 'error'
),
scoped AS (
  SELECT * FROM sessions WHERE game_datetime >= TIMESTAMP '2024-01-06 00:00:00' AND team_position = 'MIDDLE'
),
scoped_ticks AS (
  SELECT t.* FROM ticks t JOIN scoped s ON s.match_id = t.match_id
),
scoped_incidents AS (
  SELECT d.* FROM incidents d JOIN scoped s ON s.match_id = d.match_id
),
labels_fixed AS (
  SELECT match_id, CAST(CAST(puuid AS BIGINT) % 4 AS INTEGER) AS cluster_id FROM scoped
)"""


def q(body: str, extra_ctes: str = "") -> str:
    """Wrap a final SELECT (and optional extra CTEs) with the adapter CTEs."""
    ctes = ADAPTER_CTES + ("," + extra_ctes if extra_ctes.strip() else "")
    return "WITH " + ctes + "\n" + body
