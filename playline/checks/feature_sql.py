"""DuckDB restatements of the feature operators (used as oracles).

Written independently of the Spark code: islands by row-number difference
instead of change-flag running sums, offset lookups as self-joins instead of
lag/lead, top-1 by row_number instead of a struct minimum.
"""

from __future__ import annotations


def feature_ctes(std_mult: float = 1.5) -> str:
    return f"""
anchor AS (
  SELECT match_id, gold AS anchor_gold, timestamp_min AS anchor_tick FROM (
    SELECT match_id, gold, timestamp_min,
           row_number() OVER (PARTITION BY match_id ORDER BY abs(timestamp_min - 14), timestamp_min) AS rn
    FROM scoped_ticks WHERE timestamp_min BETWEEN 12 AND 16) x
  WHERE rn = 1
),
sw0 AS (SELECT s.match_id, s.win, a.anchor_gold FROM scoped s JOIN anchor a ON a.match_id = s.match_id),
sw AS (
  SELECT match_id, win, anchor_gold AS gold_at_14, anchor_gold - m AS gold_delta,
         (anchor_gold - m >= 300 AND NOT win) AS is_throw,
         (anchor_gold - m <= -300 AND win) AS is_comeback
  FROM sw0, (SELECT avg(anchor_gold) AS m FROM sw0) mm
),
base_gold AS (SELECT timestamp_min, avg(gold) AS avg_gold FROM scoped_ticks GROUP BY timestamp_min),
ic0 AS (
  SELECT d.match_id, d.death_number, d.timestamp_min, d.gold_at_death,
         CAST(coalesce(d.gold_at_death, 0) AS DOUBLE) - coalesce(b.avg_gold, 0.0) AS gold_lead_approx,
         CAST(d.gold_at_death AS DOUBLE) - b.avg_gold AS lead_unknown,
         lag(d.timestamp_min) OVER (PARTITION BY d.match_id ORDER BY d.death_number) AS prev_min,
         a.anchor_gold
  FROM scoped_incidents d
  LEFT JOIN base_gold b ON b.timestamp_min = d.timestamp_min
  LEFT JOIN anchor a ON a.match_id = d.match_id
),
ic AS (
  SELECT match_id, death_number, timestamp_min, gold_at_death, gold_lead_approx,
         (gold_lead_approx > 300 AND timestamp_min <= 14) AS is_overextension_ahead,
         (gold_lead_approx < -300 AND timestamp_min <= 14) AS is_deficit_fight,
         (timestamp_min < 6) AS is_early_death,
         coalesce(timestamp_min - prev_min <= 3, false) AS is_tilt_spiral,
         coalesce(timestamp_min > 14 AND anchor_gold > (SELECT avg(anchor_gold) FROM anchor) + 300, false)
           AS is_post_laning_throw,
         lead_unknown
  FROM ic0
),
ex_rate AS (SELECT coalesce(avg(cs_per_min), 0.0) AS rate FROM scoped),
ex_load AS (SELECT * FROM scoped_ticks WHERE timestamp_min BETWEEN 3 AND 16),
ex_base AS (
  SELECT timestamp_min, avg(cs) AS avg_cs, stddev_samp(cs) AS std_cs
  FROM ex_load WHERE timestamp_min BETWEEN 4 AND 14 GROUP BY timestamp_min
),
ex_mode AS (
  SELECT match_id, bool_or(position_x IS NOT NULL) AS pos_mode
  FROM ex_load WHERE timestamp_min BETWEEN 4 AND 14 GROUP BY match_id
),
ex_flag AS (
  SELECT l.match_id, l.timestamp_min,
         CASE WHEN m.pos_mode
              THEN (l.position_x IS NOT NULL AND l.position_y IS NOT NULL AND abs(l.position_x - l.position_y) >= 2500)
              ELSE coalesce(l.cs < b.avg_cs - {std_mult} * coalesce(b.std_cs, 0.0), false) END AS roaming
  FROM ex_load l JOIN ex_mode m ON m.match_id = l.match_id
  LEFT JOIN ex_base b ON b.timestamp_min = l.timestamp_min
  WHERE l.timestamp_min BETWEEN 4 AND 14
),
ex_isl AS (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY timestamp_min)
          - row_number() OVER (PARTITION BY match_id, roaming ORDER BY timestamp_min) AS isl
  FROM ex_flag
),
ex_runs AS (
  SELECT match_id, isl, min(timestamp_min) AS s, max(timestamp_min) AS e
  FROM ex_isl WHERE roaming GROUP BY match_id, isl HAVING count(*) >= 2
),
ex1 AS (
  SELECT r.match_id, r.s AS roam_start_min, r.e AS roam_end_min,
         CAST(coalesce(pb.cs, 0) AS INTEGER) AS cs_before,
         CAST(coalesce(pa.cs, pe.cs) AS INTEGER) AS cs_after,
         (r.e - r.s + 1) * x.rate AS expected_cs_delta,
         CAST(greatest(pe.kills - coalesce(pb.kills, 0), 0) AS INTEGER) AS kills_during_roam
  FROM ex_runs r CROSS JOIN ex_rate x
  LEFT JOIN ex_load pb ON pb.match_id = r.match_id AND pb.timestamp_min = r.s - 1
  LEFT JOIN ex_load pa ON pa.match_id = r.match_id AND pa.timestamp_min = r.e + 1
  JOIN ex_load pe ON pe.match_id = r.match_id AND pe.timestamp_min = r.e
),
ex AS (
  SELECT match_id, roam_start_min, roam_end_min, cs_before, cs_after, expected_cs_delta,
         greatest(expected_cs_delta - (cs_after - cs_before), 0.0) AS cs_sacrifice,
         kills_during_roam,
         CASE WHEN kills_during_roam > 0 THEN 'impact' ELSE 'no_impact' END AS roam_result
  FROM ex1
),
rf AS (
  SELECT match_id, puuid, game_datetime, win,
         least(greatest(coalesce(avg(CASE WHEN win THEN 1.0 ELSE 0.0 END) OVER (
             PARTITION BY puuid ORDER BY game_datetime, match_id
             ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.5), 0.0), 1.0) AS tilt_index,
         row_number() OVER (PARTITION BY puuid ORDER BY game_datetime, match_id) AS game_number
  FROM scoped
),
ia AS (
  SELECT match_id, CAST(count(*) AS INTEGER) AS total_deaths,
         CAST(sum(CASE WHEN is_overextension_ahead THEN 1 ELSE 0 END) AS INTEGER) AS deaths_while_ahead,
         round_even(sum(CASE WHEN is_tilt_spiral THEN 1 ELSE 0 END) / greatest(count(*), 1), 4) AS tilt_spiral_ratio
  FROM ic GROUP BY match_id
),
streak AS (
  SELECT match_id, CAST(max(n) AS INTEGER) AS max_death_streak FROM (
    SELECT match_id, isl, count(*) AS n FROM (
      SELECT match_id, is_tilt_spiral,
             row_number() OVER (PARTITION BY match_id ORDER BY death_number)
           - row_number() OVER (PARTITION BY match_id, is_tilt_spiral ORDER BY death_number) AS isl
      FROM ic) y
    WHERE is_tilt_spiral GROUP BY match_id, isl) z
  GROUP BY match_id
),
ea AS (
  SELECT match_id, CAST(count(*) AS INTEGER) AS total_roams, avg(cs_sacrifice) AS avg_cs_sacrifice,
         avg(CASE WHEN kills_during_roam > 0 THEN 1.0 ELSE 0.0 END) AS roam_impact_rate
  FROM ex GROUP BY match_id
),
fm AS (
  SELECT s.match_id, s.win, s.game_datetime, s.champion_name, rf.tilt_index,
         CAST(hour(s.game_datetime) AS INTEGER) AS hour_of_day,
         CAST(isodow(s.game_datetime) - 1 AS INTEGER) AS day_of_week,
         isodow(s.game_datetime) IN (6, 7) AS is_weekend,
         CASE WHEN hour(s.game_datetime) BETWEEN 6 AND 11 THEN 'morning'
              WHEN hour(s.game_datetime) BETWEEN 12 AND 17 THEN 'afternoon'
              WHEN hour(s.game_datetime) BETWEEN 18 AND 22 THEN 'evening'
              ELSE 'night' END AS time_bucket,
         coalesce(sw.is_throw, false) AS is_throw,
         coalesce(sw.is_comeback, false) AS is_comeback,
         coalesce(sw.gold_delta, 0.0) AS gold_delta,
         coalesce(ia.total_deaths, 0) AS total_deaths,
         coalesce(ia.deaths_while_ahead, 0) AS deaths_while_ahead,
         CAST(coalesce(ia.tilt_spiral_ratio, 0.0) AS DOUBLE) AS tilt_spiral_ratio,
         coalesce(st.max_death_streak, 0) AS max_death_streak,
         coalesce(ea.total_roams, 0) AS total_roams,
         ln(1 + coalesce(ea.avg_cs_sacrifice, 0.0)) AS avg_cs_sacrifice,
         coalesce(ea.roam_impact_rate, 0.5) AS roam_impact_rate
  FROM scoped s
  LEFT JOIN rf ON rf.match_id = s.match_id
  LEFT JOIN sw ON sw.match_id = s.match_id
  LEFT JOIN ia ON ia.match_id = s.match_id
  LEFT JOIN streak st ON st.match_id = s.match_id
  LEFT JOIN ea ON ea.match_id = s.match_id
)"""
