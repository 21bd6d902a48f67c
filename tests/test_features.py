"""Feature operators on the small hand-made season of conftest (goldens worked out by hand there)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from playline.operators import features as FT
from tests.conftest import CFG, day, fixture_tables, gold_at, session_row, tick_row

SEASON = ["n1", "n2", "n3", "n4", "n5"]


def by_id(df):
    return {r["match_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def season(spark):
    return fixture_tables(spark)


@pytest.fixture(scope="module")
def matrix(season):
    return FT.feature_matrix(*season, CFG).cache()


def test_only_season_sessions_of_the_role_are_in_scope(spark):
    other = [session_row("side", day(5), True, role="BOTTOM"), session_row("alone", day(6), False, rival=None)]
    tables = fixture_tables(spark, extra_sessions=other)
    assert sorted(by_id(FT.feature_matrix(*tables, CFG))) == sorted([*SEASON, "alone"])
    pair = FT.rival_matchups(tables[0], CFG).collect()
    # five season sessions against Flint; the one without a rival and the one of another role don't count
    assert [(r.champion_name, r.opp_champion_name, r.games) for r in pair] == [("Mote", "Flint", 5)]
    assert pair[0].our_winrate == pytest.approx(0.6) and pair[0].cs_diff == pytest.approx(6.0)


def test_swing_games(season):
    sw = by_id(FT.swing_games(season[0], season[1], CFG))
    mean = gold_at(14) + (900 - 800) / 5
    assert sw["n4"].gold_delta == pytest.approx(gold_at(14) + 900 - mean) == pytest.approx(880)
    assert sw["n5"].gold_delta == pytest.approx(-820)
    assert [m for m in SEASON if sw[m].is_throw] == ["n4"] and [m for m in SEASON if sw[m].is_comeback] == ["n5"]
    assert {sw[m].gold_delta for m in ("n1", "n2", "n3")} == {-20.0}


def test_form_before_each_session(season):
    form = by_id(FT.rolling_form(season[0], CFG))
    assert [round(form[m].tilt_index, 4) for m in SEASON] == [0.5, 0.0, 0.5, 0.6667, 0.5]
    assert [form[m].game_number for m in SEASON] == [1, 2, 3, 4, 5]


def test_excursion_by_position(spark):
    away = {"position_x": 11000, "position_y": 5500}
    se, ti, _ = fixture_tables(spark, tick_updates={("n2", 8): away, ("n2", 9): away, ("n3", 6): away})
    got = [(r.match_id, r.roam_start_min, r.roam_end_min, r.cs_before, r.cs_after) for r in FT.excursions(se, ti, CFG).collect()]
    assert got == [("n2", 8, 9, 49, 70)]  # one tick alone is too short


def test_excursion_by_lost_income(spark):
    upd = {("n3", t): {"position_x": None, "position_y": None} for t in range(19)}
    for t in (8, 9):
        upd[("n3", t)] = {"position_x": None, "position_y": None, "cs": 0}
    se, ti, _ = fixture_tables(spark, tick_updates=upd)
    r, = FT.excursions(se, ti, CFG).collect()
    assert (r.match_id, r.roam_start_min, r.roam_end_min, r.roam_result) == ("n3", 8, 9, "no_impact")
    assert (r.cs_before, r.cs_after) == (49, 70)
    assert r.expected_cs_delta == pytest.approx(2 * 5.5) and r.cs_sacrifice == 0.0


def test_excursion_runs_over_the_rows_that_exist(spark):
    away = {"position_x": 11000, "position_y": 5500, "kills": 2}
    se, ti, _ = fixture_tables(spark, tick_updates={("n1", 9): away, ("n1", 11): away})
    r, = FT.excursions(se, ti.where("match_id <> 'n1' OR timestamp_min <> 10"), CFG).collect()
    assert (r.roam_start_min, r.roam_end_min, r.kills_during_roam, r.roam_result) == (9, 11, 2, "impact")
    assert r.expected_cs_delta == pytest.approx(3 * 5.5)


def test_incident_features(matrix):
    fm = by_id(matrix)
    assert [fm[m].total_deaths for m in SEASON] == [4, 0, 4, 3, 2]
    assert [fm[m].tilt_spiral_ratio for m in SEASON] == [0.5, 0.0, 0.5, 0.3333, 0.5]
    assert [fm[m].max_death_streak for m in SEASON] == [1, 0, 2, 1, 1]
    assert [fm[m].deaths_while_ahead for m in SEASON] == [0, 0, 0, 1, 0]


def test_matrix_is_complete(matrix):
    assert len(matrix.columns) == 19 and matrix.columns[0] == "match_id"
    assert matrix.select([F.count_if(F.col(c).isNull()).alias(c) for c in matrix.columns]).first().asDict() == {
        c: 0 for c in matrix.columns}
    rows = by_id(matrix)
    assert all(r.hour_of_day == 20 and r.avg_cs_sacrifice == 0.0 and r.roam_impact_rate == 0.5 for r in rows.values())
    assert [rows[m].day_of_week for m in SEASON] == [0, 3, 6, 2, 5]
    assert [rows[m].is_weekend for m in SEASON] == [False, False, True, False, True]


def test_incident_context(season):
    got = {(r.match_id, r.death_number): r for r in FT.incident_context(*season, CFG).collect()}
    assert not any(m == "old" for m, _ in got)
    assert [k for k, r in sorted(got.items()) if r.is_overextension_ahead] == [("n4", 2)]
    assert [k for k, r in sorted(got.items()) if r.is_deficit_fight] == [("n5", 2)]
    assert [k for k, r in sorted(got.items()) if r.is_post_laning_throw] == [("n4", 3)]
    assert [k for k, r in sorted(got.items()) if r.is_tilt_spiral] == [("n1", 2), ("n1", 4), ("n3", 2), ("n3", 3), ("n4", 3), ("n5", 2)]
    assert [k for k, r in sorted(got.items()) if r.is_early_death] == [("n1", 1), ("n1", 2), ("n4", 1)]
    assert got[("n4", 2)].gold_lead_approx == pytest.approx(880) and got[("n5", 2)].gold_lead_approx == pytest.approx(-820)


def test_lead_exactly_at_the_threshold_is_not_ahead(spark):
    """Five sessions, one raised by 375: the lead over the mean is 375 * 4 / 5 = 300."""
    se, ti, de = fixture_tables(spark, tick_updates={("n1", 4): {"gold": gold_at(4) + 375}})
    r = {(r.match_id, r.death_number): r for r in FT.incident_context(se, ti, de, CFG).collect()}[("n1", 2)]
    assert r.gold_lead_approx == pytest.approx(300) and not r.is_overextension_ahead


def test_unknown_snapshots(season):
    se, ti, de = season
    de = de.withColumn("gold_at_death", F.when(F.col("match_id") != "n3", F.col("gold_at_death")))
    zero = {(r.match_id, r.death_number): r for r in FT.incident_context(se, ti, de, CFG).collect()}
    unknown = {(r.match_id, r.death_number): r for r in FT.incident_context(se, ti, de, CFG, "unknown").collect()}
    assert zero[("n3", 1)].is_deficit_fight and zero[("n3", 1)].gold_lead_approx == -gold_at(6)
    assert unknown[("n3", 1)].gold_lead_approx is None and unknown[("n3", 1)].is_deficit_fight is None
    assert tick_row("n3", 6)[2] == gold_at(6)
