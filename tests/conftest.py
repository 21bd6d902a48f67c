from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from playline.config import AnalysisConfig  # noqa: E402
from playline.schemas import INCIDENTS_SCHEMA, TICKS_SCHEMA, sessions_schema  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from playline.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s


CFG = AnalysisConfig()
LAST_TICK = 18
OLD = dt.datetime(2025, 11, 3, 9, 30)


def day(n: int) -> dt.datetime:
    return dt.datetime(2026, 2, 2, 20, 15) + dt.timedelta(days=3 * n)


def gold_at(tick: int) -> int:
    return 400 + 310 * tick


def session_row(mid, when, win, champ="Mote", role="MIDDLE", rival="Flint", kills=4, deaths=3, assists=7, cs=154):
    rival_part = (rival, 148, 9400, 3, 4, 6) if rival else (None,) * 6
    return (mid, "u-7", when, "16.3", 420, 1680, 11, champ, 200, role, role, win, kills, deaths, assists,
            (kills + assists) / max(deaths, 1), cs, 5.5, 10250, 17300, 21, *rival_part)


# Own design: "old" lies before the season; n1..n5 go loss, win, win, loss, win.
SESSIONS = [("old", OLD, True), ("n1", day(0), False), ("n2", day(1), True), ("n3", day(2), True),
            ("n4", day(3), False), ("n5", day(4), True)]
# From tick 10 on n4 is 900 ahead of the common line and n5 800 behind it.
SHIFT = {"n4": 900, "n5": -800}
INCIDENT_TICKS = {"old": [4], "n1": [2, 4, 10, 13], "n2": [], "n3": [6, 7, 8, 16], "n4": [1, 14, 15], "n5": [9, 12]}


def tick_row(mid, t):
    gold = gold_at(t) + (SHIFT.get(mid, 0) if t >= 10 else 0)
    return [mid, t, gold, 7 * t, 90 * t, 0, 6000 + 20 * t, 6000 + 20 * t]


def fixture_tables(spark, extra_sessions=(), tick_updates=None, extra_ticks=()):
    """(sessions, ticks, incidents); ``tick_updates`` overrides columns of (session, tick)."""
    columns = TICKS_SCHEMA.fieldNames()
    ticks = {(m, t): tick_row(m, t) for m, _, _ in SESSIONS for t in range(LAST_TICK + 1)}
    for r in extra_ticks:
        ticks[(r[0], r[1])] = list(r)
    for key, new in (tick_updates or {}).items():
        for name, value in new.items():
            ticks[key][columns.index(name)] = value
    incidents = [(m, n + 1, t * 60_000 + 500, t, ticks[(m, t)][2], ticks[(m, t)][3])
                 for m, ts in INCIDENT_TICKS.items() for n, t in enumerate(ts)]
    rows = [session_row(*s) for s in SESSIONS] + list(extra_sessions)
    return (spark.createDataFrame(rows, sessions_schema()),
            spark.createDataFrame([tuple(v) for v in ticks.values()], TICKS_SCHEMA),
            spark.createDataFrame(incidents, INCIDENTS_SCHEMA))
