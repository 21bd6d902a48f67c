"""Property test: skew-safe numbering equals row_number for random layouts."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from playline.operators.sequence import number_rows


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(sizes=st.lists(st.integers(min_value=1, max_value=400), min_size=1, max_size=5),
       parts=st.integers(min_value=1, max_value=13), dup=st.integers(min_value=1, max_value=50))
def test_number_rows_property(spark, sizes, parts, dup):
    rows = [(f"g{g}", (i * 7919) % dup, i) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "grp string, ts int, id int")
    got = number_rows(df, ["grp"], ["ts", "id"], out="n", num_partitions=parts)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("ts", "id")).cast("long"))
    assert got.count() == len(rows)
    assert got.exceptAll(want).count() == 0


def test_hexagons_hold_the_points_nearest_their_centre(spark):
    from playline.operators.explore import hexagon
    points = [(x, y) for x in range(-40, 900, 61) for y in range(-30, 900, 67)] + [(0, 0), (50, 0), (100, 0), (None, 3)]
    got = spark.createDataFrame(points, "x int, y int").select("x", "y", *[c.alias(n) for c, n in zip(
        hexagon("x", "y", 100.0), ("q", "r", "cx", "cy"))]).collect()
    centre = lambda q, r: ((q + r / 2) * 100.0, r * 50.0 * 3 ** 0.5)
    for p in got:
        if p.x is None:
            assert p.q is None and p.cx is None
            continue
        far = lambda c: (c[0] - p.x) ** 2 + (c[1] - p.y) ** 2  # noqa: E731, B023
        best = min(far(centre(q, r)) for q in range(-12, 14) for r in range(-3, 14))
        assert abs(far((p.cx, p.cy)) - best) < 1e-6
        assert max(abs(a - b) for a, b in zip(centre(p.q, p.r), (p.cx, p.cy))) < 1e-6
