"""Sky cells: bounds, round trips, neighbours, against a scalar version and by properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.functions import cells, geometry


def scalar_cell(ra: float, dec: float, k: int) -> int:
    """The cell by search: the one of all cells around whose centre in face coordinates is nearest, from the definition."""
    n = 1 << k
    t, z = ra % 360 / 90, math.sin(math.radians(dec))
    if abs(z) <= 2 / 3:
        jp, jm = math.floor(n * (0.5 + t) - 0.75 * n * z), math.floor(n * (0.5 + t) + 0.75 * n * z)
        fp, fm = jp >> k, jm >> k
        face = fp | 4 if fp == fm else fp if fp < fm else fm + 8
        x, y = jm & (n - 1), n - 1 - (jp & (n - 1))
    else:
        q = min(3, math.floor(t))
        u, s = t - q, n * math.sqrt(3 * (1 - abs(z)))
        jp, jm = min(n - 1, math.floor(u * s)), min(n - 1, math.floor((1 - u) * s))
        face, x, y = (q, n - 1 - jm, n - 1 - jp) if z > 0 else (q + 8, jp, jm)
    return face * n * n + sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(k))


POINTS = [(0.0, 90.0), (0.0, -90.0), (123.0, 90.0), (0.0, 0.0), (359.999999, 0.0), (360.0, 12.0), (-10.0, 5.0), (45.0, 41.8103), (45.0, -41.8103), (90.0, 66.0), (180.0, -66.0), (269.99999, 89.9)]


def test_cells_of_hard_points_equal_the_scalar_version(spark):
    df = spark.createDataFrame(POINTS, "ra double, dec double")
    for k in (0, 3, 6, 10, 14, 20):
        rows = df.select("ra", "dec", cells.ang2pix(F.col("ra"), F.col("dec"), k).alias("pix")).collect()
        assert [r.pix for r in rows] == [scalar_cell(r.ra, r.dec, k) for r in rows]


def test_null_and_nan_positions_have_no_cell(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 1.0)], "ra double, dec double")
    assert {r.pix for r in df.select(cells.ang2pix(F.col("ra"), F.col("dec"), 6).alias("pix")).collect()} == {None}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 359.99), st.floats(-90, 90)), min_size=50, max_size=200))
def test_parent_of_a_fine_cell_is_the_coarse_cell(spark, points):
    df = spark.createDataFrame(points, "ra double, dec double")
    ra, dec = F.col("ra"), F.col("dec")
    rows = df.select(cells.parent(cells.ang2pix(ra, dec, 10), 10, 6).alias("a"), cells.ang2pix(ra, dec, 6).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_centres_map_back(spark):
    df = cells.with_centre(spark.range(cells.npix(6)).withColumnRenamed("id", "pix"), "pix", 6, "ra", "dec")
    assert cells.with_cell(df, "ra", "dec", 6, "again").where("pix <> again").isEmpty()


@pytest.mark.parametrize("level", [1, 3])
def test_neighbours_are_symmetric_and_seven_or_eight(spark, level):
    rows = cells.neighbours(spark, level).collect()
    found = {(r.pix, r.nbr) for r in rows}
    assert len(found) == len(rows) and all((b, a) in found for a, b in found)
    counts = [sum(1 for a, _ in found if a == p) for p in range(cells.npix(level))]
    assert counts.count(7) == 24 and counts.count(8) == cells.npix(level) - 24


def test_neighbours_of_some_cells_equal_those_of_all(spark):
    for level in (0, 1, 2, 4):
        every = {tuple(r) for r in cells.neighbours(spark, level).collect()}
        some = spark.range(0, cells.npix(level), 1 if level < 4 else 7).withColumnRenamed("id", "pix")
        asked = {r.pix for r in some.collect()}
        assert {tuple(r) for r in cells.neighbours_of(some, level).collect()} == {p for p in every if p[0] in asked}
    fine = cells.neighbours_of(spark.range(1).select(F.lit(12345678901).alias("pix")), 20).collect()
    assert len(fine) == 8


def test_centres_on_the_driver_equal_those_of_columns(spark):
    for level in (0, 3, 5):
        at = cells.with_centre(spark.range(cells.npix(level)).withColumnRenamed("id", "pix"), "pix", level, "ra", "dec").collect()
        for r in at:
            assert cells.centre(r.pix, level) == pytest.approx((r.ra, r.dec), abs=1e-9)


def test_the_benchmark_cluster_needs_22_files(spark):
    around = {r.nbr for r in cells.neighbours(spark, 6).where(F.col("pix").isin(41425, 41427, 41428, 41429, 41430, 41433)).collect()}
    assert len(around | {41425, 41427, 41428, 41429, 41430, 41433}) == 22


def test_helpers():
    assert cells.nside(6) == 64 and cells.npix(6) == 49152
    assert cells.cell_area_deg2(0) * 12 == pytest.approx(41252.96, rel=1e-6)
    with pytest.raises(ValueError):
        cells.nside(30)


def test_separation_and_bearing(spark):
    row = spark.range(1).select(geometry.separation(F.lit(359.9), F.lit(0.0), F.lit(0.1), F.lit(0.0)).alias("s"), geometry.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("b")).first()
    assert row.s == pytest.approx(720, abs=1e-6) and row.b == pytest.approx(90)
