"""Footprints of any shape: cells, ranges and their algebra against brute force over all cells."""

import math
import random

import numpy as np
import pytest

from skyloom.functions import cells
from skyloom.operators import footprints

LEVEL = 5
CENTRES = np.array([cells.centre(p, LEVEL) for p in range(cells.npix(LEVEL))])


def unit(ra, dec):
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], -1)


def around(ra, dec, turns):
    """Positions at (angle, distance in degrees) from a centre."""
    c, out = unit(ra, dec), []
    east = np.array([-math.sin(math.radians(ra)), math.cos(math.radians(ra)), 0.0])
    north = np.cross(c, east)
    for angle, far in turns:
        side = math.sin(math.radians(angle)) * east + math.cos(math.radians(angle)) * north
        v = math.cos(math.radians(far)) * c + math.sin(math.radians(far)) * side
        out.append((math.degrees(math.atan2(v[1], v[0])) % 360, math.degrees(math.asin(max(-1, min(1, v[2]))))))
    return out


def inside_star(ra, dec, turns):
    """Cells inside a polygon that is seen whole from its centre: between two neighbouring corners, on the inner side of the edge."""
    v, p, c = unit(*np.array(around(ra, dec, turns)).T), unit(*CENTRES.T), unit(ra, dec)
    found = np.zeros(len(p), bool)
    for a, b in zip(v, np.roll(v, -1, 0), strict=True):
        side = np.sign(np.dot(np.cross(a, b), c))
        wedge = (np.sign(p @ np.cross(c, a)) == np.sign(np.dot(np.cross(c, a), b))) & (np.sign(p @ np.cross(b, c)) == np.sign(np.dot(np.cross(b, c), a)))
        found |= wedge & (np.sign(p @ np.cross(a, b)) == side) & (p @ c > 0)
    return set(np.flatnonzero(found).tolist())


STARS = {
    "plain": (80.0, 20.0, [(72 * k, 12) for k in range(5)]),
    "backwards": (200.0, -30.0, [(-72 * k, 12) for k in range(5)]),
    "north pole": (10.0, 86.0, [(60 * k, 9) for k in range(6)]),
    "south pole": (0.0, -90.0, [(90 * k, 15) for k in range(4)]),
    "crosses zero": (359.0, 5.0, [(45 * k, 10 if k % 2 else 20) for k in range(8)]),  # not convex
    "large": (120.0, 0.0, [(120 * k, 75) for k in range(3)]),
    "small": (300.0, 41.0, [(120 * k, 1.5) for k in range(3)]),
}


def polygons(spark, rows):
    return spark.createDataFrame(rows, "survey string, vertices array<struct<ra: double, dec: double>>, pix long, level int")


def cells_of(found, level=LEVEL):
    out = {}
    for r in found.collect():
        out.setdefault(r.survey, []).extend(range(r.lo, r.hi))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def ranges(spark):
    rows = [(n, around(*s), 1, 1) for n, s in STARS.items()] + [("none", None, 1, 1), ("none", [(1.0, 2.0), (2.0, 3.0)], 1, 1), ("none", [(1.0, None), (2.0, 3.0), (4.0, 9.0)], 1, 1), ("none", [(1.0, math.inf), (2.0, 3.0), (4.0, 9.0)], 1, 1)]
    return footprints.as_ranges(footprints.polygon_cells(polygons(spark, rows), LEVEL), LEVEL).cache()


def test_polygons_equal_brute_force(ranges):
    want = {n: sorted(inside_star(*s)) for n, s in STARS.items()}
    assert cells_of(ranges) == {n: c for n, c in want.items() if c}


def test_discs_equal_brute_force(spark):
    rows = [("a", 0.0, 90.0, 7.0), ("b", 359.9, 3.0, 20.0), ("b", 10.0, 3.0, 5.0), ("c", 50.0, -41.8, 0.0), ("sky", 1.0, 1.0, 200.0), ("d", None, 1.0, 3.0), ("e", math.nan, 1.0, 3.0), ("f", 1.0, 1.0, -1.0), ("half", 77.0, -12.0, 90.0)]
    got = cells_of(footprints.as_ranges(footprints.disc_cells(spark.createDataFrame(rows, "survey string, ra double, dec double, radius double"), LEVEL), LEVEL))
    p, want = unit(*CENTRES.T), {}
    for name, ra, dec, radius in rows:
        if ra is not None and radius >= 0 and ra == ra:
            c = unit(ra, dec)
            away = np.degrees(np.arctan2(np.linalg.norm(np.cross(p, c), axis=1), p @ c))
            want.setdefault(name, set()).update(np.flatnonzero(away <= radius).tolist())
    assert got == {k: sorted(v) for k, v in want.items() if v}


def test_multi_order_sets_are_small_and_go_back_to_their_ranges(spark, ranges):
    found = footprints.as_cells(ranges, LEVEL)
    assert found.count() < sum(len(inside_star(*s)) for s in STARS.values()) / 2
    assert found.groupBy("survey", "level", "pix").count().where("count > 1").isEmpty()
    assert cells_of(footprints.as_ranges(found, LEVEL)) == cells_of(ranges)
    for r in ranges.collect():
        assert r.lo >> 2 * (LEVEL - footprints.SECTION_LEVEL) == r.hi - 1 >> 2 * (LEVEL - footprints.SECTION_LEVEL)


@pytest.mark.parametrize("kind", footprints.KINDS)
def test_algebra_equals_sets(spark, kind):
    rng = random.Random(4)
    sides = []
    for _ in range(2):
        starts = [(f"s{rng.randrange(3)}", rng.randrange(0, 3000)) for _ in range(60)]
        sides.append([(s, lo, lo + rng.choice([0, 1, 5, 40, 700])) for s, lo in starts] + [("both", 16, 4000), ("both", 7, 7)])
    left, right = (spark.createDataFrame(s, "survey string, lo long, hi long") for s in sides)
    a, b = ({s: {x for n, lo, hi in side if n == s for x in range(lo, hi)} for s in ("s0", "s1", "s2", "both")} for side in sides)
    op = {"union": set.union, "intersection": set.intersection, "difference": set.difference}[kind]
    want = {s: sorted(op(a[s], b[s])) for s in a}
    assert cells_of(footprints.combine(left, right, LEVEL, kind)) == {s: c for s, c in want.items() if c}
    assert footprints.combine(left.limit(0), right.limit(0), LEVEL, kind).isEmpty()


def test_positions_and_coarse_cells_within(spark, ranges):
    points = spark.createDataFrame([(i, p, "x") for i, p in enumerate(range(0, cells.npix(LEVEL), 7))] + [(-1, None, "x")], "id long, cell long, level string")
    got = {(r.cell, r.survey) for r in footprints.within(points, ranges, LEVEL, "cell").collect()}
    want = {(p, n) for n, s in STARS.items() for p in inside_star(*s) if p % 7 == 0}
    assert got == want
    share = {(r.survey, r.pix): r.fraction for r in footprints.covered(ranges, LEVEL, 3).collect()}
    for n, s in STARS.items():
        inside = inside_star(*s)
        for pix in {p >> 4 for p in inside}:
            assert share.pop((n, pix)) == sum(p >> 4 == pix for p in inside) / 16
    assert not share
