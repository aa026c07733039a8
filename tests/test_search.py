"""Groups against brute force, over the whole sky and at its hard places."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.contracts import SearchConfig
from skyloom.functions import cells, geometry
from skyloom.operators import scoring, search


def stars(spark, rows):
    return spark.createDataFrame([(i, float(ra), float(dec), 12.0 + i % 5) for i, (ra, dec) in enumerate(rows)], "gaia_id long, ra double, dec double, mag double")


def brute(rows, radius):
    def vec(ra, dec):
        a, d = math.radians(ra), math.radians(dec)
        return np.array([math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)])

    v = np.array([vec(*r) for r in rows])
    limit = 2 * math.sin(math.radians(radius / 3600) / 2)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    return {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if d[i, j] <= limit}


@pytest.fixture(scope="module")
def hard_sky():
    rng = np.random.default_rng(1)
    rows = [(rng.uniform(0, 360), 90 - abs(rng.normal(0, 0.3))) for _ in range(60)]
    rows += [(rng.uniform(0, 360), -90 + abs(rng.normal(0, 0.3))) for _ in range(60)]
    rows += [((rng.normal(0, 0.3)) % 360, rng.normal(0, 0.3)) for _ in range(60)]
    return rows + [(10.0, 10.0), (10.0, 10.0)]


def test_pairs_equal_brute_force_at_poles_and_wrap(spark, hard_sky):
    got = search.pairs(stars(spark, hard_sky), 600.0).select("g1", "g2").collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(hard_sky, 600.0)


def test_triples_equal_brute_force(spark, hard_sky):
    close = brute(hard_sky, 900.0)
    want = {(i, j, k) for i, j in close for k in range(j + 1, len(hard_sky)) if (i, k) in close and (j, k) in close}
    found = search.triples(search.pairs(stars(spark, hard_sky), 900.0), 900.0)
    assert {tuple(r) for r in found.select("g1", "g2", "g3").collect()} == want


def test_pairs_with_null_positions_and_none_at_all(spark):
    some = stars(spark, [(1, 1), (1, 1)]).unionByName(spark.createDataFrame([(9, None, 1.0, 1.0)], "gaia_id long, ra double, dec double, mag double"))
    assert search.pairs(some, 10.0).count() == 1 and search.pairs(some.limit(0), 10.0).isEmpty()


def test_greedy_suppression_equals_a_loop(spark, hard_sky):
    cfg = SearchConfig(sizes=(1,), radius_arcsec=600.0)
    groups = scoring.HeuristicScorer().score(search.candidates(stars(spark, hard_sky), cfg)).cache()
    close = brute(hard_sky, 600.0)
    order = sorted(groups.select("g1", "score").collect(), key=lambda r: (-r.score, r.g1))
    kept = []
    for r in order:
        if not any((min(r.g1, k), max(r.g1, k)) in close for k in kept):
            kept.append(r.g1)
    got = search.suppress_greedy(groups, 600.0, written=lambda df: df.cache())
    assert {r.g1 for r in got.select("g1").collect()} == set(kept)
    once = {r.g1 for r in search.suppress(groups, 600.0).select("g1").collect()}
    assert once <= set(kept)


def test_greedy_suppression_of_a_crowd_makes_no_overlaps(spark, tmp_path, monkeypatch):
    from skyloom.sources.work import Work

    monkeypatch.setattr(search, "overlaps", None)  # whose rows grow with the square of a crowd
    crowd = spark.range(3000).selectExpr("id as g1", "cast(null as long) as g2", "cast(null as long) as g3", "10 + id % 50 / 1e5 as ra", "id / 1e7 as dec", "cast(id % 7 as double) as score")
    got = search.suppress_greedy(crowd, 60.0, Work(spark, str(tmp_path)).write)
    assert [r.g1 for r in got.collect()] == [6]  # the best score, then the least id


def test_coverage_at_a_pole_has_the_nearest_cells(spark):
    group = spark.createDataFrame([(1, None, None, 0.0, 90.0)], "g1 long, g2 long, g3 long, ra double, dec double")
    assert search.coverage(group, 6, 2700.0).count() == 4


def test_coverage_equals_the_distance_to_every_centre(spark):
    places = [(0.0, 0.0), (45.0, 0.0), (44.98, 41.81), (90.0, 41.81), (0.01, 89.9), (200.0, -89.95), (135.0, 60.0), (314.9, -41.8), (77.7, 23.4), (10.0, -66.6)]
    groups = spark.createDataFrame([(i, None, None, ra, dec) for i, (ra, dec) in enumerate(places)], "g1 long, g2 long, g3 long, ra double, dec double")
    at = cells.with_centre(spark.range(cells.npix(6)).withColumnRenamed("id", "pix"), "pix", 6, "ra_c", "dec_c")
    for radius in (900.0, 3600.0, 9000.0):
        near = groups.crossJoin(at).where(geometry.separation(F.col("ra"), F.col("dec"), F.col("ra_c"), F.col("dec_c")) <= radius)
        got = search.coverage(groups, 6, radius).select("g1", "pix").collect()
        assert len(got) == len(set(got)) and set(got) == set(near.select("g1", "pix").collect())


def test_batch_scorer_equals_columns(spark, hard_sky):
    groups = search.candidates(stars(spark, hard_sky[:40]), SearchConfig(radius_arcsec=1200.0, min_separation_arcsec=0.0))
    one = {tuple(r) for r in scoring.HeuristicScorer().score(groups).select("g1", "g2", "g3", F.round("score", 6)).collect()}

    def predict(batch):
        return (batch["flux"] * (batch["area"] / batch["max_side"].where(batch["max_side"] > 0, 1) ** 2).where((batch["size"] == 3) & (batch["max_side"] > 0), 1.0)).round(9)

    two = scoring.BatchScorer("x", ("size", "flux", "area", "max_side"), predict).score(groups)
    assert {tuple(r) for r in two.select("g1", "g2", "g3", F.round("score", 6)).collect()} == one


def test_cross_match_equals_brute_force(spark):
    import math
    import random

    draw = random.Random(6)
    spots = [(0.0, 89.99), (359.999, -0.001), (120.0, -45.0), (10.0, -90.0)]

    def some(n, base):
        out = [(base + i, (ra + draw.uniform(-0.02, 0.02)) % 360, max(-90.0, min(90.0, dec + draw.uniform(-0.02, 0.02)))) for i in range(n) for ra, dec in [draw.choice(spots)]]
        return [*out, (base + n, None, 1.0), (base + n + 1, 5.0, 5.0)]

    a, b = some(60, 0), some(60, 30)  # ids of both tables overlap
    a.append((99, *b[0][1:]))  # one spot in both
    got = search.cross_match(*(spark.createDataFrame(t, "id long, ra double, dec double") for t in (a, b)), 40.0).collect()

    def sep(p, q):
        if p[1] is None or q[1] is None:
            return math.inf
        s = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * math.asin(min(1.0, math.sqrt(s))) * 206264.80624709636

    want = {(p[0], q[0]): sep(p, q) for p in a for q in b if sep(p, q) <= 40.0}
    assert {(r.id1, r.id2) for r in got} == set(want) and len(want) > 50 and all(abs(r.sep - want[r.id1, r.id2]) < 1e-6 for r in got)
    best1 = {p: min((s, j) for (i, j), s in want.items() if i == p)[1] for p, _ in want}
    best2 = {q: min((s, i) for (i, j), s in want.items() if j == q)[1] for _, q in want}
    assert {(r.id1, r.id2) for r in got if r.mutual} == {(p, q) for p, q in want if best1[p] == q and best2[q] == p}


def test_groups_that_moved_are_told_with_their_way(spark):
    from skyloom.plans import build

    names = "g1 long, g2 long, g3 long, ra double, dec double, flux double"
    a = spark.createDataFrame([(1, 2, None, 10.0, 0.0, 1.0), (3, 4, None, 20.0, 0.0, 1.0), (5, 6, 7, 30.0, 0.0, 1.0), (8, None, None, 40.0, 0.0, 1.0), (9, None, None, 50.0, 0.0, None)], names)
    b = spark.createDataFrame([(1, 2, None, 10.0, 0.1, 1.0), (3, 4, None, 20.0, 0.0, 2.0), (50, 60, 70, 30.0, 1 / 3600, 1.0), (80, None, None, 41.0, 0.0, 1.0), (9, None, None, 50.0, 0.0, None)], names)
    got = {(r.difference, r.g1, r.h1, None if r.sep is None else round(r.sep, 6)) for r in build.compare_groups(a, b, 5.0, ["flux"]).collect()}
    assert got == {("changed", 3, 3, None), ("moved", 5, 50, 1.0), ("only_left", 8, None, None), ("only_right", None, 80, None)}
    assert build.compare_groups(a, a, 5.0, ["flux"]).isEmpty() and build.compare_groups(a.limit(0), b.limit(0), 5.0, ["flux"]).isEmpty()


def test_triples_of_stars_shuffle_no_pairs(spark, hard_sky):
    close = brute(hard_sky, 900.0)
    want = {(i, j, k) for i, j in close for k in range(j + 1, len(hard_sky)) if (i, k) in close and (j, k) in close}
    found = search.star_triples(stars(spark, hard_sky), 900.0)
    assert {tuple(r) for r in found.select("g1", "g2", "g3").collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "InMemory" not in plan  # the stars of either side, and nothing held


def test_best_groups_equal_the_whole_search_from_fewer_stars(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(10 + ra), float(dec), float(m)) for i, (ra, dec, m) in enumerate(zip(rng.uniform(0, 0.3, 700), rng.uniform(0, 0.3, 700), rng.uniform(8, 18, 700), strict=True))]
    rows += [(1000 + i, 50.0 + i / 1000, 1.0, 12.0) for i in range(3)]  # a cell of fewer groups than asked for
    frame = spark.createDataFrame(rows, "gaia_id long, ra double, dec double, mag double")
    scorer, names, held = scoring.HeuristicScorer(), ("outer_pix", "rank", "g1", "g2", "g3"), []
    cfg = SearchConfig(sizes=(2, 3), min_area_arcsec2=50.0, max_side_arcsec=100.0)
    keep = lambda groups: search.geom_filter(groups, cfg)
    want = {tuple(r) for r in search.top_k(scorer.score(keep(search.candidates(frame, cfg))), 5).select(*names).collect()}
    cell = min(want)[0]
    work = spark.createDataFrame([(cell,)], "outer_pix long")
    got = search.best_groups(frame, cfg, scorer, 5, work, keep, lambda df: held.append(df.cache()) or held[-1])
    assert {tuple(r) for r in got.select(*names).collect()} == {r for r in want if r[0] == cell}
    assert 0 < held[-1].count() < 350  # stars that the whole search would have paired


def test_cross_match_shuffles_points_and_no_pairs(spark):
    draw = np.random.default_rng(4)
    a, b = (spark.createDataFrame([(i, float(ra), float(dec)) for i, (ra, dec) in enumerate(draw.uniform(0, 0.5, (400, 2)))], "id long, ra double, dec double") for _ in "ab")
    found = search.cross_match(a, b, 120.0)
    rows = found.collect()
    best = {}
    for r in rows:
        best.setdefault(r.id1, []).append((r.sep, r.id2, r.rank1))
    assert all([x[2] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in best.values()) and len(rows) > 1000
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4  # the points of either side, told twice by AQE
