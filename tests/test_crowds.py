"""Results over all groups, from stars alone, against those over groups as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.contracts import SearchConfig
from skyloom.functions import cells, geometry
from skyloom.operators import crowds, scoring, search
from skyloom.plans import build, catalog


@pytest.fixture(scope="module")
def crowd(spark):
    rng = np.random.default_rng(8)
    spots = [(10.0, 0.0), (359.999, 41.81), (45.0, 89.97), (200.0, -60.0)]
    rows = [(float((ra + rng.normal(0, 0.05) / max(0.01, np.cos(np.radians(dec)))) % 360), float(np.clip(dec + rng.normal(0, 0.05), -90, 90))) for ra, dec in spots for _ in range(80)]
    rows += [rows[0], (12.0, None)]
    frame = [(i, *row, float(8 + rng.uniform(0, 10))) for i, row in enumerate(rows)]
    return spark.createDataFrame(frame, "gaia_id long, ra double, dec double, mag double").cache()


def test_pairs_of_two_tables_compare_as_groups_do(crowd, monkeypatch):
    cfg, left = SearchConfig(sizes=(2,)), crowd.where("dec is not null and gaia_id <> 320")
    other = F.when(F.col("gaia_id") % 3 == 0, F.col("gaia_id") + 1000).when(F.col("gaia_id") % 50 == 1, -2 - F.col("gaia_id")).otherwise(F.col("gaia_id"))
    right = left.where("gaia_id % 17 <> 4").withColumns({"gaia_id": other, "dec": F.col("dec") + F.when(F.col("gaia_id") % 4 == 0, 1e-4).when(F.col("gaia_id") == 5, -30.0).otherwise(0.0)})
    sided = [search.candidates(df, cfg).withColumn("side", F.round("max_side", 3)) for df in (left, right)]
    names = ("g1", "g2", "h1", "h2", "difference")
    want = {tuple(r[c] for c in names): r.sep for r in build.compare_groups(*sided, 5.0, ["side"]).collect()}
    for step in ("pairs", "cross_match"):
        monkeypatch.setattr(search, step, None)
    for size in (8_000, 20):
        monkeypatch.setattr(crowds, "PART_STARS", size)
        rows = crowds.compare_pairs(left, right, cfg, 5.0, 3).collect()
        got = {tuple(r[c] for c in names): r.sep for r in rows}
        assert len(rows) == len(got) and set(got) == set(want) and {k[4] for k in got} == set(crowds.KINDS)
        assert all(s is None and got[k] is None or abs(s - got[k]) < 1e-7 for k, s in want.items())
    assert crowds.compare_pairs(left.limit(0), right.limit(0), cfg, 5.0, 3).isEmpty()


def test_registered_comparison_makes_no_pairs_as_rows(spark, sf, monkeypatch):
    for step in ("pairs", "cross_match"):
        monkeypatch.setattr(search, step, None)
    assert catalog.queries()["moved_groups"](spark, sf).count() > 0


@pytest.mark.parametrize("radius, groups", [(20.0, 10**6), (60.0, 0)])
def test_greedy_removal_from_stars_equals_that_of_groups_as_rows(crowd, monkeypatch, radius, groups):
    monkeypatch.setattr(crowds, "HELD_GROUPS", groups)  # wide cells, and narrow ones that hang on each other
    cfg, scorer, held = SearchConfig(sizes=(2, 3)), scoring.HeuristicScorer(), []
    stars = crowd.where("dec is not null").withColumn("mag", F.round("mag", 1))  # many scores are equal
    want, closed = set(), []
    for r in sorted(scorer.score(search.candidates(stars, cfg)).select("score", "g1", "g2", "g3", "ra", "dec").collect(), key=lambda r: (-r.score, r.g1, r.g2 or -1, r.g3 or -1)):
        at = crowds._unit(np.array(r.ra), np.array(r.dec))
        if not closed or (((np.array(closed) - at) ** 2).sum(axis=1) > geometry.chord(radius) ** 2).all():
            closed.append(at)
            want.add((r.g1, r.g2, r.g3))
    for step in ("star_triples", "pairs", "suppress_greedy"):
        monkeypatch.setattr(search, step, None)
    got = crowds.suppress_greedy(stars, cfg, scorer, radius, lambda df: held.append(df.localCheckpoint()) or held[-1]).collect()
    assert len(got) == len(want) > 40 and {(r.g1, r.g2, r.g3) for r in got} == want


def test_registered_removal_makes_no_groups_as_rows(spark, sf, monkeypatch):
    for step in ("star_triples", "pairs", "suppress_greedy"):
        monkeypatch.setattr(search, step, None)
    assert catalog.overlap_greedy(spark, sf).count() > 0


def test_counts_by_cell_equal_those_of_rows_and_make_none(spark, sf, crowd, monkeypatch):
    cfg, stars = SearchConfig(outer_level=9), crowd.where("dec is not null")
    want = {tuple(r) for r in search.count_by_pix(search.candidates(stars, cfg)).collect()}
    for step in ("star_triples", "pairs", "candidates"):
        monkeypatch.setattr(search, step, None)
    got = crowds.count_by_pix(stars, cfg).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20
    assert catalog.star_count(spark, sf).count() > 0


def test_cells_in_numpy_equal_the_expressions(spark):
    rng = np.random.default_rng(2)
    ra, dec = rng.uniform(0, 360, 3000), np.degrees(np.arcsin(rng.uniform(-1, 1, 3000)))
    rows = spark.createDataFrame([(float(a), float(d)) for a, d in zip(ra, dec, strict=True)], "ra double, dec double")
    for level in (6, 12):
        got = rows.select(cells.ang2pix(F.col("ra"), F.col("dec"), level).alias("pix")).collect()
        assert [r.pix for r in got] == crowds._ang2pix(ra, dec, level).tolist()


SHAPE = ("size", "g1", "g2", "g3", "sep12", "sep13", "sep23", "ra", "dec", "max_side", "area", "circumradius", "flux", "score")


@pytest.mark.parametrize("sizes, keep", [((1, 2, 3), False), ((2, 3), True), ((3,), False)])
def test_groups_from_stars_equal_those_of_joins(crowd, monkeypatch, sizes, keep):
    cfg, scorer = SearchConfig(sizes=sizes, max_side_arcsec=90.0, min_area_arcsec2=500.0), scoring.HeuristicScorer()
    stars = crowd.where("dec is not null")
    found = scorer.score(search.candidates(stars, cfg))
    found = search.geom_filter(found, cfg) if keep else found
    for c in set(SHAPE) - set(found.columns):
        found = found.withColumn(c, F.lit(None).cast("double"))
    want = {(r.g1, r.g2, r.g3): r for r in found.select(*SHAPE).collect()}
    monkeypatch.setattr(search, "star_triples", None)
    monkeypatch.setattr(crowds, "ROWS", 50)
    monkeypatch.setattr(crowds, "BLOCK", 320)
    got = crowds.groups(stars, cfg, SHAPE, keep, scorer).collect()
    assert len(got) == len(want) > 100
    for r in got:
        assert all(a == b or abs(a - b) < 1e-9 * max(1.0, abs(a)) for a, b in zip(r, want[r.g1, r.g2, r.g3], strict=True))


def test_scorers_without_numpy_score_groups_as_rows(crowd):
    class Plain:
        identity = "plain"

        def score(self, groups):
            return groups.withColumn("score", F.col("flux") * 2)

    stars, cfg = crowd.where("dec is not null"), SearchConfig(sizes=(2,))
    got = crowds.groups(stars, cfg, ("g1", "flux", "score"), scorer=Plain()).collect()
    assert got and all(r.score == r.flux * 2 for r in got)


@pytest.mark.parametrize("name", ["triples", "geom_filter", "group_geometry", "heuristic_score", "scorer_plugin", "candidates"])
def test_registered_rows_come_from_stars(spark, sf, monkeypatch, name):
    want = sorted(tuple(r) for r in catalog.queries()[name](spark, sf).collect())
    for step in ("star_triples", "pairs"):  # which sort and spill pairs
        monkeypatch.setattr(search, step, None)
    assert sorted(tuple(r) for r in catalog.queries()[name](spark, sf).collect()) == want


def test_halves_round_away_from_zero(spark):
    row = spark.sql("select explode(array(0.125D, -0.125D, 2.5D, 150.123456749D, 0D, -7D)) as x").select(geometry.half_up(F.col("x"), 2).alias("y")).collect()
    assert [r.y for r in row] == [0.13, -0.13, 2.5, 150.12, 0.0, -7.0]


def test_bands_are_made_once_for_cut_and_result(spark, sf):
    plan = catalog.guides(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("0.003775") == 1  # copies make a method that the JVM does not compile


def test_coverage_of_triples_equals_that_of_their_rows(crowd):
    cfg = SearchConfig(sizes=(3,), radius_arcsec=150.0, min_separation_arcsec=10.0)
    for level, radius in ((10, 120.0), (8, 700.0)):
        rows = search.coverage(search.candidates(crowd, cfg), level, radius).groupBy("pix", "g1").agg(F.count("*").alias("n"))
        want = {tuple(r) for r in rows.collect()}
        got = [tuple(r) for r in crowds.triple_coverage(crowd, cfg, level, radius).select("pix", "g1", "n").collect()]
        assert len(got) == len(set(got)) and set(got) == want and sum(n for *_, n in want) > 500


def test_registered_coverage_makes_no_triples_as_rows(spark, sf, monkeypatch):
    want = {tuple(r) for r in catalog.coverage(spark, sf).collect()}
    monkeypatch.setattr(search, "star_triples", None)
    assert {tuple(r) for r in catalog.coverage(spark, sf).collect()} == want


def test_suppression_from_stars_equals_that_of_groups_as_rows(crowd, monkeypatch):
    cfg, scorer, names = SearchConfig(sizes=(2, 3)), scoring.HeuristicScorer(), ("size", "g1", "g2", "g3", "score")
    stars = crowd.where("dec is not null").withColumn("mag", F.round("mag", 1))  # many scores are equal
    want = {tuple(r) for r in search.suppress(scorer.score(search.candidates(stars, cfg)), 60.0, lambda df: df).select(*names).collect()}
    monkeypatch.setattr(search, "overlaps", None)
    monkeypatch.setattr(search, "star_triples", None)
    got = [tuple(r) for r in crowds.suppress(stars, cfg, scorer, 60.0).select(*names).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_registered_suppression_makes_no_groups_as_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(search, "overlaps", None)
    monkeypatch.setattr(search, "star_triples", None)
    assert catalog.overlap_suppressed(spark, sf).count() > 0


def test_small_blocks_give_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    v = crowds._unit(10 + rng.uniform(0, 0.1, 150), rng.uniform(0, 0.1, 150))
    ids, flux, p = np.arange(150), np.rint(rng.uniform(1, 9, 150)), crowds._unit(10 + rng.uniform(0, 0.1, 9), rng.uniform(0, 0.1, 9))
    side = search._side(2 * geometry.chord(120.0))
    rules, low = crowds._Rules(SearchConfig()), np.floor((v[0] + 1.0001) / side).astype("int64")

    def both():
        best = crowds._Best(rules, scoring.HeuristicScorer(), (2, 3), ids, flux, v, 60.0, low, side)
        covered = [(i, a.tolist(), b.tolist()) for i, a, b in crowds._covered(rules, ids, v, ids, p, p, 120.0)]
        return {tuple(r) for r in best.stay().tolist()}, covered, best.stored is None

    *want, again = both()
    monkeypatch.setattr(crowds, "BLOCK", 320)
    monkeypatch.setattr(crowds, "PAIRS", 500)
    *got, made_again = both()
    assert got == want and all(want) and not again and made_again
