"""Archive, grouped layout, pre-warming and sketches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import cli
from skyloom.contracts import SearchConfig
from skyloom.functions import cells
from skyloom.operators import sketches
from skyloom.plans import build, catalog
from skyloom.sources import archive, artifacts, grouped, stars
from skyloom.sources.prewarm import PreWarm

SERVICE = """
def stars(release, level, pix, columns, bounds, limit, deepest=8):
    n = 4 ** (deepest - level)  # one star in each cell of the deepest level
    for k in range(n if limit is None else min(n, limit)):
        yield dict(gaia_id=pix * n + k, gaia_ra=float(len(columns)), gaia_dec=80.0, gaia_G=None, gaia_ruwe=None, gaia_pmra=float(len(bounds)))

def asked(release, level, pix, bounds):
    for k, (column, test, value) in enumerate(bounds):
        yield dict(gaia_id=k, gaia_ra=None if isinstance(value, list) else float(value), gaia_dec={'=': 0.0, '<': 1.0, '<=': 2.0, '>': 3.0, '>=': 4.0, 'in': 5.0}[test], gaia_G=1.0)
"""


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("service") / "star_service.py"
    path.write_text(SERVICE)
    spark.sparkContext.addPyFile(str(path))
    return "star_service"


@pytest.fixture(scope="module")
def patch(spark, sf):
    return catalog.patch(spark, sf)


def test_archive_splits_cells_at_the_row_limit(spark, service):
    found = archive.archive_query(spark, [0, 7], f"{service}:stars", level=5, columns=["gaia_id", "gaia_ra"], row_limit=10)
    rows = found.collect()
    assert sorted(r.gaia_id for r in rows) == [*range(64), *range(7 * 64, 8 * 64)]  # 64 stars a cell, given by cells of level 7 with 4
    assert {r.gaia_ra for r in rows} == {2.0}  # two columns were asked for
    with pytest.raises(Exception, match="TooManyStars"):
        archive.archive_query(spark, [0], f"{service}:stars", level=29, row_limit=1, columns=["gaia_id"], service={"deepest": 29}).collect()


def test_archive_filters_reach_the_service(spark, service):
    def reader(condition):
        frame = archive.archive_query(spark, [3], f"{service}:asked", columns=["gaia_id", "gaia_ra", "gaia_dec", "gaia_G"])
        return {(r.gaia_dec, r.gaia_ra) for r in frame.where(condition).select("gaia_dec", "gaia_ra").collect()}

    assert (3.0, 0.5) in reader("gaia_G > 0.5D") and (4.0, 0.0) in reader("gaia_id >= 0") and (5.0, None) in reader("gaia_G in (1.0, 2.0)")


def test_archive_asks_no_cell_beyond_the_declination(spark, service):
    pixels = list(range(cells.npix(2)))
    everything = archive.archive_query(spark, pixels, f"{service}:stars", level=2, columns=["gaia_id", "gaia_dec"], service={"deepest": 2})
    assert everything.count() == 192 and everything.where("gaia_dec < 0").count() == 0 and everything.where("gaia_dec < -100").count() == 0
    asked = everything.where("gaia_dec > 75").count()
    reach = cells.resolution_arcsec(2) / 3600
    assert asked == sum(cells.centre(p, 2)[1] + reach >= 75 for p in pixels) < 40


def test_archive_without_cells(spark, service):
    assert archive.archive_query(spark, [], f"{service}:stars").collect() == []


def test_grouped_layout_gives_the_stars_of_the_store(spark, patch, tmp_path):
    root = str(tmp_path)
    stars.write_stars(patch, root, "dr3", 6)
    assert grouped.compact(patch, root, "dr3", 4) == 1
    want = {tuple(r) for r in stars.read_stars(spark, root, "dr3", 6).collect()}
    got = grouped.read_grouped(spark, root, "dr3", 4, 6)
    assert {tuple(r) for r in got.select(*stars.STAR_COLUMNS, "outer_pix").collect()} == want
    some = sorted({r[-1] for r in want})[::3]
    wanted = grouped.read_grouped(spark, root, "dr3", 4, 6, some)
    assert {tuple(r) for r in wanted.select(*stars.STAR_COLUMNS, "outer_pix").collect()} == {r for r in want if r[-1] in some}
    one = grouped.read_grouped(spark, root, "dr3", 4, 6, some[:1])  # plans cut long lists of filters short
    assert "GreaterThanOrEqual(fine" in one._jdf.queryExecution().executedPlan().toString()
    assert grouped.layout_size(spark.read.parquet(f"{grouped.grouped_root(root, 'dr3', 4)}/version=1/data")).first().n_files == len({p >> 4 for *_, p in want})


def test_rewritten_and_emptied_parents(spark, patch, tmp_path):
    root = str(tmp_path)
    far = patch.where("gaia_id < 400")
    grouped.compact(far, root, "dr3", 4)
    at = {r.gaia_id: r.outer_pix >> 4 for r in grouped.read_grouped(spark, root, "dr3", 4, 6).collect()}
    one, two = sorted(set(at.values()))[:2]
    named = spark.createDataFrame([(one,), (two,)], "parent long")
    lost = far.where(~F.col("gaia_id").isin([i for i, p in at.items() if p == one]))
    assert grouped.compact(lost, root, "dr3", 4, named) == 2
    left = {r.gaia_id for r in grouped.read_grouped(spark, root, "dr3", 4, 6).collect()}
    assert left == {i for i, p in at.items() if p != one}
    assert grouped.vacuum(spark, root, "dr3", 4) == 0  # version 1 still holds the other parents
    grouped.compact(far, root, "dr3", 4)
    assert grouped.vacuum(spark, root, "dr3", 4) == 2 and grouped.versions(spark, root, "dr3", 4) == [3]
    assert {r.gaia_id for r in grouped.read_grouped(spark, root, "dr3", 4, 6).collect()} == set(at)


def test_grouped_edges(spark, patch, tmp_path):
    assert grouped.ranges([5, 4, 9, 4], 28) == [(16, 24), (36, 40)] and grouped.ranges([], 3) == []
    root = str(tmp_path)
    assert grouped.read_grouped(spark, root, "dr3", 4, 6, [1]).count() == 0
    nowhere = patch.limit(1).withColumn("gaia_ra", F.lit(None).cast("double"))
    grouped.compact(nowhere, root, "dr3", 4)
    rows = grouped.read_grouped(spark, root, "dr3", 4, 6).collect()
    assert len(rows) == 1 and rows[0].outer_pix is None
    with pytest.raises(ValueError):
        grouped.read_grouped(spark, root, "dr3", 4, 3)


def test_sketch_is_within_its_error_and_merges(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(d), float(m)) for a, d, m in zip(rng.uniform(0, 20, 3000), rng.uniform(-10, 10, 3000), rng.normal(15, 3, 3000), strict=True)]
    frame = spark.createDataFrame([*rows, (1.0, 1.0, None), (1.0, 1.0, math.nan), (1.0, 1.0, math.inf), (None, 1.0, 9.0)], "ra double, dec double, mag double")
    error, shares = 0.02, {"low": 0.0, "half": 0.5, "most": 0.95, "all": 1.0}
    whole = sketches.magnitude_sketch(frame, 8, error)
    up = sketches.merge_up(whole, 8, (8, 1))
    parts = [sketches.magnitude_sketch(frame.where(c), 8, error) for c in ("mag < 15 or mag is null", "mag >= 15")]
    again = sketches.merge_up(sketches.merged(*parts), 8, (8, 1))
    assert {tuple(r) for r in up.collect()} == {tuple(r) for r in again.select(*up.columns).collect()}
    exact = {}
    for r in cells.with_cell(frame.where("ra is not null and mag < 100"), "ra", "dec", 1, "pix").collect():
        exact.setdefault(r.pix, []).append(r.mag)
    seen = sketches.quantiles(up.where("level = 1"), shares, error).collect()
    assert {r.pix for r in seen} == set(exact) and sum(r.n_stars for r in seen) == 3000
    for r in seen:
        mags = sorted(exact[r.pix])
        for name, p in shares.items():
            assert abs(r[name] - mags[max(1, math.ceil(len(mags) * p)) - 1]) <= error + 1e-9
    assert sketches.quantiles(whole.where("false"), shares, error).count() == 0


def test_prewarming_keeps_its_limit_and_frees(spark):
    warm, rows = PreWarm(100), spark.range(50)
    assert warm.ahead("a", 60, lambda: rows.selectExpr("id + 1 as a")) and not warm.ahead("b", 60, lambda: rows) and not warm.ahead("c", 0, lambda: rows)
    held = warm.take("a", rows)
    assert held.storageLevel.useMemory and held.count() == 50 and warm.take("b", rows) is rows
    warm.release("a")
    assert not held.storageLevel.useMemory and warm.held == 0 and warm.ahead("b", 100, lambda: rows.selectExpr("raise_error('gone') as x"))
    assert warm.take("b", rows) is rows  # a load that fails is read when it is needed
    warm.close()
    assert warm.held == 0 and warm.most == 100 and warm.loaded == ["a", "b"]


def test_prewarmed_run_equals_a_cold_one(spark, patch, tmp_path):
    root = str(tmp_path)
    stars.write_stars(patch.where("gaia_id < 600"), root, "dr3", 4)
    found, cached = [], spark.sparkContext._jsc.getPersistentRDDs().size()
    for top, limit in ((4, 0), (5, 1 << 26)):
        cfg = SearchConfig(sizes=(1,), outer_level=4, top_k=top)
        request = build.LoadRequest(outer_level=4)
        pass_id = build.create_pass(spark, root, cfg, request)
        build.bench_run(spark, root, pass_id, cfg, request, prewarm_bytes=limit, batches=3, at_once=1)
        found.append({tuple(r) for r in artifacts.read_asterisms(spark, root, pass_id).where("rank <= 4").select("outer_pix", "rank", "g1").collect()})
        record = build.read_bench(spark, root, pass_id).first()
        assert (record.temperature, record.staging) == (("warm", "prewarm") if limit else ("cold", "none")) and float(record.seconds) > 0
        assert int(record.n_stars) == stars.read_stars(spark, root, "dr3", 4).count()
    assert found[0] == found[1] and spark.sparkContext._jsc.getPersistentRDDs().size() == cached


def test_positions_that_are_not_finite_have_no_cell(spark):
    bad = [(math.inf, 0.0), (-math.inf, 0.0), (0.0, math.inf), (0.0, -math.inf), (math.nan, 0.0), (0.0, math.nan), (None, 0.0), (0.0, None)]
    rows = spark.createDataFrame([*bad, (0.0, 0.0)], "ra double, dec double")
    assert [r[0] is None for r in rows.select(cells.ang2pix(F.col("ra"), F.col("dec"), 6)).collect()] == [True] * len(bad) + [False]


def test_command_line_times_and_groups(spark, patch, tmp_path, capsys):
    root = str(tmp_path)
    stars.write_stars(patch.where("gaia_id < 60"), root, "dr3", 3)
    for verb in (["bench", "--batches", "2", "--prewarm-bytes", "1000000"], ["compact", "--parent-level", "2"]):
        assert cli.main([verb[0], "--root", root, "--level", "3", *verb[1:]], spark) == 0
    said = capsys.readouterr().out
    assert "warm" in said and "version 1" in said
    assert grouped.read_grouped(spark, root, "dr3", 2, 3).count() == stars.read_stars(spark, root, "dr3", 3).count()


def test_requests_for_parts_of_a_cell_read_its_file_once(spark, patch, tmp_path):
    root = str(tmp_path)
    grouped.compact(patch, root, "dr3", 3)
    held = [r.parent for r in grouped.current(spark, root, "dr3", 3).collect()]
    service = {"root": root, "parent_level": 3}
    found = archive.archive_query(spark, held, "skyloom.sources.grouped:fetch", level=3, columns=["gaia_id"], row_limit=20, service=service, split=2)
    assert found.rdd.getNumPartitions() == 16 * len(held)  # a cell is the work of many tasks
    assert sorted(r.gaia_id for r in found.collect()) == sorted(r.gaia_id for r in patch.select("gaia_id").collect())
    before = grouped._row_group.cache_info().misses
    asked = [p for h in held for p in range(64 * h, 64 * h + 64)]
    got = [s["gaia_id"] for p in asked for s in grouped.fetch("dr3", 6, p, ["gaia_id"], [("gaia_G", ">=", 14.0), ("gaia_id", "in", list(range(0, 1500, 2)))], None, **service)]
    assert sorted(got) == sorted(r.gaia_id for r in patch.where("gaia_G >= 14 and gaia_id % 2 = 0 and gaia_id < 1500").collect())
    assert grouped._row_group.cache_info().misses - before == len(held)  # one row group a parent here, for 64 requests each
