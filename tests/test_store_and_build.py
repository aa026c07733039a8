"""Contracts, the star store, passes, states and a stopped and resumed build."""

import os

import pytest
from pyspark.sql import functions as F

from skyloom import cli
from skyloom.contracts import LoadRequest, SearchConfig, pass_identity, pass_path, star_path
from skyloom.functions import cells
from skyloom.operators import loader, products, scoring
from skyloom.plans import build, catalog, regions
from skyloom.sources import archive, artifacts, digests, stars
from skyloom.sources.log import StateLog, illegal, latest


@pytest.fixture(scope="module")
def patch(spark, sf):
    return catalog.patch(spark, sf).where("gaia_id < 400").cache()


def test_store_round_trip_and_pruning(spark, patch, tmp_path):
    stars.write_stars(patch, str(tmp_path), "dr3", 4)
    back = stars.read_stars(spark, str(tmp_path), "dr3", 4)
    assert back.drop("outer_pix").exceptAll(patch).isEmpty() and back.count() == patch.count()
    one = back.first().outer_pix
    some = stars.read_stars(spark, str(tmp_path), "dr3", 4, [one])
    assert 0 < some.count() < back.count() and {r.outer_pix for r in some.select("outer_pix").distinct().collect()} == {one}
    held = [r.outer_pix for r in back.select("outer_pix").distinct().collect()]
    assert all(os.listdir(star_path(str(tmp_path), "dr3", 4, p)) for p in held)  # the path contract is where the files are
    assert "PartitionFilters: [" in some._jdf.queryExecution().toString() and stars.exists(spark, str(tmp_path), "dr3", 4)
    assert not stars.exists(spark, str(tmp_path), "dr9", 4)


def test_writer_rejects_derived_columns_and_wrong_types(patch, tmp_path):
    with pytest.raises(stars.ContractError):
        stars.write_stars(loader.with_band(patch, "R"), str(tmp_path), "dr3", 4)
    with pytest.raises(stars.ContractError):
        stars.write_stars(patch.withColumn("gaia_G", F.col("gaia_G").cast("double")), str(tmp_path), "dr3", 4)


def test_paths_and_identity():
    a = pass_identity("a", "1", SearchConfig(), "dr3", 6, "s")
    assert a == pass_identity("a", "1", SearchConfig(), "dr3", 6, "s") != pass_identity("a", "1", SearchConfig(radius_arcsec=1.0), "dr3", 6, "s")
    with pytest.raises(ValueError):
        pass_path("r", "p", "other")


def test_null_proper_motion_stays_and_null_colour_has_no_band(spark, patch):
    moved = loader.at_epoch(patch, 2100.0)
    assert moved.where("gaia_pmra is null and (ra <> gaia_ra or dec <> gaia_dec)").isEmpty()
    assert loader.with_band(patch, "R").where("gaia_BP is null and mag is not null").isEmpty()


def test_stopped_and_resumed_pass_equals_a_clean_one(spark, patch, tmp_path):
    cfg = SearchConfig(sizes=(1, 2), radius_arcsec=900.0, max_side_arcsec=900.0, outer_level=3, inner_level=5, map_levels=(3,))
    request = LoadRequest(outer_level=3)
    found = []
    for name, stop in (("a", 1), ("b", None)):
        root = str(tmp_path / name)
        stars.write_stars(patch, root, "dr3", 3)
        pass_id = build.create_pass(spark, root, cfg, request)
        assert pass_id == build.create_pass(spark, root, cfg, request)
        if stop:
            build.run(spark, root, pass_id, cfg, request, batches=2, stop_after=stop)
            assert artifacts.read_manifest(spark, root, pass_id).first().completed_at is None
        states = build.resume(spark, root, pass_id, cfg, request, batches=2)
        assert {r.state for r in states.collect()} == {"done"}
        assert build.inspect(spark, root, pass_id).first().completed_at is not None
        found.append((artifacts.read_asterisms(spark, root, pass_id), artifacts.read_inner(spark, root, pass_id), artifacts.read_map(spark, root, pass_id)))
    for left, right in zip(*found, strict=True):
        assert left.count() == right.count() > 0 and left.select(right.columns).exceptAll(right).isEmpty()
    assert build.compare(found[0][1], found[1][1], ["outer_pix", "inner_pix"], ["n_stars"]).isEmpty()
    assert cli.main(["compare", "--root", str(tmp_path / "a"), "--pass-id", pass_id, pass_id], spark) == 0
    assert cli.main(["inspect", "--root", str(tmp_path / "a"), "--pass-id", pass_id], spark) == 0


SMALL = SearchConfig(sizes=(1,), outer_level=3, inner_level=5, map_levels=(3,))


class Broken(scoring.HeuristicScorer):
    """Fails on the groups of one side of the patch."""

    def __init__(self, below):
        self.below = below

    def score(self, groups):
        broken = F.raise_error(F.lit("scorer broke")).cast("double")
        return super().score(groups).withColumn("score", F.when(F.col("outer_pix") < self.below, broken).otherwise(F.col("score")))


def test_a_failing_batch_is_told_and_tried_again(spark, patch, tmp_path):
    root, request = str(tmp_path), LoadRequest(outer_level=3)
    stars.write_stars(patch, root, "dr3", 3)
    held = sorted(r.outer_pix for r in stars.read_stars(spark, root, "dr3", 3).select("outer_pix").distinct().collect())
    out = spark.createDataFrame([(held[-1],)], "outer_pix long")
    pass_id = build.create_pass(spark, root, SMALL, request)
    states = build.run(spark, root, pass_id, SMALL, request, Broken(held[1]), batches=3, excluded=out)
    counts = {r.state: r.n_cells for r in states.collect()}
    assert counts["failed"] > 0 and counts["done"] > 0 and counts["excluded"] == 1 and sum(counts.values()) == len(held)
    notes = build.read_events(spark, root, pass_id).where("state = 'failed'").select("note").distinct().collect()
    assert len(notes) == 1 and "scorer broke" in notes[0].note
    same = build.resume(spark, root, pass_id, SMALL, request, batches=3, excluded=out)
    assert {r.state: r.n_cells for r in same.collect()} == counts  # failed cells stay until they are asked for
    assert artifacts.read_manifest(spark, root, pass_id).first().completed_at is None
    again = build.resume(spark, root, pass_id, SMALL, request, batches=3, retry_failed=True, excluded=out)
    assert {r.state: r.n_cells for r in again.collect()} == {"done": len(held) - 1, "excluded": 1}
    assert artifacts.read_manifest(spark, root, pass_id).first().completed_at is not None
    built = {r.outer_pix for r in artifacts.read_asterisms(spark, root, pass_id).select("outer_pix").distinct().collect()}
    assert built <= set(held[:-1])


def test_a_rebuilt_cell_keeps_nothing_of_before(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "outer_pix long, v string")
    artifacts.write_inner(rows, str(tmp_path), "p")
    artifacts.clear_cells(spark, str(tmp_path), "p", "inner", rows.where("outer_pix = 1"))
    artifacts.write_inner(rows.where("outer_pix = 3"), str(tmp_path), "p")
    assert {r.outer_pix for r in artifacts.read_inner(spark, str(tmp_path), "p").collect()} == {2}


def test_a_run_asks_for_one_level(spark, patch, tmp_path):
    root, request = str(tmp_path), LoadRequest(outer_level=3)
    pass_id = build.create_pass(spark, root, SMALL, request)
    with pytest.raises(ValueError, match="level"):
        build.run(spark, root, pass_id, SMALL, LoadRequest(outer_level=4))


def found(spark, root, pass_id):
    tables = (artifacts.read_inner(spark, root, pass_id), artifacts.read_asterisms(spark, root, pass_id), artifacts.read_map(spark, root, pass_id))
    return [sorted(map(repr, t.select(sorted(t.columns)).collect())) for t in tables]


def test_a_changed_cell_is_built_again_with_its_neighbours_only(spark, patch, tmp_path):
    cfg = SearchConfig(sizes=(1, 2), radius_arcsec=900.0, max_side_arcsec=900.0, outer_level=5, inner_level=7, map_levels=(5,))
    request, roots = LoadRequest(outer_level=5), [str(tmp_path / n) for n in "ab"]
    stars.write_stars(patch, roots[0], "dr3", 5)
    pass_id = build.create_pass(spark, roots[0], cfg, request)
    build.run(spark, roots[0], pass_id, cfg, request, batches=2)
    counts = stars.read_stars(spark, roots[0], "dr3", 5).groupBy("outer_pix").count().orderBy("count", "outer_pix").collect()
    pix = counts[len(counts) // 2].outer_pix
    cell = cells.with_cell(patch, "gaia_ra", "gaia_dec", 5, "p")
    new = cell.withColumn("gaia_G", F.when(F.col("p") == pix, F.col("gaia_G") + 0.5).otherwise(F.col("gaia_G")).cast("float"))
    stars.write_stars(new.where(F.col("p") == pix).drop("p"), roots[0], "dr3", 5)  # one cell of the store is replaced
    version = build.StateLog(spark, roots[0], pass_id).version()
    build.resume(spark, roots[0], pass_id, cfg, request, batches=2)
    again = {r.outer_pix for r in build.read_events(spark, roots[0], pass_id).where(F.col("version") > version).where("state = 'done'").collect()}
    near = {r.nbr for r in cells.neighbours(spark, 5).where(F.col("pix") == pix).collect()} | {pix}
    assert again == near & {r.outer_pix for r in counts} and len(again) <= 9
    stars.write_stars(new.drop("p"), roots[1], "dr3", 5)
    build.create_pass(spark, roots[1], cfg, request)
    build.run(spark, roots[1], pass_id, cfg, request, batches=1)
    assert found(spark, roots[0], pass_id) == found(spark, roots[1], pass_id)
    version = build.StateLog(spark, roots[0], pass_id).version()
    build.resume(spark, roots[0], pass_id, cfg, request)
    assert build.StateLog(spark, roots[0], pass_id).version() == version  # nothing changed, nothing is built


def test_two_runs_at_once_build_each_cell_once(spark, patch, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root, request = str(tmp_path), LoadRequest(outer_level=4)
    cfg = SearchConfig(sizes=(1,), outer_level=4, inner_level=5, map_levels=(4,))
    stars.write_stars(patch, root, "dr3", 4)
    pass_id = build.create_pass(spark, root, cfg, request)
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(build.run, spark, root, pass_id, cfg, request, batches=3, by_region=k == 1) for k in range(2)]
        for r in runs:
            r.result()
    events = build.read_events(spark, root, pass_id)
    assert events.groupBy("outer_pix", "state").count().where("count > 1").isEmpty() and illegal(events).isEmpty()
    assert {r.state for r in latest(events).collect()} == {"done"}
    assert artifacts.read_manifest(spark, root, pass_id).first().completed_at is not None and not artifacts.read_map(spark, root, pass_id).isEmpty()


def test_leases_attempts_and_owners(spark, tmp_path):
    log, work = StateLog(spark, str(tmp_path), "p"), spark.createDataFrame([(1, "x"), (2, "x")], "outer_pix long, note string")
    taken = lambda df: sorted(r.outer_pix for r in df.collect())
    assert log.version() == 0 and log.events().isEmpty()
    assert taken(log.claim(work, "a", lease_seconds=1000)) == [1, 2] and taken(log.claim(work, "b")) == []
    assert taken(log.finish(work.where("outer_pix = 1"), "b", "done")) == []  # not the owner
    assert taken(log.finish(work.where("outer_pix = 1"), "a", "failed")) == [1]
    assert taken(log.claim(work, "b", lease_seconds=-1)) == [1]
    assert taken(log.claim(work, "c", attempts=2)) == [] and taken(log.claim(work, "c", attempts=3)) == [1]  # its lease has ended
    assert taken(log.finish(work, "b", "done")) == [] and taken(log.finish(work, "c", "done")) == [1]
    assert {(r.outer_pix, r.state, r.attempt) for r in latest(log.events()).collect()} == {(1, "done", 3), (2, "running", 1)}
    assert taken(log.claim(work, "d", attempts=1)) == [1]  # done cells begin anew
    assert illegal(log.events()).isEmpty() and taken(log.exclude(work)) == []
    with pytest.raises(ValueError):
        log.record(work.withColumn("state", F.lit("odd")))
    assert log.once("x") and not log.once("x") and log.once("y")


def test_a_number_is_committed_once(spark, tmp_path):
    """A writer that finds its number taken makes its events anew from the log as it then is."""
    log, work, seen = StateLog(spark, str(tmp_path), "p"), spark.createDataFrame([(1,)], "outer_pix long"), []

    def make(events):
        seen.append(events.count())
        if len(seen) == 1:
            StateLog(spark, str(tmp_path), "p").claim(work, "other")  # comes in between
        return work.withColumn("state", F.lit("done" if events.count() else "running"))

    assert [r.state for r in log.append(make).collect()] == ["done"] and seen == [0, 1] and log.version() == 2
    assert sorted((r.version, r.state) for r in log.events().collect()) == [(1, "running"), (2, "done")]
    assert os.listdir(os.path.join(log.path, "_staged")) == []


def test_changed_cells_are_found_from_the_top(spark, patch):
    level = 5
    some = cells.with_cell(patch, "gaia_ra", "gaia_dec", level, "p")
    pixels = sorted({r.p for r in some.select("p").collect()})
    gone, new, other = pixels[0], pixels[3], pixels[7]
    a, b = some.where(F.col("p") != new).drop("p"), some.where(F.col("p") != gone)
    b = b.withColumn("gaia_ruwe", F.when(F.col("p") == other, F.lit(9.0)).otherwise(F.col("gaia_ruwe")).cast("float")).drop("p")
    one, two = (digests.cell_digests(df, level) for df in (a, b))
    assert {(r.outer_pix, r.change) for r in digests.changed(one, two, level).collect()} == {(gone, "gone"), (new, "new"), (other, "changed")}
    assert digests.changed(one, digests.cell_digests(a.orderBy(F.desc("gaia_id")), level), level).isEmpty()
    twice = digests.cell_digests(a.unionByName(a), level)
    assert digests.changed(one, twice, level).count() == one.count()  # repeated rows are content
    assert digests.tree(one, level)[0].count() <= 12


def test_regions_equal_a_search(spark):
    import random

    level, draw = 3, random.Random(8)
    chosen = set(draw.sample(range(cells.npix(level)), 330))
    near: dict = {}
    for r in cells.neighbours(spark, level).collect():
        near.setdefault(r.pix, set()).add(r.nbr)
    want = {}
    for p in sorted(chosen):
        if p not in want:
            todo = [p]
            while todo:
                q = todo.pop()
                if q in chosen and q not in want:
                    want[q] = p
                    todo += near[q]
    df = spark.createDataFrame([(p, 1 + p % 5) for p in chosen] + [(None, 3)], "outer_pix long, weight long")
    got = regions.regions(df, level).collect()
    assert {r.outer_pix: r.region for r in got} == want and len(set(want.values())) > 3
    assert all(r.n_open == len(near[r.outer_pix] & chosen) for r in got)
    rows = regions.in_order(df.where("outer_pix is not null"), level, 4).orderBy("before").collect()
    named = [r.region for r in rows]
    assert len(rows) == len(chosen) and [k for k, n in enumerate(named) if k == 0 or named[k - 1] != n].__len__() == len(set(named))  # region by region
    assert [r.share for r in rows] == sorted(r.share for r in rows) and [r.before for r in rows] == [sum(x.weight for x in rows[:k]) for k in range(len(rows))]


def test_requests_name_cells_and_the_ring_around_them(spark, patch, tmp_path):
    root = str(tmp_path)
    stars.write_stars(patch, root, "dr3", 4)
    every = stars.load(spark, root, LoadRequest(outer_level=4, epoch=2020.0, band="V"))
    assert every.count() == patch.count() and every.where("own").count() == patch.count()
    pix = every.groupBy("outer_pix").count().orderBy(F.desc("count")).first().outer_pix
    alone = stars.load(spark, root, LoadRequest(outer_level=4, pixels=(pix,)))
    assert {r.outer_pix for r in alone.select("outer_pix").distinct().collect()} == {pix}
    around = {r.nbr for r in cells.neighbours(spark, 4).where(F.col("pix") == pix).collect()}
    for level in (4, 6):
        got = stars.load(spark, root, LoadRequest(outer_level=4, pixels=(pix,), stitching_level=level))
        inner = {r.p for r in spark.range(1).select(F.explode(cells.children(F.lit(pix), 4, level)).alias("p")).collect()}
        near = cells.neighbours(spark, level).where(F.col("pix").isin(list(inner))).select("nbr").distinct()
        ring = {r.nbr for r in near.collect()} - inner
        want = cells.with_cell(every, "gaia_ra", "gaia_dec", level, "fine").where(F.col("fine").isin(list(ring | inner)))
        assert {(r.gaia_id, r.own) for r in got.collect()} == {(r.gaia_id, r.fine in inner) for r in want.collect()}
        assert {r.outer_pix for r in got.collect()} <= around | {pix}


def test_boxes_over_zero_and_the_poles(spark):
    boxes = [("a", 350.0, 10.0, -5.0, 5.0), ("b", 350.0, 370.0, -5.0, 5.0), ("c", 0.0, 360.0, 80.0, 90.0), ("d", 100.0, 101.0, -90.0, -60.0), ("e", 10.0, 20.0, 5.0, -5.0), ("f", None, 20.0, 0.0, 5.0)]
    df = spark.createDataFrame(boxes, "survey string, ra_min double, ra_max double, dec_min double, dec_max double")
    got = {(r.survey, r.pix) for r in products.footprint_cells(df, 5).collect()}
    at = cells.with_centre(spark.range(cells.npix(5)).withColumnRenamed("id", "pix"), "pix", 5, "ra", "dec").collect()
    inside = {"a": lambda r: (r.ra >= 350 or r.ra <= 10) and abs(r.dec) <= 5, "c": lambda r: r.dec >= 80, "d": lambda r: 100 <= r.ra <= 101 and r.dec <= -60}
    inside["b"] = inside["a"]
    assert got == {(s, r.pix) for s, f in inside.items() for r in at if f(r)} and {s for s, _ in got} == set("abcd")


def test_overlays_hold_their_level(spark):
    sky_map = spark.createDataFrame([(6, 5, 10), (7, 5, 3)], "level int, pix long, n_stars long")
    survey = spark.createDataFrame([(6, 5, "s")], "level int, pix long, survey string")
    assert {(r.level, r.inside) for r in products.overlay(sky_map, survey).collect()} == {(6, True), (7, False)}


def test_command_line_builds_a_pass(spark, patch, tmp_path, capsys):
    root = str(tmp_path)
    stars.write_stars(patch.where("gaia_id < 60"), root, "dr3", 3)
    for verb in ("plan", "run", "resume"):
        assert cli.main([verb, "--root", root, "--level", "3", "--batches", "2"], spark) == 0
    said = capsys.readouterr().out
    pass_id = said.split()[0]
    assert said.count(pass_id) == 3 and "done" in said
    assert artifacts.read_manifest(spark, root, pass_id).first().completed_at is not None


def test_bench_records_are_summed(spark, tmp_path):
    for seconds in (1.0, 3.0, 2.0):
        build.bench(spark, str(tmp_path), "p", location="ssd", workers=2, temperature="warm", seconds=seconds)
    row = build.bench_summary(build.read_bench(spark, str(tmp_path), "p")).first()
    assert (row.location, row.workers, row.n, row.median_seconds) == ("ssd", "2", 3, 2.0)


def test_balance_is_contiguous_and_even(spark):
    weighted = spark.range(300).select(F.col("id").alias("outer_pix"), (F.col("id") % 7 + 1).alias("weight"))
    rows = build.balance(weighted, 5, section_bits=4).orderBy("outer_pix").collect()
    shares = [r.share for r in rows]
    assert shares == sorted(shares) and set(shares) == set(range(5))
    total = sum(r.weight for r in rows)
    assert all(abs(sum(r.weight for r in rows if r.share == s) - total / 5) <= 8 for s in range(5))


def test_states(spark):
    ev = spark.createDataFrame([(1, "done", 2, 0), (1, "running", 1, 1), (2, "failed", 1, 0), (3, "excluded", 1, 0), (4, "running", 1, 0)], "outer_pix long, state string, ts int, seq long")
    last = build.latest(ev)
    universe = spark.range(6).withColumnRenamed("id", "outer_pix")
    assert {r.outer_pix for r in build.unfinished(universe, last).collect()} == {0, 4, 5}
    assert {r.outer_pix for r in build.unfinished(universe, last, retry_failed=True).collect()} == {0, 2, 4, 5}
    assert {r.state: r.n_cells for r in build.progress(universe, last).collect()} == {"pending": 2, "done": 1, "failed": 1, "excluded": 1, "running": 1}


def test_state_queries_hold_all_cells_of_the_events(spark):
    sf = "/root/testdata/sf0.1"  # 1,500 cells, more than the 192 of level 2
    states = build.latest(catalog.build_events(spark, sf)).where("outer_pix is not null")
    counts = {r.state: r.n_cells for r in catalog.state_summary(spark, sf).collect()}
    want = {r.state: r["count"] for r in states.groupBy("state").count().collect()}
    pending = sum(i not in {r.outer_pix for r in states.select("outer_pix").collect()} for i in range(192))
    assert states.count() > 192 and {k: v for k, v in counts.items() if k != "pending"} == {k: v for k, v in want.items() if k != "pending"}
    assert counts.get("pending", 0) == want.get("pending", 0) + pending
    ended = states.where("state in ('done', 'excluded', 'failed')").count()
    assert catalog.unfinished(spark, sf).count() == sum(counts.values()) - ended


def test_archive_source(spark, tmp_path, monkeypatch):
    (tmp_path / "fake_archive.py").write_text(
        "def fetch(release, level, pix):\n"
        "    yield dict(gaia_id=pix, gaia_ra=1.0, gaia_dec=1.0, gaia_G=1.0, gaia_BP=None, gaia_RP=None, gaia_ref_epoch=2016.0,"
        " gaia_pmra=None, gaia_pmdec=None, gaia_non_single_star=0, gaia_ruwe=None)\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "fake_archive.py"))
    rows = archive.archive_query(spark, [3, 5], "fake_archive:fetch").collect()
    assert sorted(r.gaia_id for r in rows) == [3, 5] and rows[0].gaia_BP is None


def test_state_stream(spark, tmp_path):
    from skyloom.streaming.states import state_stream

    work = spark.range(3).withColumnRenamed("id", "outer_pix")
    build._states(work, str(tmp_path), "p", "running")
    build._states(work.where("outer_pix < 2"), str(tmp_path), "p", "done")
    query = state_stream(spark, str(tmp_path), "p").writeStream.format("memory").queryName("live_states").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("live_states").collect()} == {(0, "done"), (1, "done"), (2, "running")}


def test_rounds_of_regions_keep_no_constraints_and_numbers_beyond_the_sky_touch_nothing(spark, tmp_path):
    from skyloom.plans import regions

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    top = 12 * 4**3
    rows = [(0,), (1,), (2,), (top,), (top + 1,), (5 * top,)]
    found = regions.regions(spark.createDataFrame(rows, "outer_pix long"), 3)
    assert {tuple(r) for r in found.collect()} == {(0, 0, 2), (1, 0, 2), (2, 0, 2), (top, top, 0), (top + 1, top + 1, 0), (5 * top, 5 * top, 0)}
    assert "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()  # of a checkpoint, which keeps what is known of its plan
