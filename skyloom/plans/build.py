"""Build orchestration: passes, work planning, states, runs that resume, inspection and comparison."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import LAYOUT_VERSION, STATES, LoadRequest, SearchConfig, pass_identity, pass_path
from ..functions import cells
from ..operators import loader, products, scoring, search
from ..sources import artifacts, digests, stars
from ..sources.log import StateLog, latest
from ..sources.prewarm import STAR_BYTES, PreWarm
from ..sources.work import Work
from . import regions

ALGORITHM, VERSION = "guide-star-groups", "1"


def _now() -> str:
    return datetime.now(UTC).isoformat()


def create_pass(spark: SparkSession, root: str, cfg: SearchConfig = SearchConfig(), request: LoadRequest = LoadRequest(), scorer: scoring.Scorer | None = None) -> str:
    """Write the manifest of a pass and return its id; the same inputs give the same pass."""
    identity = (scorer or scoring.HeuristicScorer()).identity
    pass_id = pass_identity(ALGORITHM, VERSION, cfg, request.release, request.outer_level, identity)
    if artifacts.read_manifest(spark, root, pass_id).isEmpty():
        artifacts.write_manifest(
            spark,
            root,
            {"pass_id": pass_id, "algorithm": ALGORITHM, "algorithm_version": VERSION, "config": cfg.as_map(), "release": request.release, "outer_level": request.outer_level, "scorer": identity, "layout_version": LAYOUT_VERSION, "created_at": _now(), "completed_at": None},
        )
    return pass_id


def plan_universe(spark: SparkSession, level: int, excluded: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """outer_pix of the cells to process: all of the level, or those that ``held`` names, less the excluded ones."""
    out = spark.range(cells.npix(level)).withColumnRenamed("id", "outer_pix") if held is None else held.select("outer_pix").distinct()
    return out if excluded is None else out.join(excluded.select("outer_pix"), "outer_pix", "left_anti")


def record(events: DataFrame, root: str, pass_id: str) -> None:
    """Append state events (outer_pix, state, ts, seq, note) as one commit of the pass's log."""
    StateLog(events.sparkSession, root, pass_id).record(events)


def read_events(spark: SparkSession, root: str, pass_id: str) -> DataFrame:
    return StateLog(spark, root, pass_id).events()


def unfinished(universe: DataFrame, states: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Cells of the universe that are not done or excluded, nor failed (unless these are tried again). A cell left
    running counts as unfinished."""
    ended = ("done", "excluded") + (() if retry_failed else ("failed",))
    return universe.join(states.where(F.col("state").isin(*ended)).select("outer_pix"), "outer_pix", "left_anti")


def traverse(work: DataFrame) -> DataFrame:
    """outer_pix and place of the work in neighbour-first order: that of the nested number, a curve on which most cells
    follow one that they touch."""
    return balance(work.select("outer_pix").distinct().withColumn("weight", F.lit(1).cast("long")), 1).select("outer_pix", F.col("before").alias("place"))


def balance(weighted: DataFrame, shares: int, section_bits: int = 12) -> DataFrame:
    """Contiguous shares of about equal weight: floor(weight before * shares / total weight).

    The running sum is in two levels (cells within sections of the nested number, then sections), so no task holds all cells.
    """
    section = F.shiftright("outer_pix", section_bits)
    rows = weighted.withColumn("section", section)
    sums = rows.groupBy("section").agg(F.sum("weight").alias("w"))
    w = Window.orderBy("section")
    offsets = sums.select("section", (F.sum("w").over(w) - F.col("w")).alias("offset"), F.sum("w").over(Window.partitionBy()).alias("total"))
    own = F.sum("weight").over(Window.partitionBy("section").orderBy("outer_pix").rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")
    out = rows.withColumn("own", own).join(offsets, "section")
    share = F.least(F.floor((F.col("own") + F.col("offset")) * shares / F.col("total")), F.lit(shares - 1)).cast("int")
    return out.select("outer_pix", "weight", (F.col("own") + F.col("offset")).alias("before"), share.alias("share"))


def progress(universe: DataFrame, states: DataFrame) -> DataFrame:
    """Cells by state; those without an event are pending."""
    named = universe.join(states.select("outer_pix", "state"), "outer_pix", "left").withColumn("state", F.coalesce("state", F.lit("pending")))
    return named.groupBy("state").agg(F.count("*").alias("n_cells"))


def build_cells(star_rows: DataFrame, work: DataFrame, cfg: SearchConfig, scorer: scoring.Scorer, band: str = "R", epoch: float = 2016.0, hold=search.held) -> tuple[DataFrame, DataFrame]:
    """(inner product, groups) of the cells in ``work``. Stars of the cells around come along for the search; a group is
    given by the cell that holds its centre, so it comes once."""
    prepared = loader.with_band(loader.at_epoch(star_rows, epoch), band)
    own = prepared.join(work.select("outer_pix"), "outer_pix", "left_semi")
    inner = products.inner_product(own.where("mag is not null").select("ra", "dec", "mag"), cfg.outer_level, cfg.inner_level)
    guides = loader.guide_stars(star_rows, cfg, band, epoch)
    return inner, search.best_groups(guides, cfg, scorer, cfg.top_k, work, lambda groups: search.geom_filter(groups, cfg), hold)


def open_cells(inputs: DataFrame, states: DataFrame, retry_failed: bool = False, attempts: int | None = None) -> DataFrame:
    """Cells of ``inputs`` (outer_pix, input) that are to be built: those whose last ``done`` event names another input, that were never done,
    whose lease has ended, or that failed (if these are tried again, fewer than ``attempts`` times)."""
    F_state, live = F.col("state"), (F.col("state") == "running") & (F.col("lease_until") >= F.current_timestamp())
    tried = (F_state == "failed") & (F.lit(not retry_failed) | (F.lit(False) if attempts is None else F.coalesce("attempt", F.lit(0)) >= attempts))
    ended = ((F_state == "done") & (F.col("note") == F.col("input"))) | (F_state == "excluded") | live | tried
    seen = inputs.join(states.select("outer_pix", "state", "note", "lease_until", "attempt"), "outer_pix", "left")
    return seen.where(~F.coalesce(ended, F.lit(False))).select("outer_pix", "input")


def run(
    spark: SparkSession,
    root: str,
    pass_id: str,
    cfg: SearchConfig = SearchConfig(),
    request: LoadRequest = LoadRequest(),
    scorer: scoring.Scorer | None = None,
    batches: int = 4,
    retry_failed: bool = False,
    stop_after: int | None = None,
    excluded: DataFrame | None = None,
    at_once: int = 2,
    lease_seconds: float = 3600.0,
    attempts: int | None = 5,
    by_region: bool = False,
    prewarm_bytes: int = 0,
) -> DataFrame:
    """Build what is unfinished, in batches of neighbouring cells balanced by predicted work; returns the progress.

    ``at_once`` batches are under way together, and the next begins when any of them ends, so no batch waits for the slowest
    task of another. A batch first takes its cells in the log (``StateLog.claim``), so runs of one pass at the same time build each cell once;
    each takes what the others have not. Then it writes its artifacts (replacing those of its cells), and then its ``done`` events, so a crash
    can only cause work to be done again, after the lease. A batch that fails leaves ``failed`` events with the error, and the others go on; its
    cells are built again by ``retry_failed``, ``attempts`` times at most. Cells of ``excluded`` (outer_pix) get that state and are not built.
    ``stop_after`` ends after so many batches. ``by_region`` orders the cells by connected regions of open ones (``regions.in_order``).
    With ``prewarm_bytes`` the stars of the next batches are loaded into the executors' storage while a batch runs, as far as they fit under so many bytes
    (``sources.prewarm``); they go when their batch ends.

    A ``done`` event names what its cell was built from: the digests of its own stars and of those around it. After a change of the store a run builds
    the cells again whose digest, or whose neighbour's, is another one.
    """
    if cfg.outer_level != request.outer_level:
        raise ValueError(f"the search is planned by cells of level {cfg.outer_level}, the stars are stored by level {request.outer_level}")
    scorer = scorer or scoring.HeuristicScorer()
    level, owner, log, work = request.outer_level, uuid.uuid4().hex, StateLog(spark, root, pass_id), Work(spark, root)
    all_stars = stars.read_stars(spark, root, request.release, level)
    known = digests.read_digests(spark, root, request.release, level, all_stars)
    needs = digests.inputs(known, level).join(digests.predicted_work(known, level, cfg.radius_arcsec), "outer_pix")
    needs = work.write(needs)
    if excluded is not None:
        log.exclude(excluded.select("outer_pix").distinct().join(needs, "outer_pix", "left_semi"))
    events = log.events()
    before = latest(events).select("outer_pix")
    todo = open_cells(needs, latest(events), retry_failed, attempts).join(needs.select("outer_pix", "weight"), "outer_pix")
    ordered = regions.in_order(todo, level, batches, work.write) if by_region else balance(todo.select("outer_pix", "weight"), batches)
    shares = ordered.select("outer_pix", "share").join(todo.select("outer_pix", F.col("input").alias("note")), "outer_pix").join(before.withColumn("again", F.lit(True)), "outer_pix", "left")
    shares = work.write(shares)
    warm = PreWarm(prewarm_bytes)

    def around(own: DataFrame) -> DataFrame:
        ring = cells.neighbours_of(own.select(F.col("outer_pix").alias("pix")), level).select(F.col("nbr").alias("outer_pix"))
        return own.unionByName(ring).distinct()

    def size(share: int) -> int:
        """Bytes of the stars in and around a batch's cells."""
        near = around(shares.where(F.col("share") == share).select("outer_pix")).join(known.select("outer_pix", "n"), "outer_pix")
        return STAR_BYTES * (near.agg(F.sum("n").alias("n")).first()["n"] or 0)

    def batch(share: int) -> None:
        if prewarm_bytes > 0:
            for then in order[order.index(share) + 1 :][:at_once]:
                warm.ahead(then, size(then), lambda then=then: all_stars.join(around(shares.where(F.col("share") == then).select("outer_pix")), "outer_pix", "left_semi"))
        try:
            build_batch(share)
        finally:
            warm.release(share)

    def build_batch(share: int) -> None:
        asked = shares.where(F.col("share") == share)
        taken = log.claim(asked.select("outer_pix", "note"), owner, lease_seconds, attempts).select("outer_pix", "note")
        if taken.isEmpty():
            return
        kept: list[DataFrame] = []

        def hold(df: DataFrame) -> DataFrame:
            kept.append(search.held(df))
            return kept[-1]

        try:
            own = taken.select("outer_pix")
            near = warm.take(share, all_stars).join(around(own), "outer_pix", "left_semi")
            made = build_cells(near, own, cfg, scorer, request.band, request.epoch, hold)
            rebuilt = asked.where("again").join(own, "outer_pix", "left_semi").select("outer_pix")
            for kind, rows in zip(("inner", "asterisms"), map(hold, made), strict=True):
                artifacts.write_artifact(rows, root, pass_id, kind)
                # a cell that has no rows any more is not replaced by the write, and goes after it
                artifacts.clear_cells(spark, root, pass_id, kind, rebuilt.join(rows, "outer_pix", "left_anti"))
        except Exception as error:  # whatever stops a batch is told by its cells' state, and the others go on
            log.finish(taken.select("outer_pix", F.lit(str(error)[:1000]).alias("note")), owner, "failed")
        else:
            log.finish(taken, owner, "done")
        finally:
            for df in kept:
                df.unpersist()

    order = [r["share"] for r in shares.select("share").distinct().orderBy("share").collect()][:stop_after]
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        list(pool.map(batch, order))
    warm.close()
    version = log.version()
    states = latest(log.events(version))
    done = needs.join(states, "outer_pix", "left").where("state is null or (state <> 'excluded' and (state <> 'done' or note <> input))").isEmpty()
    if done and (order or artifacts.read_manifest(spark, root, pass_id).where("completed_at is not null").isEmpty()) and log.once(f"finish-{version}"):
        _finish(spark, root, pass_id, cfg)
    counts = progress(needs.select("outer_pix"), states).collect()  # a row for each state
    work.close()
    return spark.createDataFrame(counts, "state string, n_cells long")


def resume(*args, **kwargs) -> DataFrame:
    """Build what a stopped run left: a run is planned from the states, so it is the same call."""
    return run(*args, **kwargs)


def _states(work: DataFrame, root: str, pass_id: str, state: str, note: str | None = None) -> None:
    record(work.select("outer_pix", F.lit(state).alias("state"), F.current_timestamp().alias("ts"), F.lit(STATES.index(state)).cast("long").alias("seq"), F.lit(note).cast("string").alias("note")), root, pass_id)


def add_overlay(spark: SparkSession, root: str, pass_id: str, boxes: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """Store which cells of a pass's map lie in which survey's boxes, and return the stored overlay (level, pix, survey)."""
    artifacts.write_overlay(products.survey_cells(boxes, levels), root, pass_id)
    return artifacts.read_overlay(spark, root, pass_id)


def _finish(spark: SparkSession, root: str, pass_id: str, cfg: SearchConfig) -> None:
    """Aggregate the maps and complete the manifest."""
    inner = artifacts.read_inner(spark, root, pass_id)
    artifacts.write_map(products.aggregate_map(inner, cfg.inner_level, cfg.map_levels), root, pass_id)
    manifest = artifacts.read_manifest(spark, root, pass_id).first().asDict()
    artifacts.write_manifest(spark, root, manifest | {"completed_at": _now()})


def inspect(spark: SparkSession, root: str, pass_id: str) -> DataFrame:
    """The manifest with the count of cells in each state."""
    counts = latest(read_events(spark, root, pass_id)).agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in STATES]).withColumn("pass_id", F.lit(pass_id))
    return artifacts.read_manifest(spark, root, pass_id).join(counts, "pass_id", "left")


def compare(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows of two passes that differ: ``only_left``, ``only_right`` or ``changed``. Null-safe on keys and values."""
    a = left.select(*[F.col(k).alias(f"a_{k}") for k in key], F.struct(*values).alias("a"), F.lit(True).alias("in_a"))
    b = right.select(*[F.col(k).alias(f"b_{k}") for k in key], F.struct(*values).alias("b"), F.lit(True).alias("in_b"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    both = a.join(b, on, "full_outer")
    kind = F.when(F.col("in_b").isNull(), "only_left").when(F.col("in_a").isNull(), "only_right").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in key], kind.alias("difference")).where("difference is not null")


MEMBERS = ("g1", "g2", "g3")


def compare_groups(left: DataFrame, right: DataFrame, radius_arcsec: float, values: list[str]) -> DataFrame:
    """Groups of two passes that differ: g1..g3 of the left pass, h1..h3 of the right one, difference and sep.

    Groups of the same stars are ``changed`` if a value differs. Of the others, a group is ``moved`` to the group of the other pass that is its mutual nearest
    within the radius (sep, arcsec), even if other stars make it; the rest is ``only_left`` or ``only_right``.
    """
    keyed = [df.select(F.struct(*[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in MEMBERS]).alias("id"), "ra", "dec", F.struct(*values).alias("v")) for df in (left, right)]
    same = keyed[0].select("id", F.col("v").alias("v1")).join(keyed[1].select("id", F.col("v").alias("v2")), "id")
    alone = [df.join(same, "id", "left_anti") for df in keyed]
    moved = search.cross_match(*alone, radius_arcsec).where("mutual").select("id1", "id2", "sep")
    none, missing = F.lit(None).cast("double"), F.lit(None).cast(keyed[0].schema["id"].dataType)
    changed = same.where(~F.col("v1").eqNullSafe(F.col("v2"))).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit("changed").alias("difference"), none.alias("sep"))
    out = changed.unionByName(moved.select(F.col("id1").alias("a"), F.col("id2").alias("b"), F.lit("moved").alias("difference"), "sep"))
    gone = alone[0].join(moved.select(F.col("id1").alias("id")), "id", "left_anti").select(F.col("id").alias("a"), missing.alias("b"), F.lit("only_left").alias("difference"), none.alias("sep"))
    new = alone[1].join(moved.select(F.col("id2").alias("id")), "id", "left_anti").select(missing.alias("a"), F.col("id").alias("b"), F.lit("only_right").alias("difference"), none.alias("sep"))
    out = out.unionByName(gone).unionByName(new)
    return out.select(*[F.nullif(F.col(f"a.{c}"), F.lit(-1)).alias(c) for c in MEMBERS], *[F.nullif(F.col(f"b.{c}"), F.lit(-1)).alias(c.replace("g", "h")) for c in MEMBERS], "difference", "sep")


BENCH_FIELDS = ("location", "cache_target", "staging", "region", "workers", "temperature", "seconds", "n_cells", "n_stars", "n_groups", "at")


def bench(spark: SparkSession, root: str, pass_id: str, **fields) -> None:
    """Append a benchmark record: location, cache target, staging mode, region, workers, cold or warm, seconds, and what was built."""
    row = {n: None if fields.get(n) is None else str(fields[n]) for n in BENCH_FIELDS}
    spark.createDataFrame([row | {"at": _now()}], ", ".join(f"{n} string" for n in BENCH_FIELDS)).coalesce(1).write.mode("append").parquet(pass_path(root, pass_id, "bench"))


def bench_run(spark: SparkSession, root: str, pass_id: str, cfg: SearchConfig = SearchConfig(), request: LoadRequest = LoadRequest(), prewarm_bytes: int = 0, **options) -> DataFrame:
    """``run``, timed: appends a record of what the run was given, what it took, and the cells, stars and groups that the pass then holds."""
    began = time.monotonic()
    states = run(spark, root, pass_id, cfg, request, prewarm_bytes=prewarm_bytes, **options)
    seconds = time.monotonic() - began
    known = digests.read_digests(spark, root, request.release, request.outer_level).join(latest(read_events(spark, root, pass_id)).where("state = 'done'"), "outer_pix", "left_semi")
    held = known.agg(F.count("*").alias("n_cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_stars")).first()
    where = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    bench(
        spark, root, pass_id, location=where, cache_target="executors" if prewarm_bytes else "none", staging="prewarm" if prewarm_bytes else "none", region=f"{request.release}/level-{request.outer_level}",
        workers=spark.sparkContext.defaultParallelism, temperature="warm" if prewarm_bytes else "cold", seconds=seconds, n_cells=held["n_cells"], n_stars=held["n_stars"],
        n_groups=artifacts.read_asterisms(spark, root, pass_id).count(),
    )
    return states


def read_bench(spark: SparkSession, root: str, pass_id: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{n} string" for n in BENCH_FIELDS)).parquet(pass_path(root, pass_id, "bench"))


def bench_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("location", "workers", "temperature").agg(F.count("*").alias("n"), F.expr("percentile_approx(cast(seconds as double), 0.5)").alias("median_seconds"))
