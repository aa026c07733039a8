"""Registered sky queries over the driver's tables. Each applies the engine's own operators; ``oracle`` has their SQL.

No star table comes with the data, so stars are derived from ``orders`` by whole-number arithmetic: a patch of 10 by 10
degrees, and a view of the whole sky. Footprints come from ``nation`` and ``region``, build states from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import SearchConfig
from ..functions import cells, geometry
from ..operators import crowds, loader, products, scoring, search
from . import build, oracle

CFG = SearchConfig()
GROUPS = SearchConfig(sizes=(2, 3))


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(table="{t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.canonical(_view(spark, sf_dir, "orders", oracle.PATCH))


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", oracle.SKY)


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    return spark.sql(oracle.FOOTPRINTS.format(nation="{n}", region="{r}"), n=nation, r=region)


def build_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", oracle.EVENTS)


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.guide_stars(patch(spark, sf_dir), CFG)


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _halved(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """``_rounded`` of very many rows."""
    return df.withColumns({c: geometry.half_up(F.col(c), d) for c, d in digits.items()})


def _members(df: DataFrame) -> DataFrame:
    """Groups with -1 for the members that they lack."""
    return df.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("g2", "g3")})


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = SearchConfig(sizes=(2,), radius_arcsec=600.0, max_side_arcsec=600.0)
    found = search.candidates(loader.guide_stars(patch(spark, sf_dir), cfg), cfg)
    return search.count_by_pix(found)


# loader


def star_projection(spark, sf_dir):
    return patch(spark, sf_dir)


def proper_motion(spark, sf_dir):
    moved = loader.at_epoch(patch(spark, sf_dir), 2030.5).select("gaia_id", "ra", "dec")
    return _rounded(moved, {"ra": 9, "dec": 9})


def working_band(spark, sf_dir):
    return _rounded(loader.with_band(patch(spark, sf_dir), "R").select("gaia_id", "mag"), {"mag": 6})


def quality_filter(spark, sf_dir):
    return loader.quality(patch(spark, sf_dir)).select("gaia_id")


def guide_stars(spark, sf_dir):
    return _rounded(guides(spark, sf_dir), {"mag": 6})


def working_bands(spark, sf_dir):
    """All stored and working bands."""
    stars = patch(spark, sf_dir)
    return stars.select("gaia_id", *[F.round(loader.band_column(b), 6).alias(f"mag_{b}") for b in (*loader.STORED_BANDS, *loader.BANDS)])


def stitched_load(spark, sf_dir):
    """Stars in and around each level-6 cell that holds a star."""
    stars = patch(spark, sf_dir)
    wanted = stars.select(cells.ang2pix(F.col("gaia_ra"), F.col("gaia_dec"), 6).alias("pix"))
    return loader.load_stitched(stars, wanted, 6).select("pix", "gaia_id", "own")


# sky cells


def ang2pix_l6(spark, sf_dir):
    return sky(spark, sf_dir).select("gaia_id", cells.ang2pix(F.col("ra"), F.col("dec"), 6).alias("pix"))


def ang2pix_l14(spark, sf_dir):
    return sky(spark, sf_dir).select("gaia_id", cells.ang2pix(F.col("ra"), F.col("dec"), 14).alias("pix"))


def parent_pixel(spark, sf_dir):
    at = sky(spark, sf_dir).select("gaia_id", cells.ang2pix(F.col("ra"), F.col("dec"), 10).alias("pix"))
    return at.select("gaia_id", cells.parent(F.col("pix"), 10, 6).alias("pix"))


def _sky_cells(spark, sf_dir, level: int) -> DataFrame:
    """The cells (pix) that hold stars."""
    return cells.with_cell(sky(spark, sf_dir), "ra", "dec", level, "pix").select("pix").distinct()


def children(spark, sf_dir):
    return _sky_cells(spark, sf_dir, 3).select("pix", F.explode(cells.children(F.col("pix"), 3, 5)).alias("child"))


def pix2ang(spark, sf_dir):
    """Centres of the cells that hold stars."""
    return _rounded(cells.with_centre(_sky_cells(spark, sf_dir, 6), "pix", 6, "ra", "dec"), {"ra": 9, "dec": 9})


def neighbours(spark, sf_dir):
    return cells.neighbours_of(_sky_cells(spark, sf_dir, 4), 4)


def traversal(spark, sf_dir):
    """Cells with stars in neighbour-first order, with their place."""
    return build.traverse(sky(spark, sf_dir).select(cells.ang2pix(F.col("ra"), F.col("dec"), 5).alias("outer_pix")))


def cell_helpers(spark, sf_dir):
    """Size of the cells of each level, how many hold stars, and the density in those."""
    fine = cells.with_cell(sky(spark, sf_dir), "ra", "dec", 12, "pix").groupBy("pix").agg(F.count("*").alias("n"))
    levels = [F.struct(F.lit(k).alias("level"), F.lit(cells.nside(k)).cast("long").alias("nside"), F.lit(cells.npix(k)).cast("long").alias("npix"), F.lit(cells.cell_area_deg2(k)).alias("area"), F.lit(cells.resolution_arcsec(k)).alias("resolution"), cells.parent(F.col("pix"), 12, k).alias("pix")) for k in range(13)]
    filled = fine.select(F.explode(F.array(*levels)).alias("at"), "n").groupBy("at").agg(F.sum("n").alias("n"))
    out = filled.groupBy("at.level", "at.nside", "at.npix", "at.area", "at.resolution").agg(F.count("*").alias("n_filled"), F.sum("n").alias("n"))
    return _rounded(out.withColumn("density", F.col("n") / (F.col("n_filled") * F.col("area"))).drop("n"), {"area": 9, "resolution": 6, "density": 6})


def separation(spark, sf_dir):
    """Separation and bearing of each star to the next one."""
    a = sky(spark, sf_dir)
    b = a.select((F.col("gaia_id") - 1).alias("gaia_id"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    both = a.join(b, "gaia_id")
    args = [F.col(c) for c in ("ra", "dec", "ra2", "dec2")]
    return both.select("gaia_id", F.round(geometry.separation(*args), 4).alias("sep"), F.round(geometry.bearing(*args), 6).alias("bearing"))


# groups


def singles(spark, sf_dir):
    return _rounded(search.singles(guides(spark, sf_dir)).select("g1", "m1"), {"m1": 6})


def pairs(spark, sf_dir):
    return _rounded(search.pairs(guides(spark, sf_dir), CFG.radius_arcsec, CFG.min_separation_arcsec).select("g1", "g2", "sep12"), {"sep12": 4})


def triples(spark, sf_dir):
    found = crowds.groups(guides(spark, sf_dir), SearchConfig(sizes=(3,)), ("g1", "g2", "g3", "sep12", "sep13", "sep23"))
    return _halved(found, {"sep12": 4, "sep13": 4, "sep23": 4})


def candidates(spark, sf_dir):
    return _members(crowds.groups(guides(spark, sf_dir), CFG, ("size", "g1", "g2", "g3")))


def star_count(spark, sf_dir):
    return crowds.count_by_pix(guides(spark, sf_dir), CFG)


def group_geometry(spark, sf_dir):
    found = crowds.groups(guides(spark, sf_dir), GROUPS, ("g1", "g2", "g3", "ra", "dec", "max_side", "area", "circumradius"))
    return _halved(_members(found), {"ra": 7, "dec": 7, "max_side": 4, "area": 2, "circumradius": 3})


def geom_filter(spark, sf_dir):
    cfg = SearchConfig(sizes=(2, 3), max_side_arcsec=90.0, min_area_arcsec2=500.0)
    return _members(crowds.groups(guides(spark, sf_dir), cfg, ("size", "g1", "g2", "g3"), keep=True))


def scored_groups(spark, sf_dir, cfg=GROUPS) -> DataFrame:
    return scoring.HeuristicScorer().score(search.candidates(guides(spark, sf_dir), cfg))


def heuristic_score(spark, sf_dir):
    return _halved(_members(crowds.groups(guides(spark, sf_dir), CFG, ("g1", "g2", "g3", "score"), scorer=scoring.HeuristicScorer())), {"score": 6})


def _weighted(batch):
    return (batch["flux"] * (batch["area"] / batch["max_side"] ** 2).where(batch["size"] == 3, 1.0)).round(9)


def scorer_plugin(spark, sf_dir):
    """The heuristic as a batch scorer: the seam for learned models."""
    plugin = scoring.BatchScorer("heuristic-batch-1", ("size", "flux", "area", "max_side"), _weighted)
    return _halved(_members(crowds.groups(guides(spark, sf_dir), CFG, ("g1", "g2", "g3", "score"), scorer=plugin)), {"score": 6})


def topk_per_pixel(spark, sf_dir):
    return _members(search.best_groups(guides(spark, sf_dir), GROUPS, scoring.HeuristicScorer(), 5).select("outer_pix", "rank", "g1", "g2", "g3"))


def overlap_pairs(spark, sf_dir):
    found = search.overlaps(scored_groups(spark, sf_dir), 60.0)
    return found.select(F.col("a.g1").alias("a1"), F.col("a.g2").alias("a2"), F.col("a.g3").alias("a3"), F.col("b.g1").alias("b1"), F.col("b.g2").alias("b2"), F.col("b.g3").alias("b3"), (F.col("better") == F.col("a")).alias("a_better"))


def overlap_suppressed(spark, sf_dir):
    return _members(crowds.suppress(guides(spark, sf_dir), GROUPS, scoring.HeuristicScorer(), 60.0).select("g1", "g2", "g3"))


def coverage(spark, sf_dir):
    """Level-10 cells around triples, and how many groups cover each."""
    found = crowds.triple_coverage(guides(spark, sf_dir), CFG, 10, 120.0)
    return found.groupBy("pix").agg(F.sum("n").alias("n_groups"), F.countDistinct("g1").alias("n_first"))


# products


def _inner(spark, sf_dir):
    return products.inner_product(guides(spark, sf_dir), 6, 10)


def inner_product(spark, sf_dir):
    return _rounded(_inner(spark, sf_dir), {"density": 6, "brightest": 6})


def density_map(spark, sf_dir):
    return _rounded(products.aggregate_map(_inner(spark, sf_dir), 10, (6, 3)), {"brightest": 6, "flux": 3})


def map_lookup(spark, sf_dir):
    sky_map = products.aggregate_map(_inner(spark, sf_dir), 10, (6,))
    points = patch(spark, sf_dir).select("gaia_id", F.col("gaia_ra").alias("ra"), F.col("gaia_dec").alias("dec"))
    found = products.map_data(sky_map, 6, points)
    return found.select("gaia_id", "pix", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_stars", "n_cells")])


def _overlaid(spark, sf_dir):
    sky_map = products.aggregate_map(_inner(spark, sf_dir), 10, (7, 6))
    return products.overlay(sky_map, products.survey_cells(footprints(spark, sf_dir), (7, 6)))


def survey_overlay(spark, sf_dir):
    return _overlaid(spark, sf_dir).select("level", "pix", "survey", "inside", "n_stars")


def survey_summary(spark, sf_dir):
    return products.summarise(_overlaid(spark, sf_dir)).withColumn("level", F.coalesce("level", F.lit(-1)))


# builds


def state_latest(spark, sf_dir):
    return build.latest(build_events(spark, sf_dir)).select("outer_pix", "state", "n_events")


def _universe(spark: SparkSession, states: DataFrame) -> DataFrame:
    """The cells of level 2, and those of the states that are beyond them."""
    return build.plan_universe(spark, 2).unionByName(states.where("outer_pix is not null").select("outer_pix")).distinct()


def state_summary(spark, sf_dir):
    states = build.latest(build_events(spark, sf_dir))
    return build.progress(_universe(spark, states), states)


def unfinished(spark, sf_dir):
    states = build.latest(build_events(spark, sf_dir))
    return build.unfinished(_universe(spark, states), states)


def balance(spark, sf_dir):
    held = sky(spark, sf_dir).select(cells.ang2pix(F.col("ra"), F.col("dec"), 5).alias("outer_pix")).groupBy("outer_pix").agg(F.count("*").alias("weight"))
    return build.balance(held, 16)


def pass_compare(spark, sf_dir):
    """Inner products with and without the quality cut."""
    stars = patch(spark, sf_dir)
    a = products.inner_product(loader.guide_stars(stars, CFG), 6, 8).select("outer_pix", "inner_pix", "n_stars")
    b = products.inner_product(loader.guide_stars(stars, SearchConfig(max_ruwe=1.2)), 6, 8).select("outer_pix", "inner_pix", "n_stars")
    return build.compare(a, b, ["outer_pix", "inner_pix"], ["n_stars"])


def _root(spark: SparkSession, name: str) -> str:
    """A fresh folder for a pass below the shared one. Where none is set, a session whose tasks run in the driver gets a temporary
    one; on a cluster no folder of one machine would do."""
    import tempfile
    import uuid

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", "")
    master = spark.sparkContext.master
    if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = folder or tempfile.mkdtemp(prefix="skyloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def overlap_greedy(spark, sf_dir):
    """Best-first removal to its end; the one-step rule is ``overlap_suppressed``."""
    from ..sources.work import Work

    work = Work(spark, _root(spark, "greedy"))  # a checkpoint would keep constraints, which double in each round
    return _members(crowds.suppress_greedy(guides(spark, sf_dir), GROUPS, scoring.HeuristicScorer(), 60.0, work.write).select("g1", "g2", "g3"))


def manifest(spark, sf_dir):
    """A pass for each region, its search radius by the region, written and read back."""
    from ..sources import artifacts

    root = _root(spark, "manifest")
    for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").toLocalIterator():
        build.create_pass(spark, root, SearchConfig(radius_arcsec=60.0 + 10.0 * r["r_regionkey"]))
    found = artifacts.read_manifest(spark, root)
    return found.select("pass_id", "algorithm", "algorithm_version", "release", "outer_level", "scorer", "layout_version", F.col("config")["radius_arcsec"].alias("radius"), F.col("completed_at").isNull().alias("open"))


def stored_inner(spark, sf_dir):
    """The inner product, written as an artifact of a pass and read back."""
    from ..sources import artifacts

    root = _root(spark, "inner")
    artifacts.write_inner(_inner(spark, sf_dir), root, "p")
    return _rounded(artifacts.read_inner(spark, root, "p").select("outer_pix", "inner_pix", "n_stars", "density", "brightest", "flux"), {"density": 6, "brightest": 6})


def stored_map(spark, sf_dir):
    """The map at two levels, written as an artifact of a pass and read back."""
    from ..sources import artifacts

    root = _root(spark, "map")
    artifacts.write_map(products.aggregate_map(_inner(spark, sf_dir), 10, (6, 3)), root, "p")
    return _rounded(artifacts.read_map(spark, root, "p").select("level", "pix", "n_stars", "n_cells", "brightest", "flux"), {"brightest": 6, "flux": 3})


def stored_overlay(spark, sf_dir):
    """The survey cells of a pass, stored, read back and laid over its stored map."""
    from ..sources import artifacts

    root = _root(spark, "overlay")
    artifacts.write_map(products.aggregate_map(_inner(spark, sf_dir), 10, (7, 6)), root, "p")
    survey = build.add_overlay(spark, root, "p", footprints(spark, sf_dir), (7, 6))
    return products.overlay(artifacts.read_map(spark, root, "p"), survey).select("level", "pix", "survey", "inside", "n_stars")


def inspected_pass(spark, sf_dir):
    """A manifest and the number of its cells in each state, after the states of ``events`` are recorded."""
    root = _root(spark, "inspect")
    pass_id = build.create_pass(spark, root)
    build.record(build_events(spark, sf_dir).withColumn("note", F.lit(None).cast("string")), root, pass_id)
    return build.inspect(spark, root, pass_id).select("pass_id", "algorithm", *[f"n_{s}" for s in build.STATES])


def resumed_pass(spark, sf_dir):
    """A pass that is stopped after one batch and resumed: the groups that it has in the end."""
    from ..sources import artifacts, stars

    root = _root(spark, "pass")
    stars.write_stars(patch(spark, sf_dir), root, "dr3", 6)
    cfg = SearchConfig(sizes=(2,), outer_level=6)
    pass_id = build.create_pass(spark, root, cfg)
    build.run(spark, root, pass_id, cfg, batches=2, stop_after=1)
    build.resume(spark, root, pass_id, cfg, batches=2)
    return artifacts.read_asterisms(spark, root, pass_id).select("outer_pix", "rank", "g1", "g2")


ALL = (
    star_projection, proper_motion, working_band, working_bands, quality_filter, guide_stars, stitched_load, ang2pix_l6, ang2pix_l14, parent_pixel, children, pix2ang, cell_helpers,
    neighbours, traversal, separation, singles, pairs, triples, candidates, star_count, group_geometry, geom_filter, heuristic_score, scorer_plugin, topk_per_pixel,
    overlap_pairs, overlap_suppressed, overlap_greedy, coverage, inner_product, density_map, map_lookup, survey_overlay, survey_summary, state_latest, state_summary, unfinished, balance, pass_compare, manifest, resumed_pass,
    stored_inner, stored_map, stored_overlay, inspected_pass,
)


def queries():
    from . import build_queries, source_queries, survey_queries

    return {f.__name__: f for f in ALL} | survey_queries.queries() | build_queries.queries() | source_queries.queries()


def oracle_sql() -> dict[str, str]:
    from . import build_queries, source_queries, survey_queries

    return oracle.sql() | survey_queries.oracle_sql() | build_queries.oracle_sql() | source_queries.oracle_sql()
