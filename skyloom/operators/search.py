"""Guide-star groups: distance joins, geometry, filters, overlap and ranking.

The distance join lays a cubic grid of side twice the radius over the unit sphere. A point enters every grid cell that
its ball of half the radius touches, about 2.2 of them; two points within the radius both touch the cell of their
midpoint, and are paired there only. So no pair is made twice, and poles and the wrap of right ascension need no care. Both sides
are dealt by grid cell, whatever the size that the scan of a table promises: a cell's pairs are the work, not its rows. AQE splits
dense cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..contracts import SearchConfig
from ..functions import cells, geometry

_BITS = 20  # of each grid coordinate in a packed key


def _key(x: str, y: str, z: str) -> str:
    return f"(shiftleft(shiftleft({x}, {_BITS}) | {y}, {_BITS}) | {z})"


def _grid(value: str, side: float) -> str:
    return f"cast(floor(({value} + 1.0001D) / {side!r}D) as bigint)"


def _gridded(points: DataFrame, length: float, key: str, carry: tuple[str, ...], part: float = 0.5) -> DataFrame:
    """The points by the grid cells that a ball of ``part`` of the length touches: cell, k (the key), the carried columns and the unit vector. Expressions are
    SQL text, each one call to the JVM."""
    side, reach = _side(length), part * length * (1 + 1e-9) + (1e-15 if part else 0.0)
    x, y, z = geometry.unit_vec(F.col("ra"), F.col("dec"))
    at = cells.bound(points.where("ra is not null and dec is not null").select(F.col(key).alias("k"), *carry, "ra", "dec"), x=x, y=y, z=z).drop("ra", "dec")
    # the ball is narrower than a cell, so it touches one or two along each axis
    ends = cells.bound(at, **{f"_{a}{n}": F.expr(_grid(f"({a} {sign} {reach!r}D)", side)) for a in "xyz" for n, sign in enumerate("-+")})
    touched = ", ".join(_key(f"_x{i}", f"_y{j}", f"_z{k}") for i in (0, 1) for j in (0, 1) for k in (0, 1))
    return ends.select(F.expr(f"explode(array_distinct(array({touched})))").alias("cell"), *at.columns)


def _side(length: float) -> float:
    return max(2 * length, 2.1 / 2**_BITS)


def _met(left: DataFrame, right: DataFrame, length: float) -> DataFrame:
    """Pairs of gridded points within the chord, each in the cell of its midpoint, with the angle between them; columns end in 1 and 2."""
    side = _side(length)
    left, right = (df.withColumnsRenamed({c: f"{c}{n}" for c in df.columns if c != "cell"}) for n, df in ((1, left), (2, right)))
    one, two = tuple(F.col(f"{a}1") for a in "xyz"), tuple(F.col(f"{a}2") for a in "xyz")
    middle = _key(*[_grid(f"(({a}1 + {a}2) / 2)", side) for a in "xyz"])
    near = left.hint("merge").join(right, "cell").where(geometry.chord2(one, two) <= length**2)
    return near.where(f"cell = {middle}").drop("cell").withColumn("sep", geometry.sep_arcsec(one, two))


def close_pairs(points: DataFrame, radius_arcsec: float, key: str = "id", carry: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of points (key, ra, dec) within an angle, the lesser key first: key1, key2, the unit vectors and ``carry`` of both, sep."""
    length = geometry.chord(radius_arcsec)
    gridded = _gridded(points, length, key, carry)
    return _met(gridded, gridded, length).where("k1 < k2").withColumnsRenamed({"k1": f"{key}1", "k2": f"{key}2"})


def cross_match(left: DataFrame, right: DataFrame, radius_arcsec: float, key: str = "id", carry: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of a point of one table and a point of another one within an angle: key1, key2, ``carry`` of both, sep, rank1 (of the pair among those of
    its left point, by sep, then key), rank2 (among those of its right point), and mutual: each is the other's nearest.

    Both tables are (key, ra, dec); keys of one table are its own and may be equal to those of the other. Points without a position match none. Repeated keys
    are points of their own.

    Only points are shuffled: a task has the left points of its cells, the right points within the radius of these and the left points within the radius of those, so
    it knows both ranks of every pair of its own left points. The number of tasks follows from counts of points by cell.
    """
    length = geometry.chord(radius_arcsec)
    wide = 8 * length  # cells of 16 times the radius, so few points stand in two
    home = f"cell = {_key(*[_grid(a, _side(wide)) for a in 'xyz'])}"
    near, around = (_gridded(df, wide, key, carry, part) for df, part in ((left, 0.25), (right, 0.125)))
    counts = [df.where(home).groupBy("cell").agg(F.count("*").alias(f"n{n}")) for n, df in ((1, near), (2, around))]
    met = counts[0].join(counts[1], "cell").agg(F.sum(F.col("n1").cast("double") * F.col("n2"))).first()[0] or 0.0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(met / 60 / TASK_PAIRS))
    near, around = (df.withColumnsRenamed({c: f"{c}{n}" for c in df.columns if c not in ("cell", "own")}).repartition(tasks, "cell") for n, df in ((1, near.withColumn("own", F.expr(home))), (2, around)))
    one, two = (tuple(F.col(f"{a}{n}") for a in "xyz") for n in (1, 2))
    found = near.hint("merge").join(around, "cell").where(geometry.chord2(one, two) <= length**2).withColumn("sep", geometry.sep_arcsec(one, two))
    for n, other in ((1, "k2"), (2, "k1")):
        found = found.withColumn(f"rank{n}", F.row_number().over(Window.partitionBy("cell", f"k{n}", *[f"{a}{n}" for a in "xyz"]).orderBy("sep", other)))
    found = found.where("own").drop("cell", "own", *[f"{a}{n}" for a in "xyz" for n in "12"])
    return found.withColumn("mutual", (F.col("rank1") == 1) & (F.col("rank2") == 1)).withColumnsRenamed({"k1": f"{key}1", "k2": f"{key}2"})


def singles(stars: DataFrame) -> DataFrame:
    x, y, z = geometry.unit_vec(F.col("ra"), F.col("dec"))
    return stars.select(F.lit(1).alias("size"), F.col("gaia_id").alias("g1"), F.col("mag").alias("m1"), x.alias("x1"), y.alias("y1"), z.alias("z1"))


def pairs(stars: DataFrame, radius_arcsec: float, min_separation_arcsec: float = 0.0) -> DataFrame:
    """Two stars within the radius: g1 < g2, magnitudes, vectors, sep12."""
    found = close_pairs(stars.withColumnRenamed("gaia_id", "g"), radius_arcsec, "g", ("mag",))
    found = found.withColumnsRenamed({"mag1": "m1", "mag2": "m2", "sep": "sep12"}).withColumn("size", F.lit(2))
    return found.where(F.col("sep12") >= min_separation_arcsec) if min_separation_arcsec else found


def triples(found: DataFrame, radius_arcsec: float, min_separation_arcsec: float = 0.0) -> DataFrame:
    """Three stars within the radius of each other, from their pairs: one shuffle of the pairs, by first star. ``star_triples`` makes them from stars."""
    return _triples_of(_listed(found), radius_arcsec, min_separation_arcsec)


_FIRST, _SECOND = ("g1", "m1", "x1", "y1", "z1"), ("g2", "m2", "x2", "y2", "z2", "sep12")


def _listed(found: DataFrame, *by: str) -> DataFrame:
    """The first star of pairs with the list (near) of its second stars. Pairs that are dealt by ``by`` are not dealt again."""
    return found.groupBy(*by, *_FIRST).agg(F.collect_list(F.struct(*_SECOND)).alias("near")).drop(*by)


def _triples_of(listed: DataFrame, radius_arcsec: float, min_separation_arcsec: float) -> DataFrame:
    """The triples of each first star and two stars of its list; the third side is measured from the vectors. Rows come as they are made."""
    two = listed.select(*_FIRST, F.explode("near").alias("b"), "near").select(*_FIRST, "b", F.explode("near").alias("c"))
    b, c = (tuple(F.col(f"{end}.{a}2") for a in "xyz") for end in "bc")
    two = two.where((F.col("b.g2") < F.col("c.g2")) & (geometry.chord2(b, c) <= geometry.chord(radius_arcsec) ** 2))
    third = [F.col(f"c.{n}").alias(n.replace("2", "3")) for n in _SECOND]
    out = two.select(*_FIRST, "b.*", *third, geometry.sep_arcsec(b, c).alias("sep23"), F.lit(3).alias("size"))
    return out.where(F.col("sep23") >= min_separation_arcsec) if min_separation_arcsec else out


#: Pairs that one task lists, about; more stars, or denser ones, make more tasks.
TASK_PAIRS = 1_000_000


def star_triples(stars: DataFrame, radius_arcsec: float, min_separation_arcsec: float = 0.0) -> DataFrame:
    """Three stars within the radius of each other, from the stars alone.

    Only stars are shuffled: each to the grid cell that holds it, and to those that its ball of the radius touches. A task then lists the neighbours of
    the stars of its cells and makes their triples one after the other, so nothing that grows faster than the stars is shuffled, held or spilled. The number of tasks
    follows from a count of the stars by cell: the squares of the counts tell the pairs.
    """
    length = geometry.chord(radius_arcsec)
    # cells of four times the radius, twice the side of a ball
    own, around = (_gridded(stars, 2 * length, "gaia_id", ("mag",), part) for part in (0.0, 0.5))
    squares = own.groupBy("cell").count().agg(F.sum(F.pow("count", F.lit(2.0)))).first()[0] or 0.0
    tasks = max(int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(squares / 10 / TASK_PAIRS))
    own, around = (df.withColumnsRenamed({"k": f"g{n}", "mag": f"m{n}"} | {a: f"{a}{n}" for a in "xyz"}).repartition(tasks, "cell") for n, df in ((1, own), (2, around)))
    one, two = (tuple(F.col(f"{a}{n}") for a in "xyz") for n in (1, 2))
    found = own.hint("merge").join(around, "cell").where((F.col("g1") < F.col("g2")) & (geometry.chord2(one, two) <= length**2)).withColumn("sep12", geometry.sep_arcsec(one, two))
    found = found.where(F.col("sep12") >= min_separation_arcsec) if min_separation_arcsec else found
    return _triples_of(_listed(found, "cell"), radius_arcsec, min_separation_arcsec)


def held(df: DataFrame) -> DataFrame:
    """``df``, kept on the executors for its later uses; a lost part is made again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _parts(stars: DataFrame, cfg: SearchConfig) -> list[DataFrame]:
    """The groups of each size. Each size is made from the stars, which costs a shuffle of them and holds nothing."""
    rules = (cfg.radius_arcsec, cfg.min_separation_arcsec)
    makers = {1: lambda: singles(stars), 2: lambda: pairs(stars, *rules), 3: lambda: star_triples(stars, *rules)}
    return [make() for size, make in makers.items() if size in cfg.sizes]


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def members(stars: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """size, g1, g2, g3 of all groups, without their shape."""
    return _united([part.select("size", *[F.col(c) if c in part.columns else F.lit(None).cast("long").alias(c) for c in ("g1", "g2", "g3")]) for part in _parts(stars, cfg)])


def candidates(stars: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Groups of all the sizes in one table; a group is (g1, g2, g3), null where it is smaller."""
    return _united([geometry_of(part, cfg) for part in _parts(stars, cfg)])


def geometry_of(groups: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Centre (ra, dec), cell, longest side, area and circumradius of groups, and the flux of their stars.

    Only the centre is bound before the cell is made; the shape and the flux come after it, so a query that asks for cells
    alone computes nothing else.
    """
    groups = _whole(groups)
    total = [F.col(f"{a}1") + F.coalesce(f"{a}2", F.lit(0.0)) + F.coalesce(f"{a}3", F.lit(0.0)) for a in "xyz"]
    ra, dec = geometry.ra_dec(*total)
    return shape_of(cells.with_cell(cells.bound(groups, ra=geometry.rounded(ra, 9), dec=geometry.rounded(dec, 9)), "ra", "dec", cfg.outer_level, "outer_pix"))


def _whole(groups: DataFrame) -> DataFrame:
    """Groups with all the columns of the largest ones."""
    missing = [c for c in ("g2", "g3", "m2", "m3", "x2", "y2", "z2", "x3", "y3", "z3", "sep12", "sep13", "sep23") if c not in groups.columns]
    return groups.withColumns({c: F.lit(None).cast("long" if c[0] == "g" else "double") for c in missing}) if missing else groups


def shape_of(groups: DataFrame) -> DataFrame:
    """Longest side, area and circumradius of groups, and the flux of their stars, without their place. A bound centre is computed even if nothing reads it."""
    groups = _whole(groups)
    a, b, c = (F.col(s) for s in ("sep12", "sep13", "sep23"))
    # Heron's rule on the plane: groups are arc minutes wide
    half = (a + b + c) / 2
    area = F.sqrt(F.greatest(F.lit(0.0), half * (half - a) * (half - b) * (half - c)))
    flux = sum((F.coalesce(F.pow(F.lit(10.0), -0.4 * (F.col(f"m{i}") - 15)), F.lit(0.0)) for i in (2, 3)), F.pow(F.lit(10.0), -0.4 * (F.col("m1") - 15)))
    out = groups.withColumns({"max_side": F.coalesce(F.greatest(a, b, c), F.lit(0.0)), "area": F.coalesce(area, F.lit(0.0)), "flux": flux})
    return out.withColumn("circumradius", F.when((F.col("size") == 3) & (F.col("area") > 0), a * b * c / (4 * F.col("area"))).otherwise(F.col("max_side") / 2))


def geom_filter(groups: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Groups no wider than the longest side allowed; triples with more than the least area."""
    return groups.where((F.col("max_side") <= cfg.max_side_arcsec) & ((F.col("size") < 3) | (F.col("area") > cfg.min_area_arcsec2)))


def _group_id() -> Column:
    return F.struct(F.col("g1"), F.coalesce("g2", F.lit(-1)).alias("g2"), F.coalesce("g3", F.lit(-1)).alias("g3"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best groups of each cell; ties by members. One shuffle on the cell, which Spark cuts to k rows before it."""
    order = [F.desc("score"), F.asc("g1"), F.asc_nulls_first("g2"), F.asc_nulls_first("g3")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("outer_pix").orderBy(*order))).where(F.col("rank") <= k)


#: Stars of a fine cell, the brightest, from whose groups the floor of a cell's score is known.
SEEDS = 16


def best_groups(stars: DataFrame, cfg: SearchConfig, scorer, k: int, work: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df, hold: Callable[[DataFrame], DataFrame] = held) -> DataFrame:
    """``top_k`` of the scored candidates that ``keep`` leaves, in the cells of ``work`` (outer_pix; all by default), without making those that cannot be among them.

    The kth best group of the brightest stars of each fine cell is a floor of the scores that count in its outer cell. A scorer with ``most`` tells how much of
    the summed flux of its stars a group can score, so a star whose flux, with the brightest stars near it, stays below the floor of all cells within the radius is in no
    group that counts. The stars left are searched as ever, so the result is that of the whole search. A cell whose brightest stars make fewer than k groups has no
    floor and all its stars are searched; so are those of a scorer without ``most``, and of cells narrower than the radius. ``hold`` keeps the stars with their cells, the floors and the stars left for their later uses.
    """

    def scored(some: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
        groups = keep(candidates(some, replace(cfg, sizes=sizes)))
        return scorer.score(groups if work is None else groups.join(work.select("outer_pix"), "outer_pix", "left_semi"))

    fine = max((n for n in range(cells.MAX_LEVEL + 1) if cells.resolution_arcsec(n) >= 2.5 * cfg.radius_arcsec), default=-1)
    if not hasattr(scorer, "most") or fine < cfg.outer_level:
        return top_k(scored(stars, cfg.sizes), k)
    at = cells.with_cell(stars.select("gaia_id", "ra", "dec", "mag"), "ra", "dec", fine, "_fine").withColumn("_flux", F.pow(F.lit(10.0), -0.4 * (F.col("mag") - 15)))
    at = hold(at)
    seeds = at.withColumn("_n", F.row_number().over(Window.partitionBy("_fine").orderBy("mag", "gaia_id"))).where(F.col("_n") <= SEEDS).drop("_n", "_fine", "_flux")
    seeds = hold(seeds)
    floors = top_k(scored(seeds, cfg.sizes), k).groupBy("outer_pix").agg(F.count("score").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    brightest = at.where("_fine is not null").groupBy(F.col("_fine").alias("nbr")).agg(F.max("_flux").alias("most"))
    own = brightest.select(F.col("nbr").alias("pix"))
    near = cells.neighbours_of(own, fine).select("pix", "nbr").unionByName(own.withColumn("nbr", F.col("pix"))).join(brightest, "nbr", "left")
    near = near.withColumn("outer_pix", cells.parent(F.col("nbr"), fine, cfg.outer_level)).join(floors.select("outer_pix", "floor"), "outer_pix", "left")
    floor = F.coalesce("floor", F.lit(0.0))
    if work is not None:  # no group of another cell counts
        near = near.join(work.select("outer_pix", F.lit(True).alias("asked")), "outer_pix", "left")
        floor = F.when(F.col("asked"), floor).otherwise(F.lit(math.inf))
    limits = near.groupBy(F.col("pix").alias("_fine")).agg(F.min(floor).alias("_floor"), F.max("most").alias("_most"))
    at = at.join(hold(limits), "_fine")

    def counts(size: int) -> Column:
        """Whether a star can be in a group of this size that counts; roundings are on its side."""
        least = (F.col("_floor") - 1e-8) / scorer.most(size) * (1 - 1e-9) - (size - 1) * F.col("_most") * (1 + 1e-9)
        return (F.col("_floor") <= 0) | F.isnan("_most") | (F.col("_flux") >= least)

    at = hold(at.where(reduce(lambda a, b: a | b, map(counts, cfg.sizes))))
    parts = [scored(at.where(counts(size)).select("gaia_id", "ra", "dec", "mag"), (size,)) for size in cfg.sizes]
    return top_k(_united(parts), k)


def overlaps(groups: DataFrame, radius_arcsec: float) -> DataFrame:
    """Pairs of groups whose centres are within the radius: a and b (members), sep, and the better of both."""
    named = groups.withColumn("id", _group_id())
    found = close_pairs(named, radius_arcsec, "id", ("score",))
    first = (F.col("score1") > F.col("score2")) | ((F.col("score1") == F.col("score2")) & (F.col("id1") < F.col("id2")))
    return found.select(F.col("id1").alias("a"), F.col("id2").alias("b"), "sep", F.when(first, F.col("id1")).otherwise(F.col("id2")).alias("better"))


def suppress(groups: DataFrame, radius_arcsec: float, hold: Callable[[DataFrame], DataFrame] = held) -> DataFrame:
    """Groups that no better group overlaps: one anti-join. The groups are read by both sides of the overlaps and by the anti-join, so ``hold`` keeps them."""
    groups = hold(groups)
    worse = overlaps(groups, radius_arcsec).select(F.when(F.col("better") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()
    return groups.withColumn("id", _group_id()).join(worse, "id", "left_anti").drop("id")


def suppress_greedy(groups: DataFrame, radius_arcsec: float, written=None) -> DataFrame:
    """Best-first removal, to its end; no overlap of two groups is made as a row.

    Open groups stand in grid cells no wider than the radius. In each round the best open group of a cell stays if no cell that its ball touches has a better one,
    and what it overlaps is closed with it. The best of all open groups stays in every round, so the rounds end by themselves. ``written`` cuts the lineage
    between rounds (default: checkpoint); what it leaves of one is cut on the executors. Groups without a position overlap none.
    """
    cut = written or (lambda df: df.checkpoint())

    def written(df: DataFrame) -> DataFrame:
        done = cut(df)
        return done if done._jdf.queryExecution().analyzed().children().isEmpty() else done.localCheckpoint()

    length = geometry.chord(radius_arcsec)
    side = max(length / math.sqrt(3), 2.1 / 2**_BITS)
    axes, line = "xyz", range(-math.ceil(length / side) - 1, math.ceil(length / side) + 2)
    named = groups.withColumn("id", _group_id())
    placed = F.coalesce(~F.isnan("ra") & ~F.isnan("dec"), F.lit(False))
    x, y, z = geometry.unit_vec(F.col("ra"), F.col("dec"))
    worse = F.when(F.isnan("score"), -math.inf).otherwise(F.coalesce(-F.col("score"), F.lit(math.inf)))
    at = cells.bound(named.where(placed).select("id", worse.alias("worse"), "ra", "dec"), x=x, y=y, z=z).drop("ra", "dec")
    open_ = written(at.withColumn("cell", F.expr(_key(*[_grid(a, side) for a in axes]))))

    def touching(heads: DataFrame) -> DataFrame:
        """Each row for each cell (nbr) that its ball touches and the sphere meets."""
        steps = [(i, j, k) for i in line for j in line for k in line]
        rows = heads.withColumns({f"_{a}": F.expr(_grid(a, side)) for a in axes}).withColumn("_s", F.explode(cells.structs(steps, "x", "y", "z")))
        rows = rows.select(*heads.columns, *[F.expr(f"_{a} + cast(_s.{a} as bigint)").alias(f"_{a}") for a in axes])
        low = {a: f"(_{a} * {side!r}D - 1.0001D)" for a in axes}
        gap = " + ".join(f"pow(greatest(0D, {low[a]} - {a}, {a} - {low[a]} - {side!r}D), 2)" for a in axes)
        far = "sqrt(" + " + ".join(f"pow({low[a]} + {side / 2!r}D, 2)" for a in axes) + ")"
        rows = rows.where(f"{gap} <= {(length * (1 + 1e-6)) ** 2 + 1e-24!r}D and abs({far} - 1) <= {side!r}D")
        return rows.withColumn("nbr", F.expr(_key(*[f"_{a}" for a in axes]))).drop(*[f"_{a}" for a in axes])

    kept = None
    while not open_.isEmpty():
        heads = written(open_.groupBy("cell").agg(F.min(F.struct("worse", "id", *axes)).alias("h")).select("cell", "h.*"))
        rival = heads.select(F.col("cell").alias("nbr"), F.struct("worse", "id").alias("rival"))
        best = touching(heads).join(rival, "nbr").groupBy("cell").agg(F.min("rival").alias("best"))
        stay = written(heads.join(best, "cell").where(F.struct("worse", "id") == F.col("best")).select("id", *axes))
        kept = stay.select("id") if kept is None else kept.unionByName(stay.select("id"))
        near = touching(stay).groupBy(F.col("nbr").alias("cell")).agg(F.collect_list(F.struct(*axes)).alias("stay"))
        own = tuple(F.col(a) for a in axes)
        closed = F.exists("stay", lambda s: geometry.chord2(own, tuple(s[a] for a in axes)) <= length**2)
        open_ = written(open_.join(near, "cell", "left").where(~F.coalesce(closed, F.lit(False))).select(open_.columns))
    if kept is None:
        return named.drop("id")
    return named.join(kept.withColumn("_stays", F.lit(True)), "id", "left").where(F.coalesce("_stays", F.lit(False)) | ~placed).drop("id", "_stays")


def coverage(groups: DataFrame, level: int, radius_arcsec: float) -> DataFrame:
    """(g1, g2, g3, pix): cells of a level whose centre is within the radius of a group's centre. No shuffle.

    Candidates are the cells around the centre's own, by steps of the two coordinates in a face. A group so near the border of
    a face that a step could leave it takes samples of a grid on the tangent plane instead; a cell then comes from the one
    sample nearest to its centre, so none comes twice.
    """
    n, side = cells.nside(level), cells.resolution_arcsec(level)
    # rows of cells are at least 0.6 sides apart, at the poles too
    steps = 1 + math.ceil(radius_arcsec / (0.6 * side))
    grid = side / 4
    reach = int(radius_arcsec / grid) + 3
    near = F.lit(steps).cast("long")
    at = groups.select("g1", "g2", "g3", F.col("ra").alias("ra0"), F.col("dec").alias("dec0"))
    at = cells.with_cell(at, "ra0", "dec0", level, "_own")
    face, x, y = cells.face_xy(F.col("_own"), level)
    at = cells.bound(at, _face=face, _x=x, _y=y)
    inside = (F.col("_x") >= near) & (F.col("_y") >= near) & (F.col("_x") < n - near) & (F.col("_y") < n - near)

    def lattice(most: int, step: float) -> Column:
        line = [k for k in range(-most, most + 1)]
        return cells.structs([(i, j) for i in line for j in line if step == 0.0 or math.hypot(i, j) * step <= radius_arcsec + 2 * grid], "i", "j")

    at = at.withColumn("_inside", inside).withColumn("_s", F.explode(F.when(F.col("_inside"), lattice(steps, 0.0)).otherwise(lattice(reach, grid))))
    a, d = F.radians("ra0"), F.radians("dec0")
    east, north = F.col("_s.i") * grid / geometry.ARCSEC, F.col("_s.j") * grid / geometry.ARCSEC
    axes = ((-F.sin(a), F.cos(a), F.lit(0.0)), (-F.sin(d) * F.cos(a), -F.sin(d) * F.sin(a), F.cos(d)))
    own = (F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d))
    ra, dec = geometry.ra_dec(*[o + east * e + north * v for o, e, v in zip(own, *axes, strict=True)])
    stepped = cells.pix_of(F.col("_face"), F.col("_x") + F.col("_s.i").cast("long"), F.col("_y") + F.col("_s.j").cast("long"), level)
    sampled = cells.ang2pix(F.col("_ra"), F.col("_dec"), level)
    at = cells.bound(at, _ra=F.when(~F.col("_inside"), ra), _dec=F.when(~F.col("_inside"), dec))
    at = cells.bound(at, pix=F.when(F.col("_inside"), stepped).otherwise(sampled))
    at = cells.with_centre(at, "pix", level, "ra_c", "dec_c")
    at = at.where(geometry.separation(F.col("ra0"), F.col("dec0"), F.col("ra_c"), F.col("dec_c")) <= radius_arcsec)
    # the sample nearest to a cell's centre, seen from the group
    centre = geometry.unit_vec(F.col("ra_c"), F.col("dec_c"))
    dot = lambda v, w: v[0] * w[0] + v[1] * w[1] + v[2] * w[2]
    place = [F.round(dot(centre, axis) / dot(centre, own) * (geometry.ARCSEC / grid)) for axis in axes]
    first = (place[0] == F.col("_s.i")) & (place[1] == F.col("_s.j"))
    return at.where(F.col("_inside") | first).select("g1", "g2", "g3", "pix")


def count_by_pix(groups: DataFrame) -> DataFrame:
    return groups.groupBy("outer_pix").agg(F.count("*").alias("n_groups"))
