"""Survey footprints of any shape as multi-order cell sets, and the algebra of their ranges.

A footprint at level k is the set of the cells of that level whose centre lies in it. It is held as a multi-order set: whole cells at
the coarsest levels that are inside, down to single cells of level k along its border. Cells are found by descent of the hierarchy,
``STEP`` levels at a time. A cell whose centre is further from the border than the cell reaches is inside or outside as a whole; the
others go on to their children. So the rows made are those along the border, never a product of shapes and cells.

In nested order a cell of any level is a range of numbers of level k. ``ranges`` are these, sorted, disjoint and merged within sections
(the cells of ``SECTION_LEVEL``), so that no window holds a whole survey. Union, intersection and difference sweep the ends of the
ranges of one section; the join with positions or map cells is an equi-join on (level, cell) of the levels that the set has.

Shapes: discs (survey, ra, dec, radius; degrees) and polygons (survey, vertices: array of ra, dec structs, degrees) with great-circle edges
that do not cross each other, of less than half of the sky; the vertices may run either way, and a polygon may hold a pole or cross right
ascension 0. Shapes of one survey add up. Null or non-finite parts, radii below 0 and polygons of fewer than three vertices give no cells; a disc of
180 degrees or more is the whole sky; a point on the border is inside a disc, and on either side of a polygon.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, geometry

STEP = 2
SECTION_LEVEL = 3


def _reach(level: int) -> float:
    """No point of a cell is further from its centre than the side of a square with its area (radians)."""
    return math.radians(cells.resolution_arcsec(level) / 3600)


def _vector(ra: Column, dec: Column) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip(geometry.unit_vec(ra, dec), "xyz", strict=True)])


def _dot(a: Column, b: Column) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def _cross(a: Column, b: Column) -> Column:
    return F.struct((a.y * b.z - a.z * b.y).alias("x"), (a.z * b.x - a.x * b.z).alias("y"), (a.x * b.y - a.y * b.x).alias("z"))


def _angle(a: Column, b: Column) -> Column:
    """Angle between unit vectors, exact for small and large ones."""
    c = _cross(a, b)
    return F.atan2(F.sqrt(_dot(c, c)), _dot(a, b))


def _finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & (F.abs(v) < F.lit(math.inf))
    return out


def _discs(discs: DataFrame) -> DataFrame:
    good = discs.where(_finite(F.col("ra"), F.col("dec"), F.col("radius")) & (F.col("radius") >= 0))
    return good.select("survey", _vector(F.col("ra"), F.col("dec")).alias("centre"), F.radians(F.least("radius", F.lit(180.0))).alias("radius"))


def _polygons(polygons: DataFrame) -> DataFrame:
    """survey and edges: the unit vectors of both ends, so that the inside is on the left."""
    good = polygons.where((F.size("vertices") >= 3) & F.forall("vertices", lambda v: _finite(v.ra, v.dec)))
    v = good.select("survey", F.transform("vertices", lambda p: _vector(p.ra, p.dec)).alias("v"))
    ring = v.withColumn("next", F.concat(F.slice("v", F.lit(2), F.size("v") - 1), F.slice("v", F.lit(1), F.lit(1))))
    edges = ring.withColumn("edges", F.zip_with("v", "next", lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    first = F.get("v", F.lit(0))
    # the signed area of the triangles of the first vertex and each edge
    area = lambda e: 2 * F.atan2(_dot(first, _cross(e.a, e.b)), 1 + _dot(first, e.a) + _dot(e.a, e.b) + _dot(e.b, first))
    signed = F.aggregate("edges", F.lit(0.0), lambda total, e: total + area(e))
    flipped = F.transform("edges", lambda e: F.struct(e.b.alias("a"), e.a.alias("b")))
    turned = cells.bound(edges, signed=signed).select("survey", F.when(F.col("signed") < 0, flipped).otherwise(F.col("edges")).alias("edges"))
    # what the descent asks of an edge at every cell is made once: its normal, the normals of the half planes at its ends
    named = F.transform("edges", lambda e: F.struct(e.a.alias("a"), e.b.alias("b"), _cross(e.a, e.b).alias("n")))
    turned = cells.bound(turned, edges=named)
    made = lambda e: F.struct(e.a.alias("a"), e.b.alias("b"), e.n.alias("n"), _cross(e.n, e.a).alias("from_a"), _cross(e.b, e.n).alias("to_b"), _dot(e.a, e.b).alias("ab"), F.sqrt(_dot(e.n, e.n)).alias("length"))
    return cells.bound(turned, edges=F.transform("edges", made))


def _disc_side(at: DataFrame, reach: float) -> DataFrame:
    """``inside`` for the centre of the cell and ``clear``, whether the whole cell is on that side."""
    away = cells.bound(at, away=_angle(F.col("p"), F.col("centre")))
    return away.withColumns({"inside": F.col("away") <= F.col("radius"), "clear": F.abs(F.col("away") - F.col("radius")) > reach}).drop("away")


def _polygon_side(at: DataFrame, reach: float) -> DataFrame:
    p = F.col("p")
    dots = cells.bound(at, sides=F.transform("edges", lambda e: F.struct(*[_dot(p, e[c]).alias(c) for c in ("a", "b", "n", "from_a", "to_b")], e.ab.alias("ab"), e.length.alias("length"))))
    # the angle at p from one end of the edge to the other
    turn = lambda s: F.atan2(s.n, s.ab - s.a * s.b)
    # the distance to its great circle where the foot lies on the edge, else to the nearer end
    foot, end = (lambda s: F.asin(F.least(F.lit(1.0), F.abs(s.n) / s.length))), (lambda s: F.acos(F.least(F.lit(1.0), F.greatest(s.a, s.b))))
    away = lambda s: F.when((s.from_a > 0) & (s.to_b > 0), foot(s)).otherwise(end(s))
    # the edges go once around p if it is inside; around the point opposite to it they go the other way
    wound = F.aggregate("sides", F.lit(0.0), lambda total, s: total + turn(s))
    made = cells.bound(dots, wound=wound, least=F.array_min(F.transform("sides", away))).drop("sides")
    return made.withColumns({"inside": F.col("wound") > math.pi, "clear": F.col("least") > reach + 1e-7}).drop("wound", "least")


def _descend(shapes: DataFrame, side, level: int) -> DataFrame:
    """(survey, level, pix): the multi-order cells of each shape."""
    shapes = shapes.withColumn("_id", F.monotonically_increasing_id())
    shapes = shapes.withColumn("open", F.lit(True)).withColumn("level", F.lit(0))
    at = shapes.withColumn("pix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    for k in [*range(0, level, STEP), level]:
        to = min(level, k + STEP)
        at = cells.with_centre(at, "pix", k, "_ra", "_dec")
        at = side(cells.bound(at, p=_vector(F.col("_ra"), F.col("_dec"))).drop("_ra", "_dec"), _reach(k))
        done = F.array(F.struct("pix", "level", F.lit(False).alias("open")))
        none = F.filter(done, lambda _: F.lit(False))
        last = k == level
        if last:
            found = F.when(~F.col("open") | F.col("inside"), done).otherwise(none)
        else:
            below = F.transform(cells.children(F.col("pix"), k, to), lambda c: F.struct(c.alias("pix"), F.lit(to).alias("level"), F.lit(True).alias("open")))
            found = F.when(~F.col("open") | (F.col("clear") & F.col("inside")), done).when(F.col("clear"), none).otherwise(below)
        # closed cells keep their number; what was computed of them as of a cell of this level is not used
        at = at.withColumn("_next", F.explode(found)).drop("p", "inside", "clear", "pix", "level", "open")
        at = at.withColumns({c: F.col(f"_next.{c}") for c in ("pix", "level", "open")}).drop("_next")
        if 0 < k < level:
            at = at.repartition("_id", "pix")  # a wide shape leaves the task that it began in
    return at.select("survey", "level", "pix")


def disc_cells(discs: DataFrame, level: int) -> DataFrame:
    """(survey, level, pix) of discs at a level."""
    return _descend(_discs(discs), _disc_side, level)


def polygon_cells(polygons: DataFrame, level: int) -> DataFrame:
    """(survey, level, pix) of polygons at a level."""
    return _descend(_polygons(polygons), _polygon_side, level)


def _cut(found: DataFrame, level: int) -> DataFrame:
    """Ranges (survey, lo, hi) with ``section``; one that covers more than a section is cut at its borders."""
    bits = 2 * max(0, level - SECTION_LEVEL)
    first, last = F.shiftright("lo", bits), F.shiftright(F.col("hi") - 1, bits)
    rows = found.where("lo < hi").withColumn("section", F.explode(F.sequence(first, last)))
    start = F.shiftleft("section", bits)
    return rows.withColumns({"lo": F.greatest("lo", start), "hi": F.least("hi", start + F.lit(1 << bits).cast("long"))})


def as_ranges(found: DataFrame, level: int) -> DataFrame:
    """(survey, lo, hi) of multi-order cells: sorted, disjoint numbers of the level, merged within sections."""
    lo = F.expr(f"shiftleft(pix, 2 * ({level} - level))")
    return merged(found.select("survey", lo.alias("lo"), (lo + F.expr(f"shiftleft(1L, 2 * ({level} - level))")).alias("hi")), level)


def merged(found: DataFrame, level: int) -> DataFrame:
    """Ranges of each survey without overlap, and without a gap of nothing inside a section."""
    w = Window.partitionBy("survey", "section").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = _cut(found, level).withColumn("fresh", F.when(before >= F.col("lo"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("survey", "section", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("survey", "lo", "hi")


KINDS = {"union": "a > 0 or b > 0", "intersection": "a > 0 and b > 0", "difference": "a > 0 and b = 0"}


def combine(left: DataFrame, right: DataFrame, level: int, kind: str) -> DataFrame:
    """Ranges of the union, intersection or difference of two range tables, survey by survey.

    The ends of both are swept in order, in each section by itself: a piece between two ends is kept by how many ranges of either side it lies in.
    """
    parts = []
    for df, a, b in ((left, 1, 0), (right, 0, 1)):
        ends = F.array(F.struct(F.col("lo").alias("x"), F.lit(a).alias("a"), F.lit(b).alias("b")), F.struct(F.col("hi").alias("x"), F.lit(-a).alias("a"), F.lit(-b).alias("b")))
        parts.append(_cut(df, level).select("survey", "section", F.explode(ends).alias("e")).select("survey", "section", "e.*"))
    ends = parts[0].unionByName(parts[1]).groupBy("survey", "section", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy("survey", "section").orderBy("x")
    depth = {c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in "ab"}
    pieces = ends.select("survey", F.col("x").alias("lo"), F.lead("x").over(w).alias("hi"), *[d.alias(c) for c, d in depth.items()])
    return merged(pieces.where(f"hi is not null and ({KINDS[kind]})").select("survey", "lo", "hi"), level)


def as_cells(found: DataFrame, level: int) -> DataFrame:
    """(survey, level, pix): the largest cells, ``STEP`` levels apart, that make up the ranges."""
    at = _cut(found, level).select("survey", "lo", "hi")
    top = min(level, SECTION_LEVEL)
    out = None
    for k in sorted({*range(top, level, STEP), level}):
        bits = 2 * (level - k)
        first, last = F.shiftright(F.col("lo") + ((1 << bits) - 1), bits), F.shiftright("hi", bits)
        whole = at.withColumns({"first": first, "last": last})
        part = whole.where("first < last").select("survey", F.lit(k).alias("level"), F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("pix"))
        out = part if out is None else out.unionByName(part)
        if k < level:
            rest = F.when(F.col("first") < F.col("last"), F.array(F.struct("lo", F.shiftleft("first", bits).alias("hi")), F.struct(F.shiftleft("last", bits).alias("lo"), "hi"))).otherwise(F.array(F.struct("lo", "hi")))
            at = whole.select("survey", F.explode(rest).alias("r")).select("survey", "r.*").where("lo < hi")
    return out


def within(points: DataFrame, found: DataFrame, level: int, pix: str = "pix") -> DataFrame:
    """Rows of ``points``, which have the cell ``pix`` of this level, with each survey whose ranges hold it.

    An equi-join on (level, cell): a row stands once for each level that the sets have, a cell of a survey holds it once at most. No
    range is compared with a row of another cell, however dense the sky or ragged the survey is.
    """
    parts = as_cells(found, level).select("survey", F.col("level").alias("_level"), F.col("pix").alias("_pix"))
    levels = sorted({*range(min(level, SECTION_LEVEL), level, STEP), level})
    at = F.array(*[F.struct(F.lit(k).alias("_level"), cells.parent(F.col(pix), level, k).alias("_pix")) for k in levels])
    return points.withColumn("_at", F.explode(at)).withColumns({"_level": F.col("_at._level"), "_pix": F.col("_at._pix")}).drop("_at").join(parts, ["_level", "_pix"]).drop("_level", "_pix")


def covered(found: DataFrame, level: int, to: int) -> DataFrame:
    """(survey, pix, fraction): the cells of a level that ranges touch, and the share of each that they cover."""
    if to > level:
        raise ValueError("the ranges are coarser than the cells asked for")
    bits = 2 * (level - to)
    first, last = F.shiftright("lo", bits), F.shiftright(F.col("hi") - 1, bits)
    rows = found.where("lo < hi").withColumn("pix", F.explode(F.sequence(first, last)))
    start = F.shiftleft("pix", bits)
    size = F.least("hi", start + F.lit(1 << bits).cast("long")) - F.greatest("lo", start)
    return rows.select("survey", "pix", size.alias("n")).groupBy("survey", "pix").agg((F.sum("n") / float(1 << bits)).alias("fraction"))
