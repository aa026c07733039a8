"""Equal-area sky cells in nested order, as column expressions.

Cell numbers are 64-bit: face in the highest bits, then the two in-face coordinates with their bits interleaved, so the
parent of a cell is a shift and the number follows a space-filling curve. Formulas: Gorski et al. 2005.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import geometry

#: For each byte: its bits at the even places; and the bits at its even places, together.
SPREAD = [sum((v >> b & 1) << 2 * b for b in range(8)) for v in range(256)]
GATHER = [sum((v >> 2 * b & 1) << b for b in range(4)) for v in range(256)]
MAX_LEVEL = 29


def nside(level: int) -> int:
    if not 0 <= level <= MAX_LEVEL:
        raise ValueError(f"level {level} is not in 0..{MAX_LEVEL}")
    return 1 << level


def npix(level: int) -> int:
    return 12 * nside(level) ** 2


def cell_area_deg2(level: int) -> float:
    return 4 * math.pi * math.degrees(1) ** 2 / npix(level)


def resolution_arcsec(level: int) -> float:
    """Side of a square with a cell's area."""
    return math.sqrt(cell_area_deg2(level)) * 3600


def _long(c: Column) -> Column:
    return c.cast("long")


def _by_bytes(c: Column, table: list[int], bits: int, step: int) -> Column:
    """The table's entries of each byte of a number with so many bits, ``step`` bits apart. Each byte names the number once."""
    known = F.expr(f"array({', '.join(f'{v}L' for v in table)})")  # one call to the JVM, not one for each entry
    out = None
    for k in range(0, max(1, -(-bits // 8))):
        part = F.shiftleft(F.get(known, F.shiftright(c, 8 * k).bitwiseAND(F.lit(255).cast("long")).cast("int")), step * k)
        out = part if out is None else out.bitwiseOR(part)
    return out


def _spread(c: Column, level: int) -> Column:
    return _by_bytes(c, SPREAD, level, 16)


def _gather(c: Column, level: int) -> Column:
    return _by_bytes(c, GATHER, 2 * level, 4)


def pix_of(face: Column, x: Column, y: Column, level: int) -> Column:
    """The cell of whole in-face coordinates."""
    return F.shiftleft(face, 2 * level).bitwiseOR(_spread(x, level)).bitwiseOR(F.shiftleft(_spread(y, level), 1))


def ang2pix(ra: Column, dec: Column, level: int) -> Column:
    """The cell of a position in degrees; null for a null or non-finite one. Right ascension wraps."""
    n = nside(level)
    t = F.pmod(ra, F.lit(360.0)) / 90
    z = F.sin(F.radians(dec))
    # equatorial belt
    a, b = n * (0.5 + t), 0.75 * n * z
    jp, jm = _long(F.floor(a - b)), _long(F.floor(a + b))
    fp, fm = F.shiftright(jp, level), F.shiftright(jm, level)
    belt_face = F.when(fp == fm, fp.bitwiseOR(F.lit(4).cast("long"))).when(fp < fm, fp).otherwise(fm + 8)
    mask = F.lit(n - 1).cast("long")
    belt_x, belt_y = jm.bitwiseAND(mask), (n - 1) - jp.bitwiseAND(mask)
    # caps
    q = F.least(F.lit(3).cast("long"), _long(F.floor(t)))
    u, s = t - q, n * F.sqrt(3 * (1 - F.abs(z)))
    cp, cm = F.least(mask, _long(F.floor(u * s))), F.least(mask, _long(F.floor((1 - u) * s)))
    north = z > 0
    cap_face = F.when(north, q).otherwise(q + 8)
    cap_x, cap_y = F.when(north, (n - 1) - cm).otherwise(cp), F.when(north, (n - 1) - cp).otherwise(cm)
    belt = F.abs(z) <= 2.0 / 3.0
    face, x, y = (F.when(belt, p).otherwise(c) for p, c in ((belt_face, cap_face), (belt_x, cap_x), (belt_y, cap_y)))
    finite = [F.abs(c) < math.inf for c in (ra, dec)]  # false for NaN, which is above all numbers
    return F.when(finite[0] & finite[1], pix_of(face, x, y, level))


def face_xy(pix: Column, level: int) -> tuple[Column, Column, Column]:
    """Face and in-face coordinates of a cell."""
    inside = _long(pix).bitwiseAND(F.lit(4**level - 1).cast("long"))
    return F.shiftright(_long(pix), 2 * level), _gather(inside, level), _gather(F.shiftright(inside, 1), level)


def position(face: Column, x: Column, y: Column, level: int) -> tuple[Column, Column, Column]:
    """(ra, dec, z) of real in-face coordinates; +0.5 is a cell's centre, +0 and +1 are its corners."""
    n = nside(level)
    row = F.shiftright(face, 2)
    r = row + 2 - (x + y) / n
    w = F.least(F.lit(1.0), r, 4 - r)
    z = F.when(w < 1, F.signum(2 - r) * (1 - w * w / 3)).otherwise((2 - r) * 2.0 / 3.0)
    turn = 2 * face.bitwiseAND(F.lit(3).cast("long")) + F.when(row == 1, 0).otherwise(1)
    ra = F.when(w <= 0, F.lit(0.0)).otherwise(F.pmod(45.0 * (turn * w + (x - y) / n) / w, F.lit(360.0)))
    return ra, F.degrees(F.asin(z)), z


def pix2ang(pix: Column, level: int) -> tuple[Column, Column]:
    """(ra, dec) of a cell's centre, in degrees."""
    face, x, y = face_xy(pix, level)
    ra, dec, _ = position(face, x + 0.5, y + 0.5, level)
    return ra, dec


def structs(rows: list[tuple[float, ...]], *names: str) -> Column:
    """A constant array of structs of doubles, made by one call to the JVM."""
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {float(v)!r}D" for n, v in zip(names, row, strict=True)) + ")" for row in rows) + ")")


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that the optimizer does not copy into later expressions. A projection is merged into the ones
    above it and a filter moves below it, each use with the whole expression; a generator of one row is not."""
    made = df.withColumn("_bound", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return made.withColumns({n: F.col(f"_bound.{n}") for n in columns}).drop("_bound")


def with_cell(df: DataFrame, ra: str, dec: str, level: int, name: str) -> DataFrame:
    """``df`` with the cell of a position, computed once."""
    made = bound(df, _ra=F.col(ra), _dec=F.col(dec))
    return bound(made, **{name: ang2pix(F.col("_ra"), F.col("_dec"), level)}).drop("_ra", "_dec")


def with_centre(df: DataFrame, pix: str, level: int, ra: str, dec: str) -> DataFrame:
    """``df`` with the position of the cell's centre, computed once."""
    face, x, y = face_xy(F.col(pix), level)
    made = bound(df, _face=face, _x=x + 0.5, _y=y + 0.5)
    ra_, dec_, _ = position(F.col("_face"), F.col("_x"), F.col("_y"), level)
    return bound(made, **{ra: ra_, dec: dec_}).drop("_face", "_x", "_y")


def parent(pix: Column, level: int, to: int) -> Column:
    if to > level:
        raise ValueError("a parent has a lower level")
    return F.shiftright(_long(pix), 2 * (level - to))


def children(pix: Column, level: int, to: int) -> Column:
    """The array of a cell's cells at a higher level."""
    if to < level:
        raise ValueError("a child has a higher level")
    first = F.shiftleft(_long(pix), 2 * (to - level))
    return F.sequence(first, first + (4 ** (to - level) - 1))


def corners(spark: SparkSession, level: int, cells: DataFrame | None = None) -> DataFrame:
    """(pix, vertex): the four corners of each cell; a vertex is named by its rounded unit vector."""
    cells = spark.range(npix(level)).withColumnRenamed("id", "pix") if cells is None else cells.select("pix")
    face, x, y = face_xy(F.col("pix"), level)
    at = cells.select("pix", F.explode(F.array(*[F.struct(face.alias("face"), (x + a).alias("x"), (y + b).alias("y")) for a in (0, 1) for b in (0, 1)])).alias("c"))
    ra, _, z = position(F.col("c.face"), F.col("c.x"), F.col("c.y"), level)
    at = bound(at.select("pix", "c"), ra=ra, z=z)
    ra, z = F.col("ra"), F.col("z")
    rho = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    scale = 1e8
    name = [F.round(v * scale).cast("long") for v in (rho * F.cos(F.radians(ra)), rho * F.sin(F.radians(ra)), z)]
    return at.select("pix", F.struct(name[0].alias("x"), name[1].alias("y"), name[2].alias("z")).alias("vertex"))


def neighbours(spark: SparkSession, level: int) -> DataFrame:
    """(pix, nbr): the cells that share a corner, 8 for most and 7 for 24 of them. One equi-join on corners."""
    own = corners(spark, level)
    other = own.select(F.col("pix").alias("nbr"), "vertex")
    return own.join(other, "vertex").where("pix <> nbr").select("pix", "nbr").distinct()


def centre(pix: int, level: int) -> tuple[float, float]:
    """(ra, dec) of one cell's centre, in degrees, for paths and plans on the driver."""
    n, inside = nside(level), pix & (4**level - 1)
    x, y = (sum((inside >> (2 * b + k) & 1) << b for b in range(level)) + 0.5 for k in (0, 1))
    row, column = divmod(pix >> 2 * level, 4)
    r = row + 2 - (x + y) / n
    w = min(1.0, r, 4 - r)
    z = math.copysign(1 - w * w / 3, 2 - r) if w < 1 else (2 - r) * 2.0 / 3.0
    return 45.0 * ((2 * column + (row != 1)) * w + (x - y) / n) / w % 360.0, math.degrees(math.asin(z))


#: Directions in which a corner is left to find the cells around it.
AROUND = [(math.cos(k * math.pi / 4 + 0.1), math.sin(k * math.pi / 4 + 0.1)) for k in range(8)]


def neighbours_of(pixels: DataFrame, level: int, pix: str = "pix") -> DataFrame:
    """(pix, nbr) of the given cells only: the cells found by short steps from each corner. No table of the whole sky is made."""
    face, x, y = face_xy(F.col("pix"), level)
    at = pixels.select(F.col(pix).alias("pix")).where("pix is not null").distinct()
    at = at.select("pix", F.explode(F.array(*[F.struct(face.alias("face"), (x + a).alias("x"), (y + b).alias("y")) for a in (0, 1) for b in (0, 1)])).alias("c"))
    ra, dec, _ = position(F.col("c.face"), F.col("c.x"), F.col("c.y"), level)
    at = bound(at, ra=ra, dec=dec).select("pix", "ra", "dec", F.explode(structs(AROUND, "east", "north")).alias("s"))
    step = math.radians(resolution_arcsec(level) / 3600) * 1e-3
    a, d, east, north = F.radians("ra"), F.radians("dec"), F.col("s.east") * step, F.col("s.north") * step
    point = (
        F.cos(d) * F.cos(a) - east * F.sin(a) - north * F.sin(d) * F.cos(a),
        F.cos(d) * F.sin(a) + east * F.cos(a) - north * F.sin(d) * F.sin(a),
        F.sin(d) + north * F.cos(d),
    )
    ra, dec = geometry.ra_dec(*point)
    return with_cell(bound(at, ra=ra, dec=dec), "ra", "dec", level, "nbr").where("pix <> nbr").select("pix", "nbr").distinct()
