"""Quantile sketches of magnitude per sky cell, which merge up the levels.

A sketch is the counts of stars in bins of equal width, 2 * ``error`` magnitudes. Bins of magnitude are bins of equal ratio of flux, so an estimate is
within ``error`` magnitudes of the exact order statistic, at every level and after any number of merges: counts add, and nothing is
dropped. A cell has at most (range of magnitudes) / (2 * error) bins whatever the number of its stars: 300 for a range of 30 and an error of 0.05.

Defined cases: null or non-finite magnitudes and positions take no part; an empty table gives an empty sketch; equal magnitudes are counted each; a
quantile p of n stars is the star of rank max(1, ceil(p * n)) from the brightest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells


def magnitude_sketch(stars: DataFrame, level: int, error: float = 0.05) -> DataFrame:
    """(pix, bin, n) of the cells of a level. stars: ra, dec, mag."""
    finite = stars.where("mag is not null and not isnan(mag) and abs(mag) < double('infinity')")
    at = cells.with_cell(finite, "ra", "dec", level, "pix").where("pix is not null")
    return at.groupBy("pix", F.floor(F.col("mag") / (2 * error)).alias("bin")).agg(F.count("*").alias("n"))


def merge_up(sketch: DataFrame, level: int, levels: tuple[int, ...]) -> DataFrame:
    """(level, pix, bin, n) at several levels: one aggregation, which combines in every task before its shuffle."""
    parents = F.array(*[F.struct(F.lit(k).alias("level"), cells.parent(F.col("pix"), level, k).alias("pix")) for k in sorted(set(levels), reverse=True)])
    return sketch.select(F.explode(parents).alias("at"), "bin", "n").groupBy("at.level", "at.pix", "bin").agg(F.sum("n").alias("n"))


def merged(*sketches: DataFrame) -> DataFrame:
    """One sketch of several with the same columns, error and levels, such as those of nights or of parts of a store."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, shares: dict[str, float], error: float = 0.05) -> DataFrame:
    """Per cell: n_stars and a column for each share (name to p), within ``error`` of the exact one. A window holds the bins of one cell."""
    keys = [c for c in sketch.columns if c not in ("bin", "n")]
    cell = Window.partitionBy(*keys)
    rows = sketch.withColumns({"total": F.sum("n").over(cell), "upto": F.sum("n").over(cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))})
    first = {name: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * p)), F.col("bin"))) for name, p in shares.items()}
    return rows.groupBy(*keys).agg(F.sum("n").alias("n_stars"), *[((b + 0.5) * (2 * error)).alias(name) for name, b in first.items()])
