"""Derived products: inner cells, maps over several levels, look-ups, survey overlays and summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells

#: Levels that the search for the cells of a box goes down at once.
DESCENT = 3


def inner_product(stars: DataFrame, outer_level: int, inner_level: int) -> DataFrame:
    """Per inner cell: star count, density, brightest magnitude, flux. stars: ra, dec, mag."""
    inner = cells.with_cell(stars, "ra", "dec", inner_level, "inner_pix").where("inner_pix is not null")
    area = cells.cell_area_deg2(inner_level)
    out = inner.groupBy("inner_pix").agg(
        F.count("*").alias("n_stars"),
        F.min("mag").alias("brightest"),
        F.round(F.sum(F.pow(F.lit(10.0), -0.4 * (F.col("mag") - 15))), 6).alias("flux"),
    )
    return out.select(cells.parent(F.col("inner_pix"), inner_level, outer_level).alias("outer_pix"), "inner_pix", "n_stars", (F.col("n_stars") / area).alias("density"), "brightest", "flux")


def aggregate_map(inner: DataFrame, inner_level: int, levels: tuple[int, ...]) -> DataFrame:
    """Per level and cell: stars, filled inner cells, brightest, flux. Each inner cell names its parents at all levels, and one
    aggregation, combined in every task before its only shuffle, makes all levels from one read of the fine table."""
    parents = F.array(*[F.struct(F.lit(level).alias("level"), cells.parent(F.col("inner_pix"), inner_level, level).alias("pix")) for level in sorted(set(levels), reverse=True)])
    at = inner.select(F.explode(parents).alias("at"), "n_stars", "brightest", "flux")
    out = at.groupBy("at.level", "at.pix").agg(F.sum("n_stars").alias("n_stars"), F.count("*").alias("n_cells"), F.min("brightest").alias("brightest"), F.round(F.sum("flux"), 6).alias("flux"))
    return out.select("level", "pix", "n_stars", "n_cells", "brightest", "flux")


def map_data(sky_map: DataFrame, level: int, points: DataFrame) -> DataFrame:
    """The map's values at positions (ra, dec): an equi-join on the cell; null where the map is empty."""
    return cells.with_cell(points, "ra", "dec", level, "pix").join(sky_map.where(F.col("level") == level).drop("level"), "pix", "left")


def footprint_cells(boxes: DataFrame, level: int) -> DataFrame:
    """(survey, pix): cells of a level whose centre lies in a box (ra_min, ra_max, dec_min, dec_max; degrees).

    A box runs from ra_min eastward to ra_max: 350 to 10, or 350 to 370, crosses zero, and 360 or more is the whole circle.
    The hierarchy is descended from the twelve base cells, ``DESCENT`` levels at a time: the cells that can hold part of the box
    go on to their children. So there is no product of boxes and cells, and on the way the rows are dealt anew, so
    that one wide box does not stay in one task.
    """
    span = F.col("ra_max") - F.col("ra_min")
    width = F.when(span >= 360, F.lit(360.0)).otherwise(F.pmod(span, F.lit(360.0)))
    at = boxes.select("survey", "ra_min", width.alias("width"), "dec_min", "dec_max").where("ra_min is not null and width is not null and dec_min <= dec_max")
    at = at.withColumn("pix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    for k in range(0, level, DESCENT):
        to = min(level, k + DESCENT)
        # no point of a cell is further from its centre than the side of a square with its area
        reach = cells.resolution_arcsec(k) / 3600
        at = cells.with_centre(at, "pix", k, "ra", "dec")
        slack = F.when(F.abs("dec") + reach >= 90, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(90.0, reach)))) / F.cos(F.radians("dec"))))))
        near = (F.col("dec") >= F.col("dec_min") - reach) & (F.col("dec") <= F.col("dec_max") + reach)
        at = at.where(near & (F.pmod(F.col("ra") - F.col("ra_min") + slack, F.lit(360.0)) <= F.col("width") + 2 * slack)).drop("ra", "dec")
        at = at.withColumn("pix", F.explode(cells.children(F.col("pix"), k, to)))
        if k:
            at = at.repartition("survey", "pix")
    at = cells.with_centre(at, "pix", level, "ra", "dec")
    inside = (F.pmod(F.col("ra") - F.col("ra_min"), F.lit(360.0)) <= F.col("width")) & F.col("dec").between(F.col("dec_min"), F.col("dec_max"))
    return at.where(inside).select("survey", "pix").distinct()


def survey_cells(boxes: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """(level, survey, pix) of the footprints at several levels."""
    out = None
    for level in levels:
        part = footprint_cells(boxes, level).select(F.lit(level).alias("level"), "survey", "pix")
        out = part if out is None else out.unionByName(part)
    return out


def overlay(sky_map: DataFrame, survey: DataFrame) -> DataFrame:
    """The map's cells (level, pix) with each survey that holds them (``survey`` null and ``inside`` false for none)."""
    return sky_map.join(survey, ["level", "pix"], "left").withColumn("inside", F.col("survey").isNotNull())


def summarise(overlaid: DataFrame) -> DataFrame:
    """Totals by survey and level, by level, and of all: one pass with grouping sets."""
    return overlaid.sparkSession.sql(
        "select survey, level, count(*) as n_cells, sum(n_stars) as n_stars, grouping_id(survey, level) as grouping from {overlaid} group by grouping sets ((survey, level), (level), ())",
        overlaid=overlaid,
    )
