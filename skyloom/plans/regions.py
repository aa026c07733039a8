"""Neighbour-first order of unfinished work: connected regions of open cells, batches that grow along their borders.

Open cells that touch (share a side or a corner) are one region, named by its least cell. Regions are found by rounds over the neighbour graph
of the open cells alone: each cell takes the least name around it and then the name that its name has, so names travel in doubling steps. A
round reads and writes a row for each open cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..sources.work import cut


def adjacency(open_cells: DataFrame, level: int) -> DataFrame:
    """(outer_pix, nbr) of open cells that touch, both ways."""
    named = open_cells.select("outer_pix").where("outer_pix is not null").distinct()
    on_sky = named.where(F.col("outer_pix").between(0, cells.npix(level) - 1))  # other numbers touch nothing
    around = cells.neighbours_of(on_sky.select(F.col("outer_pix").alias("pix")), level).select(F.col("pix").alias("outer_pix"), "nbr")
    return around.join(named.select(F.col("outer_pix").alias("nbr")), "nbr", "left_semi").select("outer_pix", "nbr")


def regions(open_cells: DataFrame, level: int, written=None) -> DataFrame:
    """(outer_pix, region, n_open): the region of each open cell, and how many open cells touch it.

    ``written`` cuts the lineage between rounds (default: ``work.cut``).
    """
    written = written or cut
    edges = written(adjacency(open_cells, level))
    named = open_cells.select("outer_pix").where("outer_pix is not null").distinct()
    around = edges.groupBy("outer_pix").agg(F.count("*").alias("n_open"), F.min("nbr").alias("least"))
    at = named.join(around, "outer_pix", "left").select("outer_pix", F.coalesce("n_open", F.lit(0)).cast("long").alias("n_open"), F.least("outer_pix", "least").alias("region"))
    at = written(at)
    while True:
        near = edges.join(at.select(F.col("outer_pix").alias("nbr"), F.col("region").alias("r")), "nbr").groupBy("outer_pix").agg(F.min("r").alias("r"))
        new = at.join(near, "outer_pix", "left").select("outer_pix", "n_open", "region", F.least("region", "r").alias("next"))
        jump = at.select(F.col("outer_pix").alias("next"), F.col("region").alias("beyond"))
        new = written(new.join(jump, "next").select("outer_pix", "n_open", F.col("region").alias("old"), F.least("next", "beyond").alias("region")))
        if new.where("old <> region").isEmpty():
            return new.select("outer_pix", "region", "n_open")
        at = new.drop("old")


def in_order(weighted: DataFrame, level: int, shares: int, written=None) -> DataFrame:
    """(outer_pix, region, weight, before, share): open cells (outer_pix, weight) region by region, the heaviest region first, along the curve of the nested
    number inside a region; shares are cut along that order by weight.

    So a share leaves a region only when the region has ended, and what it leaves open lies at the border of what it has done. The running sum is in two levels: cells
    within (region, section), then these sections, of which there are few for each region.
    """
    found = regions(weighted, level, written).join(weighted.select("outer_pix", "weight"), "outer_pix").withColumn("section", F.shiftright("outer_pix", 12))
    sums = found.groupBy("region", "section").agg(F.sum("weight").alias("w"))
    heavy = sums.groupBy("region").agg(F.sum("w").alias("whole"))
    w = Window.orderBy(F.desc("whole"), "region", "section")
    placed = sums.join(heavy, "region").select("region", "section", (F.sum("w").over(w) - F.col("w")).alias("offset"), F.sum("w").over(Window.partitionBy()).alias("total"))
    own = F.sum("weight").over(Window.partitionBy("region", "section").orderBy("outer_pix").rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")
    out = found.withColumn("own", own).join(placed, ["region", "section"]).withColumn("before", F.col("own") + F.col("offset"))
    # a cell goes to the share that holds its middle
    share = F.least(F.floor((F.col("before") + F.col("weight") / 2) * shares / F.col("total")), F.lit(shares - 1)).cast("int")
    return out.select("outer_pix", "region", "weight", "before", share.alias("share"))
