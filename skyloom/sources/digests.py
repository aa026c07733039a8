"""Content digests of stored cells, a tree of them, and what must be built again after a change.

The digest of a cell is made of its rows in any order, equal rows included. It is computed when a cell is written and appended to a small table beside the
stars, with the number of stars and the sum of squares of their counts on a fine grid, from which the work of a search is
predicted. So a run reads a row for each cell, not the stars.

A parent's digest is that of its children's, up to the base cells. Two stores are compared from the top: only below digests that differ are there
cells to compare.
"""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import STAR_COLUMNS
from ..functions import cells

#: Levels that the fine grid of the work estimate is below a stored cell.
FINER = 6
SCHEMA = T.StructType([T.StructField("outer_pix", T.LongType()), T.StructField("n", T.LongType()), T.StructField("squares", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("at", T.TimestampType())])


def digest_root(root: str, release: str, level: int) -> str:
    return f"{root}/star_digests/release={release}/level={level}"


def cell_digests(stars: DataFrame, level: int) -> DataFrame:
    """(outer_pix, n, squares, digest) of the cells that hold stars; two aggregations that combine before their shuffle."""
    fine = min(cells.MAX_LEVEL, level + FINER)
    rows = cells.with_cell(stars, "gaia_ra", "gaia_dec", fine, "_fine")
    one, two = F.xxhash64(*STAR_COLUMNS), F.xxhash64(F.lit("second"), *STAR_COLUMNS)
    small = rows.groupBy("_fine").agg(F.count("*").alias("k"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"), F.sum(F.shiftright(one, 24)).alias("s"))
    whole = small.groupBy(cells.parent(F.col("_fine"), fine, level).alias("outer_pix")).agg(
        F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    )
    return whole.select("outer_pix", "n", "squares", F.sha2(F.concat_ws(":", "n", "x", "y", "s"), 256).alias("digest"))


def staged(stars: DataFrame, root: str, release: str, level: int):
    """Write the digests of the cells of ``stars`` aside, and return the call that records them, for when the cells are stored."""
    spark, path = stars.sparkSession, f"{digest_root(root, release, level)}/_staged/{uuid.uuid4().hex}"
    cell_digests(stars, level).hint("rebalance").write.parquet(path)

    def commit() -> None:
        made = spark.read.schema(SCHEMA).parquet(path).withColumn("at", F.current_timestamp())
        made.write.mode("append").parquet(digest_root(root, release, level))
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return commit


def read_digests(spark: SparkSession, root: str, release: str, level: int, stars: DataFrame | None = None) -> DataFrame:
    """The last digest of each stored cell. A store that was written without them gets them from its ``stars``."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(digest_root(root, release, level))
    except AnalysisException:
        if stars is None:
            raise
        return cell_digests(stars, level)
    last = rows.groupBy("outer_pix").agg(F.max_by(F.struct("n", "squares", "digest"), "at").alias("d"))
    return last.select("outer_pix", "d.*")


def tree(digests: DataFrame, level: int, written=None) -> dict[int, DataFrame]:
    """(pix, digest) at each level, from the cells up to the twelve base cells. A parent has four children at most.

    ``written`` cuts the lineage of a level (default: checkpoint), so that each is made once, from the one below it.
    """
    written = written or (lambda df: df.checkpoint())
    out = {level: written(digests.select(F.col("outer_pix").alias("pix"), "digest"))}
    for k in range(level - 1, -1, -1):
        below = out[k + 1].groupBy(cells.parent(F.col("pix"), k + 1, k).alias("up")).agg(F.array_sort(F.collect_list(F.struct("pix", "digest"))).alias("c"))
        out[k] = written(below.select(F.col("up").alias("pix"), F.sha2(F.array_join(F.transform("c", lambda c: F.concat_ws("=", c.pix.cast("string"), c.digest)), ","), 256).alias("digest")))
    return out


def changed(before: DataFrame, after: DataFrame, level: int, written=None) -> DataFrame:
    """(outer_pix, change) of the cells that differ: ``new``, ``gone`` or ``changed``. Both trees are descended below what differs."""
    written = written or (lambda df: df.checkpoint())
    one, two, both = tree(before, level, written), tree(after, level, written), None
    for k in range(level + 1):
        a, b = (t[k] for t in (one, two))
        if both is not None:
            up = both.select(F.col("pix").alias("up"))
            a, b = (t.join(up, cells.parent(t["pix"], k, k - 1) == up["up"], "left_semi") for t in (a, b))
        both = a.select("pix", F.col("digest").alias("d1")).join(b.select("pix", F.col("digest").alias("d2")), "pix", "full_outer").where(~F.col("d1").eqNullSafe(F.col("d2")))
        both = written(both)
        if both.isEmpty():
            break
    return both.select(F.col("pix").alias("outer_pix"), F.when(F.col("d1").isNull(), "new").when(F.col("d2").isNull(), "gone").otherwise("changed").alias("change"))


def to_rebuild(differing: DataFrame, held: DataFrame, level: int) -> DataFrame:
    """outer_pix of the held cells that differ or touch one that does: nine at most for one change."""
    ring = cells.neighbours_of(differing.select(F.col("outer_pix").alias("pix")), level).select(F.col("nbr").alias("outer_pix"))
    return differing.select("outer_pix").unionByName(ring).distinct().join(held.select("outer_pix"), "outer_pix", "left_semi")


def inputs(digests: DataFrame, level: int) -> DataFrame:
    """(outer_pix, input): for each cell the digest of all that its products are made from, its own stars and those of the cells around it."""
    around = cells.neighbours_of(digests.select(F.col("outer_pix").alias("pix")), level)
    pairs = around.unionByName(digests.select(F.col("outer_pix").alias("pix"), F.col("outer_pix").alias("nbr")))
    said = pairs.join(digests.select(F.col("outer_pix").alias("nbr"), "digest"), "nbr")
    out = said.groupBy("pix").agg(F.array_sort(F.collect_list(F.struct("nbr", "digest"))).alias("c"))  # nine at most
    return out.select(F.col("pix").alias("outer_pix"), F.sha2(F.array_join(F.transform("c", lambda c: F.concat_ws("=", c.nbr.cast("string"), c.digest)), ","), 256).alias("input"))


def predicted_work(digests: DataFrame, level: int, radius_arcsec: float) -> DataFrame:
    """(outer_pix, weight): stars and the pairs within the radius that a search will find among them, as their counts on the fine grid tell: where k stars
    stand in a fine cell, each has k * (disc / cell) others in its disc."""
    share = math.pi * (radius_arcsec / 3600) ** 2 / cells.cell_area_deg2(min(cells.MAX_LEVEL, level + FINER)) / 2
    return digests.select("outer_pix", (F.col("n") + F.floor((F.col("squares") - F.col("n")) * share)).cast("long").alias("weight"))
