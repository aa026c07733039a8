"""The canonical star store: one Parquet file per outer cell, the locked schema and nothing else.

Folders are hour, declination and pixel of a cell's centre (``contracts.star_path``), so a listing of few cells opens few
folders whatever the level. Where the cells of a request are known, only their folders are listed and read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import STAR_COLUMNS, STAR_SCHEMA, LoadRequest, star_folder, star_root
from ..functions import cells
from ..operators import loader
from . import digests


class ContractError(ValueError):
    """A table that breaks a persisted contract."""


def checked(df: DataFrame) -> DataFrame:
    """``df`` if it has exactly the stored columns in their types."""
    names = tuple(df.columns)
    if set(names) != set(STAR_COLUMNS) or len(names) != len(STAR_COLUMNS):
        raise ContractError(f"columns must be {STAR_COLUMNS}; extra {sorted(set(names) - set(STAR_COLUMNS))}, missing {sorted(set(STAR_COLUMNS) - set(names))}")
    for f in STAR_SCHEMA:
        if df.schema[f.name].dataType != f.dataType:
            raise ContractError(f"{f.name} must be {f.dataType.simpleString()}, not {df.schema[f.name].dataType.simpleString()}")
    return df.select(*STAR_COLUMNS)


def write_stars(df: DataFrame, root: str, release: str, level: int) -> None:
    """Write or replace the cells that ``df`` holds, then record their digests; other cells stay (dynamic overwrite, so a retry is idempotent)."""
    rows = checked(df)
    commit = digests.staged(rows, root, release, level)  # before the stars, which ``df`` may be read from
    df = cells.with_cell(rows, "gaia_ra", "gaia_dec", level, "outer_pix")
    df = cells.with_centre(df, "outer_pix", level, "_ra", "_dec")
    hour = F.pmod(F.floor(F.round("_ra", 9) / 15), F.lit(24)).cast("int")
    dec = F.least(F.lit(17), F.floor((F.round("_dec", 9) + 90) / 10)).cast("int")
    (
        df.withColumns({"hour": hour, "dec": dec})
        .drop("_ra", "_dec")
        .repartition("hour", "dec", "outer_pix")
        .sortWithinPartitions("hour", "dec", "outer_pix", "gaia_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("hour", "dec", "outer_pix")
        .parquet(star_root(root, release, level))
    )
    commit()


def read_stars(spark: SparkSession, root: str, release: str, level: int, pixels: list[int] | None = None) -> DataFrame:
    """Stars with their ``outer_pix``; only the folders of the wanted cells are listed and read."""
    schema = T.StructType([*STAR_SCHEMA.fields, T.StructField("hour", T.IntegerType()), T.StructField("dec", T.IntegerType()), T.StructField("outer_pix", T.LongType())])
    stars = spark.read.schema(schema).parquet(star_root(root, release, level))
    if pixels is not None:
        folders = sorted({star_folder(*cells.centre(p, level)) for p in pixels})
        stars = stars.where(F.col("hour").isin(sorted({h for h, _ in folders})) & F.col("dec").isin(sorted({d for _, d in folders})) & F.col("outer_pix").isin([int(p) for p in pixels]))
    return stars.drop("hour", "dec")


def load(spark: SparkSession, root: str, request: LoadRequest) -> DataFrame:
    """The prepared stars of a request: position at its epoch, magnitude in its band, ``outer_pix``, and ``own``, false for
    the stars of the ring around the wanted cells."""
    level, fine = request.outer_level, request.stitching_level
    if request.pixels is None:
        return loader.prepared(read_stars(spark, root, request.release, level), request).withColumn("own", F.lit(True))
    wanted = spark.createDataFrame([(int(p),) for p in request.pixels], "outer_pix long").distinct()
    if fine is None:
        return loader.prepared(read_stars(spark, root, request.release, level, list(request.pixels)), request).withColumn("own", F.lit(True))
    if fine < level:
        raise ValueError(f"stitching level {fine} is coarser than the cells of level {level}")
    inner = wanted.select(F.explode(cells.children(F.col("outer_pix"), level, fine)).alias("pix"))
    ring = cells.neighbours_of(inner, fine).select(F.col("nbr").alias("fine")).join(inner.withColumnRenamed("pix", "fine"), "fine", "left_anti").distinct()
    near = [r[0] for r in ring.select(cells.parent(F.col("fine"), fine, level)).distinct().collect()]  # at most nine cells for each wanted one
    stars = loader.prepared(read_stars(spark, root, request.release, level, [*request.pixels, *near]), request)
    stars = cells.with_cell(stars, "gaia_ra", "gaia_dec", fine, "fine")
    own = stars.join(wanted, "outer_pix", "left_semi").drop("fine").withColumn("own", F.lit(True))
    return own.unionByName(stars.join(ring, "fine", "left_semi").drop("fine").withColumn("own", F.lit(False)))


def fingerprint(stars: DataFrame) -> str:
    """Tells whether two star tables hold the same rows, in any order."""
    row = stars.select(F.xxhash64(*STAR_COLUMNS).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.shiftright("h", 20)).alias("s")).first()
    return f"{row['n']}:{row['x'] or 0}:{row['s'] or 0}"


def exists(spark: SparkSession, root: str, release: str, level: int) -> bool:
    try:
        spark.read.schema(STAR_SCHEMA).parquet(star_root(root, release, level))
    except AnalysisException:
        return False
    return True
