"""Readers and writers of pass artifacts, and the manifest. Artifacts are found by pass id, never by folder habits."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import MANIFEST_SCHEMA, pass_path

KINDS = ("inner", "asterisms", "map", "overlay")


def write_artifact(df: DataFrame, root: str, pass_id: str, kind: str, by: str | None = "outer_pix") -> None:
    """Write or replace the partitions that ``df`` holds."""
    path = pass_path(root, pass_id, kind)
    writer = (df.repartition(by).sortWithinPartitions(by) if by else df).write.mode("overwrite").option("compression", "zstd")
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(by)
    writer.parquet(path)


def clear_cells(spark: SparkSession, root: str, pass_id: str, kind: str, cells: DataFrame) -> None:
    """Remove what an artifact holds of the cells (``outer_pix``). A dynamic overwrite replaces only the cells that have new
    rows, so a cell that is built again and has none any more must go first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pass_path(root, pass_id, kind))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in cells.select("outer_pix").distinct().toLocalIterator():
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"outer_pix={r['outer_pix']}"), True)


def read_artifact(spark: SparkSession, root: str, pass_id: str, kind: str, pixels: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(pass_path(root, pass_id, kind))
    df = df if pixels is None else df.where(F.col("outer_pix").isin([int(p) for p in pixels]))
    return df.withColumn("outer_pix", F.col("outer_pix").cast("long")) if "outer_pix" in df.columns else df  # folders say no type


def write_inner(df, root, pass_id):
    write_artifact(df, root, pass_id, "inner")


def read_inner(spark, root, pass_id, pixels=None):
    return read_artifact(spark, root, pass_id, "inner", pixels)


def write_asterisms(df, root, pass_id):
    write_artifact(df, root, pass_id, "asterisms")


def read_asterisms(spark, root, pass_id, pixels=None):
    return read_artifact(spark, root, pass_id, "asterisms", pixels)


def write_map(df, root, pass_id):
    write_artifact(df, root, pass_id, "map", "level")


def read_map(spark, root, pass_id, level: int | None = None, pixels=None):
    """The map of a pass, of one level and of some of its cells if these are given."""
    df = read_artifact(spark, root, pass_id, "map")
    df = df if level is None else df.where(F.col("level") == level)
    return df if pixels is None else df.where(F.col("pix").isin([int(p) for p in pixels]))


def write_overlay(df, root, pass_id):
    write_artifact(df, root, pass_id, "overlay", None)


def read_overlay(spark, root, pass_id):
    return read_artifact(spark, root, pass_id, "overlay")


def write_manifest(spark: SparkSession, root: str, record: dict) -> None:
    """Append a manifest row; the last row of a pass counts."""
    spark.createDataFrame([record], MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(pass_path(root, record["pass_id"], "manifest"))


def read_manifest(spark: SparkSession, root: str, pass_id: str | None = None) -> DataFrame:
    """The current manifest of each pass: completion wins over creation."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(pass_path(root, pass_id or "", "manifest"))
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    rows = rows.where(F.col("pass_id") == pass_id) if pass_id else rows
    last = rows.groupBy("pass_id").agg(F.max_by(F.struct("*"), F.struct(F.coalesce("completed_at", F.lit("")).alias("end"), F.col("created_at").alias("begin"))).alias("m"))
    return last.select("m.*")
