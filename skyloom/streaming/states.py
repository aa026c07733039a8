"""A live view of the build log: the last state of each cell, kept while events are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import pass_path
from ..sources.log import VERSIONED


def state_stream(spark: SparkSession, root: str, pass_id: str) -> DataFrame:
    """Streaming aggregate of the state log; use with output mode ``complete`` or ``update``."""
    events = spark.readStream.schema(VERSIONED).parquet(pass_path(root, pass_id, "state"))
    return events.groupBy("outer_pix").agg(F.max_by("state", F.struct("version", "ts", "seq")).alias("state"))
