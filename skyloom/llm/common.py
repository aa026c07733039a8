"""Helpers shared by the corpus operators: the shared work folder, table hand-over, Arrow batch mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows handed to a Python worker at once. Bounds a worker's memory when a table holds very long texts.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch length to BATCH_ROWS, for Python steps over whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a session whose tasks run
    in the driver gets a temporary folder; on a cluster no folder of one machine would do, and this raises."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="skyloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders made inside each open ``released`` block, the innermost last.
_OPEN: list[list[str]] = []


def work_path(spark: SparkSession, name: str, kept: bool = False) -> str:
    """A fresh path below the shared folder. It goes at the end of the ``released`` block that it is made in, unless it is ``kept``."""
    folder = f"{shared_folder(spark)}/skyloom-{uuid.uuid4().hex}"
    if _OPEN and not kept:
        _OPEN[-1].append(folder)
    return f"{folder}/{name}"


@contextmanager
def released(spark: SparkSession):
    """Deletes, at its end, the work folders made inside: for a caller that has then read for the last time what it called for."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for folder in made:
            remove(spark, folder)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = path or work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables that one call writes to the shared folder. ``drop`` frees those that no step still to come reads, so that the
    disk holds what is in use and not all that was ever made."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread ``df``. A name that is used again keeps its older table until it is dropped."""
        path = work_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        return written(df, name, path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                remove(self.spark, path.rsplit("/", 1)[0])

    def drop_older(self, name: str) -> None:
        """Drop all tables of a name but the last."""
        *older, last = self.paths[name]
        self.paths[name] = [last]
        for path in older:
            remove(self.spark, path.rsplit("/", 1)[0])

    def close(self, *kept: str) -> None:
        """Drop all tables but those named."""
        self.drop(*[n for n in self.paths if n not in kept])


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """Map each Arrow batch of ``df``. ``make`` runs once in a task and returns the batch function."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


#: What the operator that a Python worker served last keeps between its tasks: a vocabulary and its cache, a model, an index.
_KEPT: dict = {}


def kept_in_worker(name, make: Callable):
    """The object of this name that the worker has, or a new one in place of what another operator left, so that a worker that serves many stages
    holds what one of them needs."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
