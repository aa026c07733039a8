"""Stars grouped by a coarse parent cell: a file for each parent, stars along the curve inside it.

    stars_grouped/release=R/parent_level=P/version=N/data/parent=X/*.parquet     stars of the parents that version N rewrote
    stars_grouped/release=R/parent_level=P/version=N/parents/*.parquet           which parents these are
    stars_grouped/release=R/_staged/...                                          what is not published

A star carries ``fine``, its cell of the deepest level, and the file is sorted by it. A cell of any level between is a range of ``fine``, so one request
opens the files of its parents and reads the row groups and pages whose statistics meet the range. The star store (``sources.stars``) keeps a
file for each cell and stays the contract; this layout is made from it by ``compact`` for readers of wide regions.

A compaction rewrites whole parents: it writes them aside and publishes them by one rename to the next version number, so a reader sees a parent
as it was or as it is. For each parent the newest version that names it counts; a parent that has lost all its stars is named without a file.
A reader that began before keeps its files until ``vacuum``. Stars without a position stand under parent -1.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import STAR_SCHEMA
from ..functions import cells
from .stars import checked
from .work import publish

FINEST = cells.MAX_LEVEL
SCHEMA = T.StructType([*STAR_SCHEMA.fields, T.StructField("fine", T.LongType())])
#: Bytes of a row group before compression and rows of a page: what a small cell is read in.
ROW_GROUP_BYTES, PAGE_ROWS = 4 << 20, 2048


def grouped_root(root: str, release: str, parent_level: int) -> str:
    return f"{root}/stars_grouped/release={release}/parent_level={parent_level}"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str, release: str, parent_level: int) -> list[int]:
    at, files = _fs(spark, grouped_root(root, release, parent_level))
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))


def ranges(pixels: list[int], level: int) -> list[tuple[int, int]]:
    """Half-open ranges of ``fine`` that the cells cover; cells that follow each other make one."""
    shift, out = 2 * (FINEST - level), []
    for p in sorted(set(map(int, pixels))):
        if out and out[-1][1] == p << shift:
            out[-1] = (out[-1][0], (p + 1) << shift)
        else:
            out.append((p << shift, (p + 1) << shift))
    return out


def compact(stars: DataFrame, root: str, release: str, parent_level: int, parents: DataFrame | None = None, tries: int = 20) -> int:
    """Rewrite parents from ``stars`` (the stored columns) and return the version that holds them.

    ``parents`` (parent) names those to rewrite, and must be given where ``stars`` holds some of the sky only by choice: all stars of a parent come
    from ``stars``. By default these are the parents that ``stars`` holds. A parent is written by one task, as its file is one; its rows are those
    of a cell of bounded area.
    """
    spark, base = stars.sparkSession, grouped_root(root, release, parent_level)
    rows = cells.with_cell(checked(stars), "gaia_ra", "gaia_dec", FINEST, "fine")
    rows = rows.withColumn("parent", F.coalesce(cells.parent(F.col("fine"), FINEST, parent_level), F.lit(-1).cast("long")))
    if parents is not None:
        rows = rows.join(parents.select("parent").distinct(), "parent", "left_semi")
    staged = f"{root}/stars_grouped/release={release}/_staged/{uuid.uuid4().hex}"
    (
        rows.repartition("parent")
        .sortWithinPartitions("parent", "fine", "gaia_id")
        .write.option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .partitionBy("parent")
        .parquet(f"{staged}/data")
    )
    named = parents if parents is not None else rows
    named.select(F.col("parent").cast("long").alias("parent")).distinct().coalesce(1).write.parquet(f"{staged}/parents")
    at, files = _fs(spark, base)
    files.mkdirs(at)
    for _ in range(tries):
        number = max(versions(spark, root, release, parent_level), default=0) + 1
        if publish(spark, staged, f"{base}/version={number}"):
            return number
    raise RuntimeError(f"no free version in {base} after {tries} tries")


def current(spark: SparkSession, root: str, release: str, parent_level: int) -> DataFrame:
    """(parent, version) of the newest version of each parent."""
    base = grouped_root(root, release, parent_level)
    try:
        named = spark.read.schema("parent long, version long").option("basePath", base).parquet(f"{base}/version=*/parents")
    except AnalysisException:
        return spark.createDataFrame([], "parent long, version long")
    return named.groupBy("parent").agg(F.max("version").alias("version"))


def read_grouped(spark: SparkSession, root: str, release: str, parent_level: int, level: int, pixels: list[int] | None = None) -> DataFrame:
    """Stars with their ``outer_pix`` of ``level``, of all the sky or of some cells. The driver holds the list of the parents asked for."""
    if level < parent_level:
        raise ValueError(f"cells of level {level} are coarser than the parents of level {parent_level}")
    base, held = grouped_root(root, release, parent_level), current(spark, root, release, parent_level)
    if pixels is not None:
        held = held.where(F.col("parent").isin(sorted({int(p) >> 2 * (level - parent_level) for p in pixels})))
    _, files = _fs(spark, base)
    paths = [f"{base}/version={r['version']}/data/parent={r['parent']}" for r in held.toLocalIterator()]
    paths = [p for p in paths if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]  # a parent without stars has none
    if not paths:
        return spark.createDataFrame([], SCHEMA).select(*STAR_SCHEMA.fieldNames(), F.lit(None).cast("long").alias("outer_pix"))
    rows = spark.read.schema(SCHEMA).parquet(*paths)
    if pixels is not None:
        wanted = F.lit(False)
        for low, high in ranges(pixels, level):
            wanted = wanted | ((F.col("fine") >= low) & (F.col("fine") < high))
        rows = rows.where(wanted)
    return rows.select(*STAR_SCHEMA.fieldNames(), cells.parent(F.col("fine"), FINEST, level).alias("outer_pix"))


def vacuum(spark: SparkSession, root: str, release: str, parent_level: int) -> int:
    """Remove versions of which no parent is current any more, for when no reader of them is left; returns how many."""
    live = {r["version"] for r in current(spark, root, release, parent_level).select("version").distinct().collect()}
    gone = [v for v in versions(spark, root, release, parent_level) if v not in live]
    for v in gone:
        at, files = _fs(spark, f"{grouped_root(root, release, parent_level)}/version={v}")
        files.delete(at, True)
    return len(gone)


def layout_size(stars: DataFrame) -> DataFrame:
    """Files and bytes that a table of stars is read from, to compare layouts."""
    return stars.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.count("*").alias("n_files"), F.sum("file_size").alias("bytes"))


#: Row groups that a worker keeps for requests that follow each other along the curve.
KEPT_GROUPS = 4


@lru_cache(maxsize=16)
def _parents_of(base: str, version: str):
    """The parents that a published version names. Versions never change."""
    import pyarrow.parquet as pq

    files, path = _files(base)
    return frozenset(pq.read_table(f"{path}/{version}/parents", filesystem=files).column("parent").to_pylist())


def _files(base: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(base) if ":" in base.split("/")[0] else (fs.LocalFileSystem(), base)


@lru_cache(maxsize=64)
def _row_groups(base: str, folder: str):
    """(path, row group, least and greatest ``fine``) of the files of a parent, along the curve; from their footers, which are read once. A group without statistics
    may hold any."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    files, root = _files(base)
    out = []
    for at in files.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True)):
        if at.base_name.endswith(".parquet"):
            with pq.ParquetFile(at.path, filesystem=files) as file:
                column = file.schema_arrow.get_field_index("fine")
                for k in range(file.num_row_groups):
                    told = file.metadata.row_group(k).column(column).statistics
                    known = told is not None and told.has_min_max
                    out.append((at.path, k, told.min if known else 0, told.max if known else 1 << 62))
    return sorted(out, key=lambda g: (g[2], g[0], g[1]))


@lru_cache(maxsize=KEPT_GROUPS)
def _row_group(base: str, path: str, k: int, columns: tuple[str, ...]):
    """Columns of one row group, sorted by ``fine`` as written: of bounded size (``ROW_GROUP_BYTES``)."""
    import pyarrow.parquet as pq

    with pq.ParquetFile(path, filesystem=_files(base)[0]) as file:
        rows = file.read_row_group(k, columns=list(columns)).combine_chunks()
    return rows, rows.column("fine").to_numpy()


def fetch(release: str, level: int, pix: int, columns: list[str], bounds: list[tuple], limit: int | None, root: str, parent_level: int) -> Iterator[dict]:
    """The layout as a service of the archive source (``sources.archive``): stars of one cell, at most ``limit``, cut to the columns and bounds asked for.
    It runs in the task that asks. A request reads the row groups that its cell meets, up to its limit, and cuts its range out of them; footers and the row groups read
    last are kept, so requests for the parts of a cell do not read its file again.
    """
    import numpy as np
    import pyarrow.compute as pc
    import pyarrow.fs as fs

    base = grouped_root(root, release, parent_level)
    shift = 2 * (parent_level - level)
    wanted = set(range(pix << shift, (pix + 1) << shift)) if shift >= 0 else {pix >> -shift}
    files, path = _files(base)
    found = [i.base_name for i in files.get_file_info(fs.FileSelector(path)) if i.base_name.startswith("version=")]
    low, high = ranges([pix], level)[0]
    names = tuple(dict.fromkeys([*columns, *[b[0] for b in bounds], "fine"]))
    tests = {"=": pc.equal, "<": pc.less, "<=": pc.less_equal, ">": pc.greater, ">=": pc.greater_equal, "in": lambda c, v: pc.is_in(c, value_set=pa.array(v, c.type))}
    left = limit
    for version in sorted(found, key=lambda p: -int(p.rpartition("=")[2])):
        named = wanted & _parents_of(base, version)
        wanted -= named
        for parent in sorted(named):
            for at, k, least, most in _row_groups(base, f"{version}/data/parent={parent}"):
                if most < low or least >= high:
                    continue
                rows, fine = _row_group(base, at, k, names)
                first, end = np.searchsorted(fine, (low, high))
                rows = rows.slice(first, end - first)
                for column, test, value in bounds:
                    rows = rows.filter(tests[test](rows.column(column), value))
                kept = (rows if left is None else rows.slice(0, left)).select(list(columns)).to_pylist()
                yield from kept
                if left is not None:
                    left -= len(kept)
                    if not left:
                        return
