"""Archive query: a Spark data source of raw stars from a remote service.

The service is reached by a ``fetch`` callable given by import path, so that the engine holds no address and needs no
network for its tests. A region is split by sky cells; each input partition asks for one cell, so executors fetch in parallel
and a lost one is asked for again.

What a query needs of the stars goes to the service: the columns, and the comparisons of a column with constants. Spark tests the
comparisons again, so a service may use some of them or none. Bounds on the declination also drop the cells that cannot meet them before any
request is made. A service that gives ``row_limit`` rows at most may have more: then the cell is asked for again by its four children, and so on, so
a reply is whole or is not used. Nothing is cut off: a cell of the deepest level that still gives that many rows is an error.
"""

from __future__ import annotations

import importlib
import inspect
import json
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql import types as T

from ..contracts import STAR_SCHEMA
from ..functions import cells

TESTS = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", In: "in"}


class TooManyStars(RuntimeError):
    """A cell of the deepest level holds as many stars as the service gives at most."""


class Cell(InputPartition):
    def __init__(self, pix: int):
        super().__init__(pix)


class ArchiveReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.fetch, self.release = options["fetch"], options.get("release", "dr3")
        self.level = int(options.get("level", "6"))
        self.pixels = [int(p) for p in options["pixels"].split(",") if p]
        self.limit = int(options["row_limit"]) if "row_limit" in options else None
        for _ in range(min(int(options.get("split", "0")), cells.MAX_LEVEL - self.level)):  # so that one cell is the work of many tasks
            self.level, self.pixels = self.level + 1, [4 * p + k for p in self.pixels for k in range(4)]
        self.service = json.loads(options.get("service", "{}"))
        self.columns = schema.fieldNames()
        self.bounds: list[tuple] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1:
                self.bounds.append((f.attribute[0], TESTS[type(f)], list(f.value) if isinstance(f, In) else f.value))
        return filters  # Spark tests them all again

    def _may_hold(self, pix: int) -> bool:
        """Whether a cell can hold a declination within the bounds: no point of it is further from its centre than the side of a square with its area."""
        dec, reach = cells.centre(pix, self.level)[1], cells.resolution_arcsec(self.level) / 3600
        low, high = dec - reach, dec + reach
        for column, test, value in self.bounds:
            if column == "gaia_dec" and ((test in ("=", ">", ">=") and high < value) or (test in ("=", "<", "<=") and low > value)):
                return False
        return True

    def partitions(self):
        return [Cell(p) for p in self.pixels if self._may_hold(p)]

    def read(self, partition) -> Iterator[tuple]:
        if partition is None or partition.value is None:
            return  # no cell is left to ask for
        module, _, name = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        request = {"columns": self.columns, "bounds": self.bounds, "limit": self.limit, **self.service}
        taken = inspect.signature(fetch).parameters
        if not any(p.kind is p.VAR_KEYWORD for p in taken.values()):
            request = {k: v for k, v in request.items() if k in taken}
        asked = [(self.level, partition.value)]
        while asked:
            level, pix = asked.pop()
            reply = fetch(self.release, level, pix, **request)
            if self.limit is not None:
                reply = list(islice(reply, self.limit))
                if len(reply) >= self.limit:
                    if level == cells.MAX_LEVEL:
                        raise TooManyStars(f"cell {pix} of level {level} has {self.limit} stars or more")
                    asked += [(level + 1, 4 * pix + k) for k in range(4)]
                    continue
            for star in reply:
                yield tuple(star[c] for c in self.columns)


class StarArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "star_archive"

    def schema(self):
        return STAR_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options, schema)


def archive_query(
    spark: SparkSession, pixels: list[int], fetch: str, release: str = "dr3", level: int = 6, columns: list[str] | None = None, row_limit: int | None = None, service: dict | None = None, split: int = 0
) -> DataFrame:
    """Stars of the cells, all columns or those named. ``fetch`` is "module:function"; it is called with (release, level, pix), and by name with those of ``columns``,
    ``bounds`` (column, one of = < <= > >= in, value), ``limit`` and the entries of ``service`` that it takes, and gives dicts of the columns.
    Each cell is a task; with ``split`` its descendants of so many levels further are, for cells that hold many stars.

    Filters reach the service through ``spark.sql.python.filterPushdown.enabled``, which Spark wants to be set in the session; this call sets it.
    """
    spark.dataSource.register(StarArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    asked = T.StructType([STAR_SCHEMA[c] for c in columns]) if columns else STAR_SCHEMA
    options = {"fetch": fetch, "release": release, "level": str(level), "pixels": ",".join(map(str, pixels)), "service": json.dumps(service or {})}
    if row_limit is not None:
        options["row_limit"] = str(row_limit)
    if split:
        options["split"] = str(split)
    return spark.read.format("star_archive").schema(asked).options(**options).load()
