"""The state log of a pass: numbered folders of events, each made only if it is not there yet.

    state/pass_id=ID/version=N/*.parquet     the events of commit N
    state/pass_id=ID/_staged/...             what is not committed; hidden from readers

A writer reads the log up to its last number N, makes events from what it read, writes them aside, and renames the folder to number N + 1.
The rename is one step of the file system and fails where that number is taken; the writer then reads the log again and makes its
events anew. So every commit is made from all commits before it, and two runs of one pass cannot both take a cell. The
events are Parquet that Spark writes; the driver handles numbers and names. The file system must rename a folder in one step (HDFS and local ones do).

A cell is taken by a ``running`` event with an owner and a lease. While the lease lasts nobody else takes the cell; then it counts as left behind. Only
the owner ends it. ``attempt`` counts the times that a cell was taken since it was last done.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import STATE_SCHEMA, STATES, pass_path
from .work import publish

#: Which state may follow which; "" stands before the first event.
LEGAL = {
    "": ("pending", "running", "excluded"),
    "pending": ("running", "excluded"),
    "running": ("running", "done", "failed"),
    "done": ("running", "excluded"),
    "failed": ("running", "excluded"),
    "excluded": ("pending",),
}
VERSIONED = T.StructType([*STATE_SCHEMA.fields, T.StructField("version", T.LongType())])


class LostRace(RuntimeError):
    """Other writers took every number that this one tried."""


def ordered(events: DataFrame) -> F.Column:
    """The order of a cell's events."""
    return F.struct(*[c for c in ("version", "ts", "seq") if c in events.columns])


def latest(events: DataFrame) -> DataFrame:
    """Each cell's last state, and what its event says: an aggregate that combines in every task, no window."""
    said = [c for c in ("state", "note", "owner", "lease_until", "attempt") if c in events.columns]
    out = events.groupBy("outer_pix").agg(F.max_by(F.struct(*said), ordered(events)).alias("last"), F.max("ts").alias("ts"), F.count("*").alias("n_events"))
    return out.select("outer_pix", "last.*", "ts", "n_events")


def illegal(events: DataFrame) -> DataFrame:
    """Events that may not follow the one before them: outer_pix, before ("" for none), state, and their order columns."""
    keys = [c for c in ("version", "ts", "seq") if c in events.columns]
    before = F.coalesce(F.lag("state").over(Window.partitionBy("outer_pix").orderBy(*keys)), F.lit(""))
    fits = F.lit(False)
    for first, then in LEGAL.items():
        fits = fits | ((F.col("before") == first) & F.col("state").isin(*then))
    return events.withColumn("before", before).where(~F.coalesce(fits, F.lit(False))).select("outer_pix", "before", "state", *keys)


class StateLog:
    def __init__(self, spark: SparkSession, root: str, pass_id: str):
        self.spark, self.pass_id, self.path = spark, pass_id, pass_path(root, pass_id, "state")

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last number of the log, 0 for an empty one."""
        at, files = self._files()
        if not files.exists(at):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return max([int(n.partition("=")[2]) for n in names if n.startswith("version=")], default=0)

    def events(self, version: int | None = None) -> DataFrame:
        """All events, or those up to a number."""
        if not self.version():
            return self.spark.createDataFrame([], VERSIONED)
        try:
            out = self.spark.read.schema(VERSIONED).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], VERSIONED)
        return out if version is None else out.where(F.col("version") <= version)

    def _publish(self, staged: str, name: str) -> bool:
        return publish(self.spark, staged, f"{self.path}/{name}")

    def append(self, make: Callable[[DataFrame], DataFrame], tries: int = 100) -> DataFrame:
        """Commit the events that ``make`` gives for the log as it is (outer_pix, state, and what else an event has), and return them as
        committed. Nothing is committed where it gives none."""
        for _ in range(tries):
            number = self.version()
            rows = make(self.events(number))
            filled = {"pass_id": F.lit(self.pass_id), "ts": F.current_timestamp(), "seq": F.lit(0)}
            rows = rows.withColumns({c: v for c, v in filled.items() if c not in rows.columns or c == "pass_id"})
            rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STATE_SCHEMA])
            staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
            rows.hint("rebalance").write.parquet(staged)
            _, files = self._files()
            if self.spark.read.schema(STATE_SCHEMA).parquet(staged).isEmpty():
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(staged), True)
                return self.spark.createDataFrame([], VERSIONED)
            if self._publish(staged, f"version={number + 1}"):
                made = self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.path}/version={number + 1}")
                return made.withColumn("version", F.lit(number + 1).cast("long"))
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(staged), True)
        raise LostRace(f"no free number in {self.path} after {tries} tries")

    def once(self, name: str) -> bool:
        """Whether this call is the first one to ask for the name."""
        staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
        self.spark.range(1).write.parquet(staged)
        return self._publish(staged, f"_once-{name}")

    def record(self, events: DataFrame) -> None:
        """Append events as they are (outer_pix, state, ts, seq, note), such as the history of another system."""
        if not events.where(~F.col("state").isin(*STATES)).isEmpty():
            raise ValueError(f"states are {STATES}")
        self.append(lambda _: events)

    def claim(self, work: DataFrame, owner: str, lease_seconds: float = 3600.0, attempts: int | None = None) -> DataFrame:
        """Take the cells of ``work`` (outer_pix, and optionally note) that may be taken, and return those: cells that nobody runs, or whose lease has
        ended, and that were taken fewer than ``attempts`` times since they were last done."""
        now = datetime.now(UTC)
        free = (F.coalesce("state", F.lit("")) != "running") | F.coalesce(F.col("lease_until") < F.lit(now), F.lit(True))
        again = F.when(F.col("state").isin("running", "failed"), F.coalesce("attempt", F.lit(0))).otherwise(F.lit(0))

        def make(events: DataFrame) -> DataFrame:
            asked = work.join(latest(events).select("outer_pix", "state", "lease_until", "attempt"), "outer_pix", "left").where(free & (F.coalesce("state", F.lit("")) != "excluded"))
            asked = asked if attempts is None else asked.where(again < attempts)
            taken = {"state": F.lit("running"), "owner": F.lit(owner), "lease_until": F.lit(now + timedelta(seconds=lease_seconds)), "attempt": again + 1}
            return asked.withColumns(taken)

        return self.append(make)

    def finish(self, work: DataFrame, owner: str, state: str) -> DataFrame:
        """End the cells of ``work`` (outer_pix, note) as ``done`` or ``failed``. A cell that another owner has taken meanwhile stays that owner's."""

        def make(events: DataFrame) -> DataFrame:
            own = latest(events).where((F.col("state") == "running") & (F.col("owner") == owner)).select("outer_pix", "owner", "attempt")
            return work.join(own, "outer_pix").withColumn("state", F.lit(state))

        return self.append(make)

    def exclude(self, cells: DataFrame) -> DataFrame:
        """Mark cells as excluded, but for those that are, and for those that run."""
        return self.append(lambda events: cells.select("outer_pix").join(latest(events).where("state in ('excluded', 'running')"), "outer_pix", "left_anti").withColumn("state", F.lit("excluded")))
