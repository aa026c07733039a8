"""Mixing sources to target weights (operator 10): a low-discrepancy schedule of equal-token blocks.

Targets. Sources share the total size by weight; a source's share stops at ``max_epochs`` times its size and the
excess goes to the others by weight, until no share is above its stop.

Blocks. Each source's documents lie in shuffled (hash) order end to end on a line that repeats for each epoch; block r
of a source is the words [r * block, (r + 1) * block) of its line. A source needs quota = ceil(target / block) blocks,
the last one cut at the target. A block has at most ``MOST_WORDS`` words, so its length does not grow with the corpus.

Schedule. Slot i has the point frac((i + 1) * golden ratio); cumulative quotas map the point to a source, and the rank of
the slot among its source's slots is the block that it takes; slots beyond the quota are void. Any interval of the
unit line gets its points at an even pace, so at every moment of the schedule the sources stand near their weights,
and 3 slots for each block needed are enough for every quota (checked; more are made if not).

Order. What the mix takes of a document in an epoch stands at the slot of the block that holds its first word; ``mixed`` gives
the documents in the order of these slots, one range of slots in each partition.

Scale. Ranks and places on the lines are running sums in two levels (within sections of slots or of hash space, then
over the sections), so no source and no group of rows gathers in one task. The table of sources, one row per source,
is the only thing held by the driver; it is limited to ``MAX_SOURCES`` rows.

Defined cases: null text has size 0; a document of size 0 is never taken; a null source is a source of its own, last in
order; rows with equal ids are documents of their own, whose shuffled order falls back on their text and row; a null id
is shuffled by its text; extra columns are ignored; an empty table, or one with no words, takes nothing and has targets of 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Blocks that the whole mix is cut into, about; the block length follows from it.
BLOCKS = 200_000
#: Words of a block at most.
MOST_WORDS = 65_536
MAX_SOURCES = 1_000_000
#: Sections of the hash space in a source, and slots in a section of the schedule.
HASH_SECTIONS = 4096
SLOT_SECTION = 65_536
GOLDEN = (5**0.5 - 1) / 2
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Source:
    source: str | None
    size: int
    target: float
    quota: int  # blocks


def words_of(text: Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> list[tuple[str | None, int, float]]:
    """Each source's target. ``sizes`` is ordered by code point, null last; weights repeat along it."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    total, stopped = sum(n for _, n in sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        left = total - max_epochs * sum(sizes[i][1] for i in stopped)
        unit = left / sum(weight[i] for i in free) if free else 0.0
        above = {i for i in free if weight[i] * unit > max_epochs * sizes[i][1]}
        if not above:
            return [(s, n, float(max_epochs * n) if i in stopped else weight[i] * unit) for i, (s, n) in enumerate(sizes)]
        stopped |= above


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, blocks: int = BLOCKS) -> tuple[int, list[Source]]:
    """Block length and sources of a mix over rows with ``source`` and ``size``."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = sorted(((r["source"], int(r["size"])) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    block = min(MOST_WORDS, max(1, sum(n for _, n in sizes) // blocks))
    return block, [Source(s, n, t, math.ceil(math.floor(t) / block)) for s, n, t in targets(sizes, weights, max_epochs)]


def schedule(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(slot, source_no, rank): which block of which source each used slot takes."""
    needed = sum(s.quota for s in sources)
    bounds, at = [], 0
    for no, s in enumerate(sources):
        if s.quota:
            bounds.append((no, at / needed, (at + s.quota) / needed if at + s.quota < needed else 2.0, s.quota))
        at += s.quota
    if not bounds:
        return spark.createDataFrame([], "slot long, source_no int, rank long")
    lines = spark.createDataFrame(bounds, "source_no int, low double, high double, quota long")
    cells = 4096
    # Points and intervals meet by cell of the unit line: an equi-join, whatever the number of sources.
    lines = lines.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    slots = 3 * needed + 3
    while True:
        point = (F.col("id") + 1) * F.lit(GOLDEN)
        points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point"))
        points = points.withColumn("cell", F.floor(F.col("point") * cells))
        chosen = points.join(lines, "cell").where("point >= low and point < high").select("slot", "source_no", "quota", F.floor(F.col("slot") / SLOT_SECTION).alias("section"))
        counts = chosen.groupBy("source_no", "section").agg(F.count("*").alias("n"))
        before = counts.select("source_no", "section", (F.sum("n").over(Window.partitionBy("source_no").orderBy("section")) - F.col("n")).alias("before"))
        inside = F.row_number().over(Window.partitionBy("section", "source_no").orderBy("slot")) - 1
        ranked = chosen.withColumn("inside", inside).join(before, ["source_no", "section"])
        ranked = ranked.select("slot", "source_no", "quota", (F.col("inside") + F.col("before")).alias("rank")).where("rank < quota")
        ranked = written(ranked.select("slot", "source_no", "rank"), "schedule")
        if ranked.count() == needed:
            return ranked
        slots *= 2


def _placed(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, blocks: int, seed: str, key: str, row: str | None, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Per row: row, key, size, source_no, source_size, target, take and its place on its source's line. Per row and epoch that
    the mix takes words of: row, epoch, low (place on the repeated line), words and the slot of the first of them. And the
    number of slots that a schedule runs over."""
    spark = docs.sparkSession
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(key).alias("key"), "source", words_of(F.col("text")).alias("size"), F.md5(F.concat_ws(":", F.lit(seed), name)).alias("shuffle"), F.xxhash64("text").alias("tie"))
    rows = scratch.write(rows, "sized")
    block, sources = plan(rows, weights, max_epochs, blocks)
    table = spark.createDataFrame([(no, s.source, s.size, s.target, math.floor(s.target)) for no, s in enumerate(sources)], "source_no int, source string, source_size long, target double, take long")
    rows = rows.alias("l").join(table.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.row", "l.key", "l.size", "l.shuffle", "l.tie", "r.source_no", "r.source_size", "r.target", "r.take")
    # Each row's place on its source's line: sizes before it in its section, and of the sections before.
    rows = rows.withColumn("section", F.conv(F.substring("shuffle", 1, 3), 16, 10).cast("int"))
    sections = rows.groupBy("source_no", "section").agg(F.sum("size").alias("n"))
    before = sections.select("source_no", "section", (F.sum("n").over(Window.partitionBy("source_no").orderBy("section")) - F.col("n")).alias("before"))
    own = F.sum("size").over(Window.partitionBy("source_no", "section").orderBy("shuffle", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("own", own).join(before, ["source_no", "section"]).withColumn("place", F.col("own") + F.col("before")).drop("own", "before", "section", "shuffle", "tie")
    placed = scratch.write(placed, "placed")
    scratch.drop("sized")
    # Each epoch of a row covers whole blocks and parts of two; a part counts up to the target.
    epochs = placed.where("size > 0 and place < take").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    epochs = epochs.withColumn("low", F.col("place") + F.col("epoch") * F.col("source_size")).withColumn("high", F.least(F.col("low") + F.col("size"), F.col("take"))).where("low < high")
    pieces = epochs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    words = F.least("high", (F.col("rank") + 1) * block) - F.greatest("low", F.col("rank") * block)
    pieces = pieces.select("row", "epoch", "low", "source_no", "rank", words.alias("words"))
    slots = schedule(spark, sources)
    taken = pieces.join(slots, ["source_no", "rank"]).groupBy("row", "epoch", "low").agg(F.sum("words").alias("words"), F.min_by("slot", "rank").alias("slot"))
    return placed, taken, (slots.agg(F.max("slot")).first()[0] or 0) + 1


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, blocks: int = BLOCKS, seed: str = "mix", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """Per row: key, row (the column of that name, else a number given here), size, source_size, target, taken, and first_slot, the place of its first word in the mix (null if none)."""
    placed, taken, _ = _placed(docs, weights, max_epochs, blocks, seed, key, row, Scratch(docs.sparkSession))
    out = placed.join(taken.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")), "row", "left")
    return out.select(F.col("key").alias(key), "row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, blocks: int = BLOCKS, seed: str = "mix") -> DataFrame:
    """The rows of the mix in the order of its slots, all columns as they are: each row once for every epoch in which the mix
    takes the first of its words.

    A source's taken words are the first of its repeated line, so all of a source's epochs are whole but its last; in
    that one the rows up to the target are in. One row at most is longer than what is taken of it.
    """
    columns = docs.columns
    spark = docs.sparkSession
    rows = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*columns).alias("_all")), "rows")
    flat = rows.select("_row", F.col("_all.doc_id").alias("doc_id"), F.col("_all.source").alias("source"), F.col("_all.text").alias("text"))
    _, taken, slots = _placed(flat, weights, max_epochs, blocks, seed, "doc_id", "_row", Scratch(spark))
    times = taken.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("slot", "low")).alias("_times"))  # one for each epoch
    out = rows.join(times, "_row").select("_all", F.explode("_times").alias("_at"))
    # Slots hold equal numbers of words, so equal ranges of slots make equal partitions, and their bounds need no sample.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = out.repartitionById(parts, F.floor(F.col("_at.slot") * parts / slots).cast("int"))
    return out.sortWithinPartitions("_at.slot", "_at.low").select("_all.*")
