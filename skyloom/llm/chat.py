"""Chat formatting (operator 2): reply trees to conversations.

``paths`` enumerates the root-to-leaf paths of reply trees by iterative self-joins. Each round joins the pointers
"ancestor at distance d" with themselves to get distance 2d, so a tree of depth D takes log2(D) rounds over one row
per node. Going down through the same tables, each leaf then reaches every ancestor once: the rows made are those
of the paths themselves. Branches of a tree are ranked by the sum of their nodes' scores (ties: smaller leaf) and the
best ``top`` are kept (all if None). Each kept path becomes one formatted conversation.

Template. A turn is ``<turn role="ROLE">\\nTEXT\\n</turn>\\n``. In ROLE and TEXT a backslash, ``<turn``, ``</turn``
and (in ROLE) ``"`` are escaped by a backslash before them, so no text can open or close a turn, and ``parse`` gives
back the exact roles and texts. ``loss`` holds the spans of the assistant texts in the formatted string.

Defined cases: null text and null role are empty; an empty conversation has no row; a reply to a node that is not
in the tree starts a tree of its own; where nodes reply to each other in a circle, the least node of the circle starts a
tree as if it replied to none; branches of one score rank by their leaf; rows with one turn number follow each other by role, then text; rows
of one node are turns of their own that follow each other by role, then text, wherever a path passes the node (which replies to the
least of their parents and has the sum of their scores); a null conversation id is one conversation; extra columns are ignored. A conversation is one string, so its
turns meet in one task; no other step gathers one.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

ESCAPED = re.compile(r'\\|</?turn|"')
ESCAPED_TEXT = re.compile(r"\\|</?turn")
UNESCAPE = re.compile(r'\\(\\|<|")')
HEAD = re.compile(r'<turn role="((?:[^"\\]|\\.)*)">\n', re.DOTALL)
END = "\n</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: str, pattern: re.Pattern = ESCAPED_TEXT) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: m[1], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f'<turn role="{escape(role, ESCAPED)}">\n', escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        head = HEAD.match(formatted, at)
        if head is None:
            raise ValueError(f"no turn at {at}")
        end = formatted.index(END, head.end())
        turns.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(END)
    return turns


def as_replies(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Linear conversations as reply trees: each row answers the row before it."""
    w = Window.partitionBy(conv).orderBy("turn", "role", "text")
    node = F.row_number().over(w).cast("long")
    return turns.select(F.col(conv).alias("conv_id"), node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _on(*names: str) -> Column:
    """Null-safe equality of l.x and r.x."""
    out = F.lit(True)
    for pair in names:
        left, _, right = pair.partition("=")
        out = out & F.col(f"l.{left}").eqNullSafe(F.col(f"r.{right or left}"))
    return out


def _jumps(links: DataFrame, limit: int, scratch: Scratch) -> list[DataFrame]:
    """Table k has each node's ancestor at distance 2^k. The last is empty, or its distance is above ``limit``, the number of nodes,
    so that its ancestors stand in circles."""
    jumps = [links.where("up is not null")]
    while not jumps[-1].isEmpty() and 2 ** (len(jumps) - 1) <= limit:
        last = jumps[-1]
        jumps.append(scratch.write(last.alias("l").join(last.alias("r"), _on("conv_id", "up=node")).select("l.conv_id", "l.node", "r.up"), "jumps"))
    return jumps


def _circle_heads(jumps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(conv_id, node): the least node of each circle. All that is a far ancestor stands in a circle; the least of a circle is
    found by doubling the distance over which each node has looked."""
    inside = jumps[-1].select("conv_id", F.col("up").alias("node")).distinct().alias("l")
    seen = inside.join(jumps[0].alias("r"), _on("conv_id", "node")).select("l.conv_id", "l.node", "r.up", F.least("l.node", "r.up").alias("least"))
    for _ in range(len(jumps)):
        seen = scratch.write(seen, "seen")
        seen = seen.alias("l").join(seen.alias("r"), _on("conv_id", "up=node")).select("l.conv_id", "l.node", "r.up", F.least("l.least", "r.least").alias("least"))
    return seen.where("node = least").select("conv_id", "node")


def paths(nodes: DataFrame, top: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(conv_id, leaf, rank, step, node) of the kept root-to-leaf paths; step 0 is the root.

    nodes: conv_id, node, parent, role, text, score; rows of one (conv_id, node) are one node.
    """
    scratch = scratch or Scratch(nodes.sparkSession)
    nodes = scratch.write(nodes.groupBy("conv_id", "node").agg(F.min("parent").alias("parent"), F.sum("score").alias("score")), "tree")
    links = nodes.select("conv_id", "node", "parent")
    known = links.select("conv_id", F.col("node").alias("parent"))
    links = links.alias("l").join(known.alias("r"), F.col("l.parent").isNotNull() & _on("conv_id", "parent"), "left")
    links = scratch.write(links.select("l.conv_id", "l.node", F.col("r.parent").alias("up")), "links")
    limit = links.count()
    jumps = _jumps(links, limit, scratch)
    if 2 ** (len(jumps) - 1) > limit and not jumps[-1].isEmpty():
        cut = _circle_heads(jumps, scratch)
        links = links.alias("l").join(cut.withColumn("cut", F.lit(True)).alias("r"), _on("conv_id", "node"), "left")
        links = scratch.write(links.select("l.conv_id", "l.node", F.when(F.col("cut").isNull(), F.col("l.up")).alias("up")), "links")
        scratch.drop("jumps")
        jumps = _jumps(links, limit, scratch)
    leaves = links.alias("l").join(links.where("up is not null").alias("r"), _on("conv_id", "node=up"), "left_anti")
    reached = leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height"))
    for k in range(len(jumps) - 2, -1, -1):
        far = reached.alias("l").join(jumps[k].alias("r"), _on("conv_id", "node")).select("l.conv_id", "l.leaf", F.col("r.up").alias("node"), (F.col("l.height") + 2**k).alias("height"))
        reached = scratch.write(reached.unionByName(far), "reached")
    scored = reached.alias("l").join(nodes.alias("r"), _on("conv_id", "node")).select("l.*", "r.score")
    branches = scored.groupBy("conv_id", "leaf").agg(F.sum("score").alias("score"), F.max("height").alias("top"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf"))
    branches = branches.withColumn("rank", rank)
    if top is not None:
        branches = branches.where(F.col("rank") <= top)
    out = reached.alias("l").join(branches.alias("r"), _on("conv_id", "leaf")).select("l.conv_id", "l.leaf", "r.rank", (F.col("r.top") - F.col("l.height")).alias("step"), "l.node")
    out = scratch.write(out, "paths")
    scratch.drop("tree", "links", "jumps", "seen", "reached")
    return out


def format_conversations(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """conv_id, leaf, rank, formatted, loss (array of start and end) of each kept path."""
    # written: the steps below read the nodes many times
    scratch = Scratch(nodes.sparkSession)
    nodes = scratch.write(nodes.select("conv_id", "node", "parent", "role", "text", "score"), "nodes")
    steps = paths(nodes, top, scratch)
    filled = nodes.select("conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = steps.alias("l").join(filled.alias("r"), _on("conv_id", "node")).select("l.*", "r.role", "r.text")
    rows = rows.groupBy("conv_id", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("step", "role", "text"))).alias("turns"))
    kind = nodes.schema["conv_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            return pa.RecordBatch.from_pydict(
                {
                    "conv_id": batch.column("conv_id"),
                    "leaf": batch.column("leaf"),
                    "rank": batch.column("rank"),
                    "formatted": pa.array([m[0] for m in made], pa.string()),
                    "loss": pa.array([[{"start": a, "end": b} for a, b in m[1]] for m in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                }
            )

        return step

    out = scratch.write(arrow_map(rows, make, f"conv_id {kind}, leaf long, rank int, formatted string, loss array<struct<start: bigint, end: bigint>>"), "formatted")
    scratch.close("formatted")
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation says: turns and loss text, parsed and unescaped from the output itself."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = parse(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(learnt))
                out["loss_sha256"].append(hashlib.sha256(learnt.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            return pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id")} | out)

        return step

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return arrow_map(formatted, make, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
