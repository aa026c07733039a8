"""Exact top-k search (operator 4): ball trees per shard, branch and bound on the inner product.

Vectors become integers floor(scale * x). Each shard of the table builds a ball tree, once: a node splits at the median of
the direction of its widest spread and holds centre and radius. For a query q no vector in a node scores above
q.centre + |q| * radius. A shard visits its leaves for a query in falling order of that bound and stops when it is
below the query's current kth score.

The index is a written table, one row for each node of a tree. While a shard builds its tree it also searches it for its own
queries; the kth score that each finds at home is the floor from which every other shard starts, so it is shared with
the query. Queries travel in blocks of ``BLOCK``, each block once to each other shard, and stream through the shard's tree in
its task: the driver holds neither queries nor scores, no block is broadcast, and a task holds one tree and a few blocks.
Bounds are in floating point with a margin far above its rounding error, scores are exact integers. Each shard hands
on k rows per query at most.

Defined cases: a vector that is null or empty, or holds a null or non-finite component or one that is not finite when
scaled, takes no part; a shorter vector is padded with zeros; ties go to the smaller id, then to the earlier row; equal ids
are rows of their own and only a query's own row is left out; scores beyond 64 bits saturate; extra columns are ignored; an
empty table or query set gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

BLOCK = 64
LEAF = 64
#: Rows of a shard's tree.
SHARD_ROWS = 65_536
LONG = 2**63 - 1
HITS = "array<struct<query_uid: bigint, query_id: bigint, uid: bigint, vec_id: bigint, score: bigint>>"
#: kind 0: a node of a shard's tree (a leaf has uids, ids and points). kind 1: a block of the shard's queries, with floors and hits at home.
INDEX = f"shard int, kind int, seq int, left_child int, right_child int, centre binary, radius double, uids array<bigint>, ids array<bigint>, points binary, floors array<double>, hits {HITS}"

_LONGS = pa.list_(pa.int64())
ARROW_INDEX = pa.schema(
    {"shard": pa.int32(), "kind": pa.int32(), "seq": pa.int32(), "left_child": pa.int32(), "right_child": pa.int32(), "centre": pa.binary(), "radius": pa.float64(), "uids": _LONGS, "ids": _LONGS, "points": pa.binary(), "floors": pa.list_(pa.float64())}
    | {"hits": pa.list_(pa.struct({c: pa.int64() for c in ("query_uid", "query_id", "uid", "vec_id", "score")}))}
)


def scaled(vectors: list[list[float] | None], scale: float = 1024.0) -> np.ndarray:
    """floor(scale * x) of vectors without nulls, padded with zeros to one length."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * scale)


def matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """As scaled, of a column of lists."""
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy()
    if len(sizes) and (sizes == sizes[0]).all():
        return np.floor(column.flatten().to_numpy().reshape(len(sizes), -1) * scale)
    return scaled(column.to_pylist(), scale)


def padded(points: np.ndarray, width: int) -> np.ndarray:
    return np.pad(points, ((0, 0), (0, width - points.shape[1])))


def exact(scores_of: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products of float64 rows that hold integers."""
    top = float(np.abs(scores_of).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if top < 2**53:
        return (scores_of @ query).astype(np.int64)  # every sum on the way is a whole number that a double holds
    whole = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in scores_of]
    return np.array([max(-LONG - 1, min(LONG, s)) for s in whole], np.int64)


class BallTree:
    """A ball tree: centre, radius and children of every node; a leaf has a range of the rows of ``points``."""

    def __init__(self, points: np.ndarray, centres: np.ndarray, radii: np.ndarray, nodes: list[tuple[int, int, np.ndarray | None]]):
        self.points, self.centres, self.radii, self.nodes = points, centres, radii, nodes

    @classmethod
    def build(cls, points: np.ndarray) -> BallTree:
        centres, radii, nodes = [], [], []

        def grow(rows: np.ndarray) -> int:
            own = points[rows]
            centre = own.mean(axis=0)
            from_centre = ((own - centre) ** 2).sum(axis=1)
            at, radius = len(nodes), float(np.sqrt(from_centre.max()))
            centres.append(centre)
            radii.append(radius)
            nodes.append((-1, -1, rows))
            if len(rows) > LEAF and radius > 0.0:
                side = own @ (own[from_centre.argmax()] - centre)
                half = len(rows) // 2
                order = np.argpartition(side, half)
                nodes[at] = (grow(rows[order[:half]]), grow(rows[order[half:]]), None)
            return at

        grow(np.arange(len(points)))
        return cls(points, np.array(centres), np.array(radii), nodes)

    def as_rows(self, shard: int, ids: np.ndarray, uids: np.ndarray) -> Iterator[dict]:
        for at, (left, right, rows) in enumerate(self.nodes):
            row = {"shard": shard, "kind": 0, "seq": at, "left_child": left, "right_child": right, "centre": self.centres[at].tobytes(), "radius": float(self.radii[at])}
            yield row if rows is None else row | {"uids": uids[rows].tolist(), "ids": ids[rows].tolist(), "points": self.points[rows].tobytes()}

    @classmethod
    def of_rows(cls, rows: list[dict]) -> tuple[BallTree, np.ndarray, np.ndarray]:
        """The tree of rows in the order of their ``seq``, and ids and uids of its points."""
        width = len(rows[0]["centre"]) // 8
        points, ids, uids, nodes, at = [], [], [], [], 0
        for r in rows:
            inside = None
            if r["points"] is not None:
                inside = np.arange(at, at + len(r["uids"]))
                at += len(inside)
                points.append(np.frombuffer(r["points"]).reshape(-1, width))
                ids += r["ids"]
                uids += r["uids"]
            nodes.append((r["left_child"], r["right_child"], inside))
        centres = np.array([np.frombuffer(r["centre"]) for r in rows])
        return cls(np.concatenate(points), centres, np.array([r["radius"] for r in rows]), nodes), np.array(ids), np.array(uids)

    def widened(self, width: int) -> BallTree:
        return self if width <= self.points.shape[1] else BallTree(padded(self.points, width), padded(self.centres, width), self.radii, self.nodes)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """An upper bound of the inner product for every node."""
        norm = float(np.sqrt(query @ query))
        top = self.centres @ query + norm * self.radii
        return top + (np.abs(top) + norm * (self.radii + np.abs(self.centres).max(initial=0))) * 1e-9 + 1

    def leaves(self, bound: np.ndarray, floor: float) -> Iterator[tuple[float, np.ndarray]]:
        """Leaves in falling order of their bound, without the nodes that are below ``floor``."""
        from heapq import heappop, heappush

        heap = [(-bound[0], 0)]
        while heap:
            top, at = heappop(heap)
            if -top < floor:
                return
            left, right, rows = self.nodes[at]
            if rows is not None:
                yield -top, rows
            else:
                for child in (left, right):
                    if bound[child] >= floor:
                        heappush(heap, (-bound[child], child))


def search_shard(tree: BallTree, ids: np.ndarray, uids: np.ndarray, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int, int]]:
    """The k best (score, id, uid) of a shard for one query, of those that can reach ``floor``."""
    best_s = np.empty(0, np.int64)
    best_i, best_u = np.empty(0, np.int64), np.empty(0, np.int64)
    kth = floor
    for bound, rows in tree.leaves(tree.bounds(query), floor):
        if bound < kth:
            break
        keep = rows[uids[rows] != own]
        s = np.concatenate([best_s, exact(tree.points[keep], query)])
        i, u = np.concatenate([best_i, ids[keep]]), np.concatenate([best_u, uids[keep]])
        order = np.lexsort((u, i, -s.astype(np.float64) if abs(s).max(initial=0) < 2**53 else [-int(x) for x in s]))[:k]
        best_s, best_i, best_u = s[order], i[order], u[order]
        if len(best_s) == k:
            kth = max(kth, float(best_s[-1]))
    return list(zip(best_s.tolist(), best_i.tolist(), best_u.tolist(), strict=True))


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that ``is_query`` (a column) marks."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float("inf"))))
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = scratch.write(rows.where(fine & F.col("id").isNotNull()), "vectors")
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, -(-total // 2048)))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids, uids, asked = (table.column(c).to_numpy() for c in ("id", "uid", "asked"))
        tree = BallTree.build(matrix(table.column("v"), scale))
        out, queries = list(tree.as_rows(shard, ids, uids)), np.flatnonzero(asked)
        for n, at in enumerate(range(0, len(queries), BLOCK)):
            block = queries[at : at + BLOCK]
            found = [search_shard(tree, ids, uids, tree.points[q], int(uids[q]), k, -np.inf) for q in block]
            hits = [{"query_uid": int(uids[q]), "query_id": int(ids[q]), "uid": u, "vec_id": i, "score": s} for q, own in zip(block, found, strict=True) for s, i, u in own]
            floors = [float(own[-1][0]) if len(own) == k else float("-inf") for own in found]
            out.append({"shard": shard, "kind": 1, "seq": n, "uids": uids[block].tolist(), "ids": ids[block].tolist(), "points": tree.points[block].tobytes(), "floors": floors, "hits": hits})
        return pa.Table.from_pylist(out, ARROW_INDEX)

    index = scratch.write(dealt.groupBy("shard").applyInArrow(build, INDEX), "index")
    scratch.drop("vectors")
    blocks = index.where("kind = 1")
    away = blocks.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("to <> shard").withColumn("shard", F.col("to")).drop("to")
    stream = index.where("kind = 0").unionByName(away).drop("hits")
    stream = stream.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "seq")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nodes, made = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, nodes, made = r["shard"], [], None
                if r["kind"] == 0:
                    nodes.append(r)
                    continue
                tree, ids, uids = made = made or BallTree.of_rows(nodes)
                nodes = []
                q = np.frombuffer(r["points"]).reshape(len(r["uids"]), -1)
                width = max(q.shape[1], tree.points.shape[1])
                tree, q = tree.widened(width), padded(q, width)
                out = [(own, name, u, i, s) for own, name, point, floor in zip(r["uids"], r["ids"], q, r["floors"], strict=True) for s, i, u in search_shard(tree, ids, uids, point, own, k, floor)]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_uid", "query_id", "uid", "vec_id", "score"])

    found = stream.mapInArrow(search, "query_uid long, query_id long, uid long, vec_id long, score long")
    found = found.unionByName(blocks.select(F.explode("hits").alias("h")).select("h.*"))
    best = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
