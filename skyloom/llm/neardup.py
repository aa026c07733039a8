"""Near-duplicate classes (operator 5): Order MinHash candidates, verified by banded alignment.

A text is its words (lower case, letters and digits) as a sequence of 5-word shingles; each shingle is labelled with the
number of times that it has come before in the text, so the labelled shingles of a text are distinct.

Sketch. Each of ``SKETCHES`` hash orders takes the ``TAKEN`` least labelled shingles and keeps them *in text order*; the
hash of that list is a key. Two texts share a key with about similarity ** TAKEN, and only if the common part stands
in one order: the sketch follows edit similarity. A pair is plausible if it shares ``NEEDED`` keys (any, if one text has under
``SHORT`` shingles) and its lengths allow the similarity. At 0.8 a pair is not plausible in 3e-7 of the cases (long texts;
1e-4 for the shortest, of four and five shingles), more similar pairs in fewer.

Similarity. c / (n_a + n_b - c), where c is the length of the best common ordered chain of labelled shingles (the Jaccard
index, if the order agrees). A pair of similarity t has a chain whose places differ by at most
(n_a + n_b) * (1 - t) / (1 + t) at every link, so the alignment is done in this band and loses nothing.

Candidates. Copies are one node (the digest of the words, with a number), so groups of copies make no pairs. In a key shared
by few nodes all pairs are candidates. In a larger one each node meets the hub, the node that shares most keys with
others. Nodes that are not in the hub's component after that meet all nodes of other components, in two rounds of tiles of
bounded size, each pair under its first shared large key only: the first round compares sketches, which are short, and names
the nodes that have a plausible partner; the second compares the texts of these. So every plausible pair of different texts
is linked, or compared, or in one component already, and no text is copied for nodes that only share a passage.

Classes are connected components, found by least labels with pointer jumping; the class id is the least doc_id.

Defined cases: a null text is a class of its own for each row; texts without words are copies if they are equal; texts of less than
five words have one shingle; rows with equal ids and texts are one document; rows with equal ids and other texts
are told apart; null ids are never class ids unless a class has no other; extra columns are ignored by ``classes`` and
kept by ``keep_first``; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, small_batches, texts

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 40
TAKEN = 4
#: Keys that a plausible pair shares, and shingles from which so many are asked.
NEEDED, SHORT = 3, 16
#: Nodes of a key up to which all its pairs are candidates, and nodes of a tile of sketches and of texts.
ALL_PAIRS = 12
TILE, TEXT_TILE = 768, 256
#: Members of a large key that one row carries through a join on the key, about.
CHUNK = 256
WORD = re.compile(r"\w+")
CACHE_ENTRIES = 600_000
#: Numbers that one step over all hash orders may hold.
HELD = 1_000_000


@lru_cache(maxsize=1)
def _orders() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(5))
    return draw.integers(0, 2**64, SKETCHES, np.uint64) | np.uint64(1), draw.integers(0, 2**64, SKETCHES, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


class Hasher:
    """Labelled shingles of texts, with a cache of word hashes."""

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.cache: dict[str, int] = {}

    def shingles(self, own: list[str]) -> np.ndarray:
        cache = self.cache
        got = [cache.get(w) for w in own]
        if None in got:
            fresh = {w: self.hash(w) for w, h in zip(own, got, strict=True) if h is None}
            got = [fresh[w] if h is None else h for w, h in zip(own, got, strict=True)]
            if len(cache) < CACHE_ENTRIES:
                cache.update(fresh)
        h = np.array(got, np.uint64)
        n = max(1, len(own) - SHINGLE + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(SHINGLE, len(own))):
                out = (out * np.uint64(0x100000001B3)) ^ h[k : k + n]
                out = _mixed(out)
        # the count of equal shingles before: 0 for most texts
        order = np.argsort(out, kind="stable")
        again = out[order][1:] == out[order][:-1]
        if again.any():
            starts = np.r_[0, np.flatnonzero(~again) + 1]
            sizes = np.diff(np.r_[starts, n])
            label = np.empty(n, np.uint64)
            label[order] = np.arange(n, dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
            out = np.where(label == 0, out, _mixed(out + label))
        return out


@lru_cache(maxsize=1)
def _hasher() -> Hasher:
    """The hasher of this worker, shared by its tasks."""
    return Hasher()


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One key per hash order: the hash of the TAKEN least labelled shingles in text order."""
    a, b = _orders()
    n, take = len(shingles), min(TAKEN, len(shingles))
    keys = np.empty(SKETCHES, np.uint64)
    step = max(1, HELD // n)
    with np.errstate(over="ignore"):
        for k in range(0, SKETCHES, step):
            h = _mixed(shingles[None, :] * a[k : k + step, None] + b[k : k + step, None])
            rows = np.arange(len(h))
            places = np.empty((len(h), take), np.int64)
            for j in range(take):
                places[:, j] = h.argmin(axis=1)
                h[rows, places[:, j]] = np.iinfo(np.uint64).max
            places.sort(axis=1)
            key = b[k : k + step].copy()
            for j in range(take):
                key = _mixed(key * np.uint64(0x100000001B3) ^ shingles[places[:, j]])
            keys[k : k + step] = key
    return keys.view(np.int64)


def digest(text: str, own: list[str]) -> bytes:
    body = "\0".join(own) if own else "\1" + text
    return hashlib.blake2b(body.encode(), digest_size=16).digest()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two sequences of labelled shingles by banded alignment; 0 if surely below ``least``."""
    total = len(a) + len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    place = {s: j for j, s in enumerate(b.tolist())}
    band = total * (1 - least) / (1 + least)
    found = [(i, place[s]) for i, s in enumerate(a.tolist()) if s in place]
    if len(found) < least * (total - len(found)):
        return 0.0
    ends: list[int] = []  # longest rising chain of places
    for i, j in found:
        if abs(i - j) <= band:
            at = bisect_left(ends, j)
            ends[at : at + 1] = [j]
    return len(ends) / (total - len(ends))


def nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, raw (hash of the text), node (digest of the words, null for a null text), n (shingles), keys."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        hasher = _hasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {"node": [], "n": [], "keys": []}
            for t in batch.column("text").to_pylist():
                own = WORD.findall(t.lower()) if t else []
                out["node"].append(None if t is None else digest(t, own))
                if own:
                    s = hasher.shingles(own)
                    out["n"].append(len(s))
                    out["keys"].append(sketch(s))
                else:
                    out["n"].append(0)
                    out["keys"].append([])
            return pa.RecordBatch.from_pydict({key: batch.column(key), "raw": batch.column("raw"), "node": pa.array(out["node"], pa.binary()), "n": pa.array(out["n"], pa.int32()), "keys": pa.array(out["keys"], pa.list_(pa.int64()))})

        return step

    return arrow_map(docs.select(key, docs[text].alias("text"), F.xxhash64(docs[text]).alias("raw")), make, f"{key} {kind}, raw long, node binary, n int, keys array<bigint>")


def _plausible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose lengths and sketches allow a similarity of ``least``."""
    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("keys").alias(f"keys_{end}")), end)
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    shared = F.size(F.array_intersect("keys_a", "keys_b"))
    return pairs.where((small >= least * large) & (shared >= F.when(small < SHORT, 1).otherwise(NEEDED))).select("a", "b")


def _bodies(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """id and text of the wanted nodes (id, first, raw); the keys of ``docs`` may be null or have several texts."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("raw")).alias("r")
    # The wanted rows grow with the corpus, so the join is never one that broadcasts them.
    found = rows.join(wanted.hint("merge").alias("w"), F.col("r.key").eqNullSafe(F.col("w.first")) & (F.col("r.raw") == F.col("w.raw")))
    return found.groupBy("id").agg(F.first("text").alias("text"))


def _sequence(hasher: Hasher, text: str) -> np.ndarray:
    return hasher.shingles(WORD.findall(text.lower()))


def _verified(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is ``least`` or more."""
    both = pairs
    for end, name in (("a", "left"), ("b", "right")):
        both = both.join(bodies.select(F.col("id").alias(end), F.col("text").alias(name)), end)

    def make():
        hasher = _hasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            known: dict[int, np.ndarray] = {}  # a batch has one text in many pairs

            def of(node: int, text: str) -> np.ndarray:
                if node not in known:
                    known[node] = _sequence(hasher, text)
                return known[node]

            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "left", "right")), strict=True)
            found = [similarity(of(a, x), of(b, y), least) for a, b, x, y in rows]
            return pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(found, pa.float64())})

        return step

    return arrow_map(both.select("a", "b", "left", "right"), make, "a long, b long, similarity double").where(F.col("similarity") >= least)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component (least id) of each node of the links (a, b): least labels with pointer jumping."""
    both = scratch.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ends = labels.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
        jumped = scratch.write(step.join(ends, "label", "left").select("id", "old", F.least("label", "beyond").alias("label")), "labels")
        scratch.drop_older("labels")
        labels = jumped.select("id", "label")
        if jumped.where("label <> old").isEmpty():
            scratch.drop("edges")
            return labels.withColumnRenamed("label", "component")


def _tiled(members: DataFrame, tile: int, carried: tuple[str, ...]) -> DataFrame:
    """Each row of ``members`` (key, id, query, size, queries and what is carried), once for each tile that it enters: as a
    member of one tile with every tile of queries, and, if it is a query, as one with every tile of members."""
    tiles, query_tiles = (F.ceil(F.col(c) / tile).cast("int") for c in ("size", "queries"))
    own = F.pmod(F.xxhash64("id"), tiles).cast("int")
    asked = F.pmod(F.xxhash64("id", F.lit(1)), query_tiles).cast("int")

    def places(fixed: Column, moving: Column, asks: bool) -> Column:
        pair = (lambda t: (t, fixed)) if asks else (lambda t: (fixed, t))
        return F.transform(F.sequence(F.lit(0), moving - 1), lambda t: F.struct(pair(t)[0].alias("tile"), pair(t)[1].alias("query_tile"), F.lit(asks).alias("asks")))

    both = F.concat(places(own, query_tiles, False), F.when(F.col("query"), places(asked, tiles, True)).otherwise(F.array()))
    return members.select("key", "id", "query", *carried, F.explode(both).alias("_at")).select("key", "id", "query", *carried, "_at.*")


def _plausible_members(members: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(key, id) of the members of a large key that have a plausible partner of another component under that key.

    A member's sketch comes to it by one join on the node, each node once, and is copied for its keys and tiles after it.
    """
    held = members.groupBy("id").agg(F.first("component").alias("component"), F.collect_list(F.struct("key", "query", "size", "queries")).alias("held"))
    rows = held.join(nodes.select("id", "n", "keys"), "id")
    rows = rows.withColumn("large", F.col("held.key")).withColumn("h", F.explode("held"))
    # bit j: the key of hash order j is a large one; place: the hash order of this key
    bits = F.aggregate(F.transform("keys", lambda k, j: F.when(F.array_contains("large", k), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    rows = rows.select("h.*", "id", "component", "n", "keys", bits.alias("bits"), (F.array_position("keys", F.col("h.key")) - 1).cast("int").alias("place"))
    rows = _tiled(rows, TILE, ("component", "n", "keys", "bits", "place"))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)
        ids, parts, sizes, query, bits = (table.column(c).to_numpy() for c in ("id", "component", "n", "query", "bits"))
        place = table.column("place")[0].as_py()
        have = np.flatnonzero(~asks)
        members_, marked = keys[have], np.zeros(len(asks), bool)
        for q in np.flatnonzero(asks).tolist():
            n = np.minimum(sizes[have], sizes[q])
            open_ = (parts[have] != parts[q]) & (n >= least * np.maximum(sizes[have], sizes[q])) & (~query[have] | (ids[have] > ids[q]))
            equal = members_ == keys[q]
            open_ &= equal.sum(axis=1) >= np.where(n < SHORT, 1, NEEDED)
            if open_.any():
                earlier = [j for j in range(place) if int(bits[q]) >> j & 1]
                open_ &= ~equal[:, earlier].any(axis=1)
                if open_.any():
                    marked[have[open_]] = True
                    marked[q] = True
        return pa.table({"key": table.column("key").filter(pa.array(marked)), "id": table.column("id").filter(pa.array(marked))})

    return rows.groupBy("key", "tile", "query_tile").applyInArrow(compare, "key long, id long").distinct()


def _tile_links(members: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """Links between members of one large key that join different components, by their texts. Of the links of a tile only
    those come that join what the tile's links before have not."""
    held = members.groupBy("id").agg(F.first("component").alias("component"), F.collect_list(F.struct("key", "query", "size", "queries")).alias("held"))
    rows = held.join(bodies, "id").withColumn("h", F.explode("held")).select("h.*", "id", "component", "text")
    rows = _tiled(rows, TEXT_TILE, ("component", "text"))

    def compare(table: pa.Table) -> pa.Table:
        hasher, head = _hasher(), {}
        asks, query = table.column("asks").to_numpy(), table.column("query").to_pylist()
        ids, parts, bodies_ = (table.column(c).to_pylist() for c in ("id", "component", "text"))
        seqs = [_sequence(hasher, t) for t in bodies_]
        sizes = np.array([len(s) for s in seqs])

        def find(c: int) -> int:
            while head.get(c, c) != c:
                c = head[c]
            return c

        have, found = np.flatnonzero(~asks), []
        for q in np.flatnonzero(asks).tolist():
            s, n, mine = seqs[q], len(seqs[q]), np.sort(seqs[q])
            for j in have[np.minimum(sizes[have], n) >= least * np.maximum(sizes[have], n)].tolist():
                if (query[j] and ids[j] <= ids[q]) or find(parts[j]) == find(parts[q]):
                    continue
                at = np.searchsorted(mine, seqs[j])
                common = int((mine[np.minimum(at, n - 1)] == seqs[j]).sum())
                if common >= least * (n + sizes[j] - common):
                    v = similarity(s, seqs[j], least)
                    if v >= least:
                        found.append((min(ids[q], ids[j]), max(ids[q], ids[j]), v))
                        head[find(parts[q])] = find(parts[j])
        a, b, v = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(v, pa.float64())})

    return rows.groupBy("key", "tile", "query_tile").applyInArrow(compare, "a long, b long, similarity double").dropDuplicates(["a", "b"])


def _chunks(members: DataFrame, *carried: str) -> DataFrame:
    """Rows (key, size, held: structs of id and what is carried) of about CHUNK members of one key, so that a join on the key moves and makes a row for each
    chunk, not for each member."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / CHUNK))
    return members.groupBy("key", "size", part.alias("part")).agg(F.collect_list(F.struct("id", *carried)).alias("held")).drop("part")


def _with_counts(members: DataFrame) -> DataFrame:
    """``members`` of the keys that hold a query, with their number (size) and that of their queries."""
    counts = members.groupBy("key").agg(F.count("*").alias("size"), F.count_if("query").alias("queries")).where("queries > 0")
    return _chunks(members, "component", "query").drop("size").join(counts, "key").select("key", "size", "queries", F.inline("held"))


def links(docs: DataFrame, nodes: DataFrame, scratch: Scratch, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """Verified links (a, b, similarity) between nodes that span every class, and the components of the linked nodes (None without links)."""
    entries = nodes.where("n > 0").select("id", F.explode("keys").alias("key"))
    # written, so that the join has an exchange of its own, which Spark can split at a hot key
    sizes = scratch.write(entries.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("a"), F.max("id").alias("b")).where("size > 1"), "sizes")
    members = scratch.write(entries.join(sizes.where("size > 2").select("key", "size"), "key"), "members")
    few = members.where(F.col("size") <= ALL_PAIRS)
    pairs = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
    pairs = pairs.unionByName(sizes.where("size = 2").select("a", "b"))
    central = members.groupBy("id").agg(F.sum(F.log("size")).alias("central"))
    big = scratch.write(members.where(F.col("size") > ALL_PAIRS).join(central, "id"), "big")
    hubs = scratch.write(big.groupBy("key").agg(F.max(F.struct("central", "id")).alias("hub")).select("key", F.col("hub.id").alias("hub")), "hubs")
    # the members with their key's hub, joined once for both uses
    big = scratch.write(_chunks(big).join(hubs, "key"), "met").select("key", "hub", "size", F.inline("held"))
    to_hub = big.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    pairs = scratch.write(_plausible(pairs.unionByName(to_hub).distinct(), nodes, least), "pairs")
    scratch.drop("sizes", "members", "big")
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(big.select("id")).distinct()
    bodies = scratch.write(_bodies(docs, nodes.select("id", "first", "raw").join(asked, "id", "left_semi"), key, text), "bodies")
    found = scratch.write(_verified(pairs, bodies, least), "links")
    scratch.drop("pairs")
    labels = None if found.isEmpty() else components(found, scratch)
    if hubs.isEmpty():
        return found, labels
    if labels is not None:
        big = big.join(labels, "id", "left").join(labels.select(F.col("id").alias("hub"), F.col("component").alias("of_hub")), "hub", "left")
    else:
        big = big.withColumns({c: F.lit(None).cast("long") for c in ("component", "of_hub")})
    placed = big.select("key", "size", "id", F.coalesce("component", "id").alias("component"), F.coalesce("of_hub", "hub").alias("of_hub"))
    placed = scratch.write(placed.select("key", "size", "id", "component", (F.col("component") != F.col("of_hub")).alias("query")), "placed")
    near = scratch.write(_plausible_members(_with_counts(placed), nodes, least), "near")
    if near.isEmpty():
        return found, labels
    more = scratch.write(_tile_links(_with_counts(placed.join(near, ["key", "id"], "left_semi")), bodies, least), "more")
    if more.isEmpty():
        return found, labels
    found = found.unionByName(more)
    return found, components(found, scratch)


def _classes(docs: DataFrame, scratch: Scratch, least: float, key: str, text: str) -> DataFrame:
    """Per row: key, raw, component (null for a null text), class_id, n_texts, n_copies."""
    small_batches(docs.sparkSession)
    rows = scratch.write(nodes(docs, key, text), "rows")
    first = F.min(F.struct(F.col(key).isNull(), F.col(key).alias("first"), "raw")).alias("least")
    known = rows.where("node is not null").groupBy("node").agg(first, F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    known = scratch.write(known.select(F.monotonically_increasing_id().alias("id"), "node", "least.first", "least.raw", "n_copies", "n", "keys"), "nodes")
    _, labels = links(docs, known, scratch, least, key, text)
    named = known.select("id", "node", "first", "n_copies")
    if labels is None:
        named = named.select("node", F.col("id").alias("component"), F.col("first").alias("class_id"), F.lit(1).cast("long").alias("n_texts"), "n_copies")
    else:
        placed = named.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        heads = placed.groupBy("component").agg(F.min("first").alias("class_id"), F.count("*").alias("n_texts"))
        named = placed.join(heads, "component").select("node", "component", "class_id", "n_texts", "n_copies")
    out = rows.select(key, "raw", "node").join(named, "node", "left")
    out = out.select(key, "raw", "component", F.coalesce("class_id", key).alias("class_id"), F.coalesce("n_texts", F.lit(1)).cast("long").alias("n_texts"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
    return scratch.write(out, "classes")


def classes(docs: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, class_id, n_texts (different texts of the class), n_copies (rows with its text)."""
    scratch = Scratch(docs.sparkSession)
    out = _classes(docs, scratch, least, key, text)
    scratch.close("classes")
    return out.select(key, "class_id", "n_texts", "n_copies")


def keep_first(docs: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class (the least id, and of its texts in the class the one of least hash), all columns as they
    are, whatever their names. Rows with a null text stay; of rows with one id and one text, or with one text and no id, one stays; other rows
    without an id stay. Rows with one id and other texts go by the class of each text."""
    scratch = Scratch(docs.sparkSession)
    found = _classes(docs, scratch, least, key, text).where(F.col(key).isNotNull()).select(F.col(key).alias("gone_id"), "raw", "component")
    placed = found.where("component is not null")
    heads = placed.groupBy("component").agg(F.min(F.struct("gone_id", "raw")).alias("head"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    heads = scratch.write(heads, "heads")  # so that the join has an exchange of its own, which Spark can split at a large class
    gone = placed.join(heads, "component").where((F.col("gone_id") != F.col("head.gone_id")) | (F.col("raw") != F.col("head.raw"))).select("gone_id", "raw").distinct()
    gone = scratch.write(gone, "gone")
    again = scratch.write(found.groupBy(F.col("gone_id").alias(key)).agg(F.count("*").alias("rows")).where("rows > 1").select(key), "again")
    scratch.close("gone", "again")
    # What goes grows with the corpus, so the join is never one that broadcasts it. Names are bound to their side: any may clash.
    named, d_key = docs.where(docs[key].isNotNull()).alias("d"), F.col(f"d.`{key}`")
    on = (d_key == F.col("g.gone_id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("g.raw"))
    kept = named.join(gone.hint("merge").alias("g"), on, "left_anti").select("d.*")
    if not again.isEmpty():
        once = kept.join(again, key, "left_semi").select(docs.columns).dropDuplicates([key, text])
        kept = kept.join(again, key, "left_anti").select(docs.columns).unionByName(once)
    no_id = docs.where(docs[key].isNull())
    return kept.unionByName(no_id.where(docs[text].isNull())).unionByName(no_id.where(docs[text].isNotNull()).dropDuplicates([text]))
