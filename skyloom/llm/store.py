"""Token-id output (operator 6): a content-addressed store of id streams.

Each text is encoded, an end id is added, and a rolling hash over eight ids cuts the stream where the hash has a
given pattern, so that equal passages give equal chunks wherever they stand. The store holds each distinct chunk
once, under its digest; a recipe per document lists its chunks in order; recipes are written in ascending key
order, with running offsets; the manifest holds the Merkle root of each recipe file and of the whole.

    chunks/    digest, n, ids (little-endian, 2 bytes an id if the vocabulary allows it, else 4)
    recipes/   part, row, key, n_tokens, local_start, digests, sizes, root
    manifest/  part, base, n_docs, n_tokens, root, total_root

Only digests are shuffled for the recipes; chunk payloads are shuffled once, after each task has dropped the
chunks that it has seen already, so a chunk that very many documents share does not gather in one task. The table that
one encoding pass leaves for both goes when they are written.

A reader first recomputes the manifest from the recipes and compares every file's root, its numbers of documents and
tokens, and the total root, so a recipe file that is lost, doubled or changed is found; then it checks every chunk
against its name and every document against its recipe.

Encoding. The tokenizer first splits a text by a pattern, then encodes each piece by itself, so equal pieces have
equal ids. Where a text has no two white-space characters in a row, cutting it before each space only cuts between
pieces; the ids of these parts are kept in a bounded cache per worker. Other texts, and texts with the string of a
special token, go to the library whole.

Defined cases: null text is empty (only the end id); rows with equal or null keys are documents of their own, null
keys first, equal keys by row; extra columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, kept_in_worker, remove, small_batches, texts

CACHE_ENTRIES = 1_500_000
#: Words that the library gets in one string; long strings cost it more a word.
SLICE = 256
WINDOW = 8
#: A cut follows a position whose hash has these bits zero (one in 512), between the least and greatest length.
CUT_BITS = 9
LEAST, GREATEST = 64, 8192
#: Distinct digests a task remembers so as to hand each chunk over once; beyond it, repeats are dropped later.
SEEN_ENTRIES = 1_000_000
#: Ids that one leaf of a recipe file's Merkle tree covers.
SECTION = 1_000_000
DOUBLE_SPACE = re.compile(r"\s\s")


class Encoder:
    """Ids of texts as little-endian bytes, with a bounded cache of parts."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # it sees each part once, so its own cache only costs time
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts_allowed = self._splits_at_spaces()
        self.cache: dict[str, bytes] = {}
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = len(piece)  # a byte-level piece has one character for each byte

    def _splits_at_spaces(self) -> bool:
        """Whether this tokenizer begins a new piece at every lone space, as byte-level ones do."""
        probe = self.tokenizer.pre_tokenizer.pre_tokenize_str("ab cd, 12 .x") if self.tokenizer.pre_tokenizer else []
        return self.tokenizer.normalizer is None and [p for p, _ in probe] == ["ab", "Ġcd", ",", "Ġ12", "Ġ.", "x"]

    def _library(self, strings: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _library_joined(self, parts: list[str]) -> list[bytes]:
        """As _library, for parts with a space before each, none of which ends with one: a call for each SLICE of them, taken apart
        by byte lengths."""
        if not parts:
            return []
        strings = [" " + " ".join(parts[i : i + SLICE]) for i in range(0, len(parts), SLICE)]
        ids = np.concatenate([np.asarray(self.tokenizer.encode_batch_fast([s], add_special_tokens=False)[0].ids, self.kind) for s in strings])
        sizes = np.array([len(p.encode()) for p in parts])
        stops = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(sizes + 1)) + 1
        stream, stops = ids.tobytes(), (stops * self.width).tolist()
        return [stream[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, rows: list[str]) -> list[bytes]:
        get = self.cache.get  # of a part without its space
        cut: list[tuple[list[str], list[bytes | None], list[int]] | None] = []
        whole: list[str] = []
        missing: set[str] = set()
        for text in rows:
            if not text or not self.parts_allowed or DOUBLE_SPACE.search(text) or any(s in text for s in self.special):
                whole.append(text)
                cut.append(None)
                continue
            first, *words = text.split(" ")
            if not words:
                whole.append(text)
                cut.append(None)
                continue
            whole.append(first)  # it has no space before it
            found = list(map(get, words))
            holes = _holes(found)
            missing.update([words[k] for k in holes])
            cut.append((words, found, holes))
        fresh: dict[str, bytes] = {}
        if missing:
            rest = [w for w in missing if not w or w[-1].isspace()]
            led = list(missing.difference(rest))
            fresh.update(zip(led, self._library_joined(led), strict=True))
            fresh.update(zip(rest, self._library([" " + w for w in rest]), strict=True))
        out = []
        for ids, parts in zip(self._library(whole), cut, strict=True):
            if parts:
                words, found, holes = parts
                for k in holes:
                    found[k] = fresh[words[k]]
                ids += b"".join(found)
            out.append(ids)
        if len(self.cache) < CACHE_ENTRIES:
            self.cache.update(fresh)
        return out


def _holes(found: list[bytes | None]) -> list[int]:
    """Places of None in a list, found at the speed of a list search."""
    places, at = [], -1
    try:
        while True:
            at = found.index(None, at + 1)
            places.append(at)
    except ValueError:
        return places


def encoder(file: str) -> Encoder:
    return kept_in_worker(("store", file), lambda: Encoder(file))


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    """One 64-bit number for each id below 65536, by a mixing rule; larger ids are folded."""
    with np.errstate(over="ignore"):
        x = (np.arange(65536, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream; they depend on nothing but the stream."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    g = _gear()[ids & 0xFFFF]
    with np.errstate(over="ignore"):
        h, k = g, 1  # sums of g << 7 * age over windows of 1, 2, 4 and 8 ids
        while k < WINDOW:
            wider = h.copy()
            wider[k:] += h[:-k] << np.uint64(7 * k)
            h, k = wider, 2 * k
    marks = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1
    ends, at = [], 0
    for m in marks.tolist():
        while m - at > GREATEST:
            at += GREATEST
            ends.append(at)
        if m - at >= LEAST:
            ends.append(m)
            at = m
    while n - at > GREATEST:
        at += GREATEST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaf digests; an odd leaf at the end of a level moves up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def write_store(docs: DataFrame, root: str, file: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write the store below ``root``, a path that all executors share."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()

    def make():
        coder = encoder(file)
        end = np.asarray([end_id], coder.kind).tobytes()
        seen: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "digests", "sizes", "payloads", "root")}
            for body in coder.encode(texts(batch)):
                stream = body + end
                ids = np.frombuffer(stream, coder.kind)
                names, sizes, payloads, at = [], [], [], 0
                for stop in cuts(ids):
                    chunk = stream[at * coder.width : stop * coder.width]
                    name = digest(chunk)
                    names.append(name)
                    sizes.append(stop - at)
                    payloads.append(None if name in seen else chunk)
                    if len(seen) < SEEN_ENTRIES:
                        seen.add(name)
                    at = stop
                out["n_tokens"].append(len(ids))
                out["digests"].append(names)
                out["sizes"].append(sizes)
                out["payloads"].append(payloads)
                out["root"].append(merkle(names))
            return pa.RecordBatch.from_pydict(
                {
                    "row": batch.column("row"),
                    key: batch.column(key),
                    "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                    "digests": pa.array(out["digests"], pa.list_(pa.binary())),
                    "sizes": pa.array(out["sizes"], pa.list_(pa.int32())),
                    "payloads": pa.array(out["payloads"], pa.list_(pa.binary())),
                    "root": pa.array(out["root"], pa.binary()),
                }
            )

        return step

    rows = docs.select(F.monotonically_increasing_id().alias("row"), key, docs[text].alias("text"))
    staged = arrow_map(rows, make, f"row long, {key} {kind}, n_tokens long, digests array<binary>, sizes array<int>, payloads array<binary>, root binary")
    staged.write.option("compression", "zstd").parquet(f"{root}/staged")
    staged = spark.read.schema(staged.schema).parquet(f"{root}/staged")

    chunk = staged.select(F.explode(F.arrays_zip("digests", "sizes", "payloads")).alias("c")).where("c.payloads is not null")
    chunk = chunk.select(F.col("c.digests").alias("digest"), F.col("c.sizes").alias("n"), F.col("c.payloads").alias("ids"))
    # dealt first: tasks have dropped their own repeats, so a sort before the exchange would find none
    chunk.repartition("digest").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{root}/chunks")

    def offsets():
        state = {"at": 0}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = np.asarray(batch.column("n_tokens"))
            starts = state["at"] + np.cumsum(sizes) - sizes
            state["at"] += int(sizes.sum())
            return pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | {"local_start": pa.array(starts, pa.int64())})

        return step

    recipes = staged.select("row", key, "n_tokens", "digests", "sizes", "root")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = recipes.repartitionByRange(parts, F.col(key).asc_nulls_first(), "row").sortWithinPartitions(F.col(key).asc_nulls_first(), "row")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    placed = arrow_map(ordered, offsets, f"row long, {key} {kind}, n_tokens long, digests array<binary>, sizes array<int>, root binary, part int, local_start long")
    placed.write.option("compression", "zstd").parquet(f"{root}/recipes")
    remove(spark, f"{root}/staged")
    files = _recipe_files(spark, root)
    total = merkle([f[4] for f in files])
    spark.createDataFrame([(*f, total) for f in files], "part int, base long, n_docs long, n_tokens long, root binary, total_root binary").coalesce(1).write.parquet(f"{root}/manifest")


def _recipe_files(spark: SparkSession, root: str) -> list[tuple[int, int, int, int, bytes]]:
    """(part, base, n_docs, n_tokens, root) of each recipe file, from the recipes: base is the offset of its first id. The list
    has one short row for each file."""
    recipes = spark.read.parquet(f"{root}/recipes")
    # Sections of a million ids are the leaves of a file's tree, so no task gathers a whole file.
    ordered = recipes.select("part", "local_start", "n_tokens", "root", F.floor(F.col("local_start") / SECTION).alias("section"))
    leaves = ordered.groupBy("part", "section").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("local_start", "n_tokens", "root"))).alias("roots"))
    leaves = leaves.select("part", "section", "n_docs", "n_tokens", F.sha2(F.array_join(F.transform("roots", lambda r: F.hex(r["root"])), ""), 256).alias("leaf"))
    files = leaves.groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("section", "leaf"))).alias("leaves"))

    def roots():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [merkle([bytes.fromhex(x["leaf"]) for x in leaves]) for leaves in batch.column("leaves").to_pylist()]
            return pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("part", "n_docs", "n_tokens")} | {"root": pa.array(made, pa.binary())})

        return step

    out, base = [], 0
    for r in sorted(arrow_map(files, roots, "part int, n_docs long, n_tokens long, root binary").toLocalIterator(), key=lambda r: r["part"]):
        out.append((r["part"], base, r["n_docs"], r["n_tokens"], bytes(r["root"])))
        base += r["n_tokens"]
    return out


def verified_manifest(spark: SparkSession, root: str) -> DataFrame:
    """part and base of each recipe file; raises if the manifest differs from what the recipes give."""
    stored = spark.read.parquet(f"{root}/manifest")
    listed = sorted((r["part"], r["base"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in stored.toLocalIterator())
    found = _recipe_files(spark, root)
    if listed != found:
        wrong = sorted({r[0] for r in set(listed) ^ set(found)})
        raise ValueError(f"recipe files {wrong[:10]} differ from the manifest")
    if any(bytes(r["total_root"]) != merkle([f[4] for f in found]) for r in stored.select("total_root").distinct().toLocalIterator()):
        raise ValueError("the manifest has another total root")
    return stored.select("part", "base")


@lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """tables[k][b][v]: what byte b of a CRC-32 with value v becomes when 2**k zero bytes follow."""
    # the register's linear step for one zero byte, on each of the 32 basis bits
    basis = np.array([1 << i for i in range(32)], np.uint32)
    table = np.zeros(256, np.uint32)
    for v in range(256):
        c = v
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table[v] = c
    images = (basis >> np.uint32(8)) ^ table[basis & np.uint32(255)]
    out = np.zeros((48, 4, 256), np.uint32)
    for k in range(48):
        for b in range(4):
            for bit in range(8):
                has = (np.arange(256) >> bit) & 1 == 1
                out[k, b][has] ^= images[8 * b + bit]
        images = _apply(out[k], images)
    return out


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & np.uint32(255)] ^ table[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ table[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)]


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The part of a stream's CRC-32 that a piece gives which ``after`` bytes follow: crc32(a + b) = shifted(a, len(b)) ^ crc32(b)."""
    tables, out = _shift_tables(), crc.astype(np.uint32)
    for k in range(int(after.max()).bit_length() if len(after) else 0):
        has = (after >> k) & 1 == 1
        out[has] = _apply(tables[k], out[has])
    return out


def read_documents(spark: SparkSession, root: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 of each document, from the files: the manifest, every chunk's digest, every recipe's
    root and every length are checked, and a difference raises. ids_crc32 is over 4-byte little-endian ids. CRCs of
    chunks are joined by their linearity, so no id stream is shuffled or gathered."""
    kind = spark.read.parquet(f"{root}/recipes").schema[key].dataType.simpleString()

    def check_chunks():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            crcs = []
            for name, n, ids in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "ids")), strict=True):
                if digest(ids) != name:
                    raise ValueError(f"chunk {name.hex()} has other content than its name says")
                crcs.append(zlib.crc32(np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()))
            return pa.RecordBatch.from_pydict({"digest": batch.column("digest"), "crc": pa.array(crcs, pa.int64()), "stored": pa.array(batch.column("n"), pa.int32())})

        return step

    def check_recipes():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, names, after, sizes = [], [], [], []
            for row, digests, ns, root_ in zip(*(batch.column(c).to_pylist() for c in ("row", "digests", "sizes", "root")), strict=True):
                if merkle(digests) != root_:
                    raise ValueError(f"the recipe of row {row} has another root")
                left = sum(ns)
                for name, n in zip(digests, ns, strict=True):
                    left -= n
                    rows.append(row)
                    names.append(name)
                    after.append(4 * left)
                    sizes.append(n)
            return pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "digest": pa.array(names, pa.binary()), "after": pa.array(after, pa.int64()), "n": pa.array(sizes, pa.int32())})

        return step

    def shift():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            crc = shifted_crc(np.asarray(batch.column("crc")).astype(np.uint32), np.asarray(batch.column("after")))
            return pa.RecordBatch.from_pydict({"row": batch.column("row"), "part_crc": pa.array(crc.astype(np.int64), pa.int64()), "n": batch.column("n")})

        return step

    chunks = arrow_map(spark.read.parquet(f"{root}/chunks"), check_chunks, "digest binary, crc long, stored int")
    recipes = spark.read.parquet(f"{root}/recipes")
    refs = arrow_map(recipes.select("row", "digests", "sizes", "root"), check_recipes, "row long, digest binary, after long, n int")
    joined = refs.join(chunks, "digest", "left").withColumn("crc", F.when(F.col("stored") == F.col("n"), F.col("crc")).otherwise(F.raise_error(F.lit("a recipe names a chunk that the store lacks"))))
    whole = arrow_map(joined.select("row", "after", "n", "crc"), shift, "row long, part_crc long, n int").groupBy("row").agg(F.bit_xor("part_crc").alias("ids_crc32"), F.sum("n").alias("got"))
    manifest = verified_manifest(spark, root)  # one row per recipe file
    out = recipes.select("row", key, "n_tokens", "local_start", "part").join(F.broadcast(manifest), "part").join(whole, "row", "left")
    return out.select(
        F.col(key).cast(kind).alias(key),
        (F.col("base") + F.col("local_start")).alias("start"),
        F.when(F.col("got") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document is not whole"))).alias("n_tokens"),
        "ids_crc32",
    )


def read_ids(spark: SparkSession, root: str, key: str = "doc_id") -> DataFrame:
    """key, start and ids (array) of each document, rebuilt from its recipe."""
    recipes = spark.read.parquet(f"{root}/recipes")
    refs = recipes.select("row", F.posexplode("digests").alias("k", "digest"))
    rows = refs.join(spark.read.parquet(f"{root}/chunks"), "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "n", "ids"))).alias("parts"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.concatenate([np.frombuffer(p["ids"], f"<u{len(p['ids']) // p['n']}") for p in parts]).astype(np.int32) for parts in batch.column("parts").to_pylist()]
            return pa.RecordBatch.from_pydict({"row": batch.column("row"), "ids": pa.array(ids, pa.list_(pa.int32()))})

        return step

    manifest = verified_manifest(spark, root)
    out = recipes.select("row", key, "part", "local_start").join(F.broadcast(manifest), "part")
    return out.join(arrow_map(rows, make, "row long, ids array<int>"), "row").select(key, (F.col("base") + F.col("local_start")).alias("start"), "ids")
