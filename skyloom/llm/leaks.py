"""Benchmark decontamination (operator 8): BM25 over test items with block-max WAND, then overlap checks.

Index. Test items are the indexed texts; a term's weight in an item is its BM25 weight divided by the sum of all weights
of the item, so every item scores 1 against a passage that has all its words. A posting list has an upper bound
and one per block of ``BLOCK`` postings.

Query. Each training text is cut into passages that overlap by half and are at least twice as long as the item, so
any copy of an item lies whole in a passage. A passage's length follows from the item's own (``passage_words``): items are
grouped by it, each group with its own index and passages. A passage is a query: block-max WAND gives every item with a score of
``threshold`` or more. Terms whose weights together stay below the threshold in every item are not enough for a hit, so
a passage is passed over unless its other terms can lift an item to it: the same items come, and on passages without
a leak WAND alone would take eight times as long (measured: 12.0 s against 1.5 s for 3,000 texts and 40 items).

Check. A retrieved item is a leak if the passage has, in order, ``overlap`` of the words of its question and of its answer
(longest common subsequence, bit-parallel). An item's question ends at its last question mark that has words behind
it, else at the middle of its words.

Items come to the workers in blocks of at most ``BLOCK_WORDS`` words, each its own pass, so no broadcast
grows with the benchmark. The number of items, their mean length and the document frequencies are those of all items, counted once;
a block gets the frequencies of its own terms. So whether a text and an item match depends on no border of blocks or groups. Memory in a worker is bounded by a block and a batch of texts.

Defined cases: null and empty texts and items have no words and no leaks; an item in many passages of a text gives one row,
the best by both overlaps, score and then place; repeated items are items of their own; rows with equal ids are
texts of their own, each with its own rows; extra columns are ignored by ``find_leaks`` and kept by ``without_leaks``; empty tables give no leaks.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, kept_in_worker, small_batches, texts, written

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.5, 0.8
BLOCK = 64
SET_ASIDE = 0.7
BLOCK_WORDS = 1_000_000
SHORTEST_PASSAGE = 128
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer."""
    at = text.rfind("?")
    while at >= 0 and not WORD.search(text, at):
        at = text.rfind("?", 0, at)
    if at >= 0 and WORD.search(text[:at]):
        return words(text[:at]), words(text[at:])
    own = words(text)
    return own[: (len(own) + 1) // 2], own[(len(own) + 1) // 2 :]


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one machine word operation per 64 words of ``a``."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := masks.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def overlap(part: list[str], passage: list[str]) -> float:
    return common_subsequence(part, passage) / len(part) if part else 1.0


class Postings:
    """One term's items, weights and bounds."""

    __slots__ = ("items", "weights", "block_tops", "top")

    def __init__(self, pairs: list[tuple[int, float]]):
        pairs.sort()
        self.items = [i for i, _ in pairs]
        self.weights = [w for _, w in pairs]
        self.block_tops = [max(self.weights[k : k + BLOCK]) for k in range(0, len(pairs), BLOCK)]
        self.top = max(self.weights)


def passage_words(length: int) -> int:
    """Words of a passage for an item: a power of two, twice the item's length or more and under four times it, but SHORTEST_PASSAGE at least."""
    return max(SHORTEST_PASSAGE, 2 << max(0, length - 1).bit_length())


#: Number of items, their mean length and the number of items of each term.
Counts = tuple[int, float, dict[str, int]]


class Index:
    """BM25 index of items. ``items``: (item_id, text). ``counts``: those of all items, if these are a part."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, counts: Counts | None = None):
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        self.parts = [parts(t) for _, t in items]
        bags = [Counter(words(t)) for _, t in items]
        lengths = [sum(b.values()) for b in bags]
        n, mean, spread = counts or (len(items), sum(lengths) / max(1, len(items)) or 1.0, Counter(t for b in bags for t in b))
        lists: dict[str, list[tuple[int, float]]] = {}
        bound = {}
        for i, bag in enumerate(bags):
            weight = {t: math.log(1 + (n - spread[t] + 0.5) / (spread[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * lengths[i] / mean)) for t, c in bag.items()}
            total = sum(weight.values())
            for t, w in weight.items():
                lists.setdefault(t, []).append((i, w / total))
        self.lists = {t: Postings(p) for t, p in lists.items()}
        self.passage = passage_words(max(lengths, default=0))
        # Frequent terms are set aside, the most frequent first, as long as they give no item more than this part of the threshold.
        aside: set[str] = set()
        for t in sorted(self.lists, key=lambda t: (-spread[t], t)):
            p = self.lists[t]
            if any(bound.get(i, 0.0) + w > SET_ASIDE * threshold for i, w in zip(p.items, p.weights, strict=True)):
                continue
            for i, w in zip(p.items, p.weights, strict=True):
                bound[i] = bound.get(i, 0.0) + w
            aside.add(t)
        self.needed = frozenset(self.lists) - aside
        self.aside = bound

    def within_reach(self, terms: set[str]) -> bool:
        """Whether an item can reach the threshold: its weights of the needed terms here, and of all that are set aside."""
        reach: dict[int, float] = {}
        for t in self.needed & terms:
            p = self.lists[t]
            for item, weight in zip(p.items, p.weights, strict=True):
                total = reach[item] = reach.get(item, self.aside.get(item, 0.0)) + weight
                if total >= self.threshold - 1e-9:
                    return True
        return False

    def retrieve(self, terms: set[str]) -> list[tuple[int, float]]:
        """Every item with a score of at least the threshold against these terms: block-max WAND."""
        least = self.threshold - 1e-9
        lists = [self.lists[t] for t in terms if t in self.lists]
        cursors = [[p.items[0], 0, p] for p in lists]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[2].top
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, skip = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
            for c in cursors[: pivot + 1]:
                p = c[2]
                at = bisect_left(p.items, item, c[1])
                if at < len(p.items):
                    bound += p.block_tops[at // BLOCK]
                    end = min(len(p.items), (at // BLOCK + 1) * BLOCK) - 1
                    skip = min(skip, p.items[end] + 1)
            if bound < least:
                target = max(skip, item + 1)
            else:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    p = c[2]
                    at = bisect_left(p.items, item, c[1])
                    if at < len(p.items) and p.items[at] == item:
                        score += p.weights[at]
                if score >= least:
                    found.append((item, score))
                target = item + 1
            alive = []
            for k, c in enumerate(cursors):
                if k <= pivot:
                    p = c[2]
                    at = bisect_left(p.items, target, c[1])
                    if at == len(p.items):
                        continue
                    c[0], c[1] = p.items[at], at
                alive.append(c)
            cursors = alive
        return found

    def leaks(self, text: str, least: float = OVERLAP) -> dict[int, tuple[float, float, float, int]]:
        """Item number: question overlap, answer overlap, score and first word of the best passage."""
        own = words(text)
        out: dict[int, tuple[float, float, float, int]] = {}
        step = self.passage // 2
        for at in range(0, max(1, len(own) - step), step):
            passage = own[at : at + self.passage]
            terms = set(passage)
            if not self.within_reach(terms):
                continue
            for item, score in self.retrieve(terms):
                question, answer = self.parts[item]
                q = overlap(question, passage)
                if q < least:
                    continue
                a = overlap(answer, passage)
                if a < least:
                    continue
                new = (q, a, round(score, 9), at)
                old = out.get(item)
                if old is None or (new[0] + new[1], new[2], -at) > (old[0] + old[1], old[2], -old[3]):
                    out[item] = new
        return out


class Indexes:
    """The indexes of a block, one for each length of passages."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, counts: Counts):
        groups: dict[int, list[tuple[int, str]]] = {}
        for item in items:
            groups.setdefault(passage_words(len(words(item[1]))), []).append(item)
        self.parts = [Index(group, threshold, counts) for _, group in sorted(groups.items())]

    def leaks(self, text: str, least: float = OVERLAP) -> list[tuple[int, float, float, float, int]]:
        """item_id, question overlap, answer overlap, score and first word of each leak."""
        return [(index.ids[i], *v) for index in self.parts for i, v in sorted(index.leaks(text, least).items())]

    def any(self, text: str, least: float) -> bool:
        return any(index.leaks(text, least) for index in self.parts)


def item_counts(items: DataFrame) -> tuple[int, float, DataFrame]:
    """Number of items with words, their mean length, and term, n (items that hold it) of all items."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            n = size = 0
            for text in texts(batch):
                if own := words(text):
                    found.update(set(own))
                    n, size = n + 1, size + len(own)
            yield pa.RecordBatch.from_pydict({"term": pa.array([None, *found], pa.string()), "n": pa.array([n, *found.values()], pa.int64()), "size": pa.array([size, *[0] * len(found)], pa.int64())})

    made = items.select("text").mapInArrow(terms, "term string, n long, size long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    made = written(made, "terms")
    whole = made.where("term is null").first()
    n, size = (whole["n"], whole["size"]) if whole else (0, 0)
    return n, size / n if n else 1.0, made.where("term is not null").select("term", "n")


def counted_blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int, str]], Counts]]:
    """The blocks of items, with the counts of all items for the terms of each block."""
    spark = items.sparkSession
    small_batches(spark)
    n, mean, spread = item_counts(items)
    for block in item_blocks(items):
        own = sorted({w for _, t in block for w in words(t)})
        asked = spark.createDataFrame(pa.table({"term": pa.array(own, pa.string())}))
        found = spread.join(asked, "term", "left_semi").toArrow()  # at most BLOCK_WORDS rows, or one item's
        yield block, (n, mean, dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist(), strict=True)))


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in ascending order, in blocks of at most BLOCK_WORDS words (or one item)."""
    block, size = [], 0
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(words(r["text"] or ""))
        if not n:
            continue
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def _indexes(named: tuple[str, list[tuple[int, str]], Counts], threshold: float) -> Indexes:
    name, items, counts = named
    return kept_in_worker(("leaks", name, threshold), lambda: Indexes(items, threshold, counts))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item_id, question_overlap, answer_overlap, score, first_word of each leak."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, item_id long, question_overlap double, answer_overlap double, score double, first_word long"
    out = spark.createDataFrame([], schema)
    for block in counted_blocks(items):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, *block))

        def make(shared=shared):
            index = _indexes(shared.value, threshold)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                rows = [(k, *v) for k, t in zip(batch.column(key).to_pylist(), texts(batch), strict=True) for v in index.leaks(t, least)]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (batch.column(key).type, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                names = (key, "item_id", "question_overlap", "answer_overlap", "score", "first_word")
                return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

            return step

        found = arrow_map(docs.select(key, docs[text].alias("text")), make, schema)
        out = out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no leak, all columns as they are."""
    for block in counted_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *block))

        def make(shared=shared):
            index = _indexes(shared.value, threshold)
            return lambda batch: batch.filter(pa.array([not index.any(t, least) for t in texts(batch, text)], pa.bool_()))

        docs = arrow_map(docs, make, docs.schema)
    return docs
