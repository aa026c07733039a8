"""Token counts (operator 3): exact counts at every prefix of a text, by dynamic programming.

The table of a text holds count[k], the tokens of its first k code points, for every k. Inside a chunk it comes from the
appending recurrence

    count[i] = count[i - |t|] + 1   for the one piece t that ends at i and is stable after the last piece of i - |t|

and a byte-pair encoder never merges across a boundary that no vocabulary piece spans, so chunks follow each other by

    count(prefix that ends in chunk k) = count(text before chunk k) + count(prefix of chunk k)

For the sentencepiece vocabulary used here these boundaries are: before a run of word marks (spaces) and around a line
break; the vocabulary is checked for that when it is loaded, and a vocabulary without them is one chunk a text. The rows
of a chunk are kept in a bounded cache. A chunk whose last count is not the library's (none is known) gets all its counts from the
library.

``prefix_table`` stores the table as the steps count[k] - count[k - 1], one signed byte for each code point.
``answers`` and ``prefix_counts`` read stored tables: the total, whether it is above a limit, the longest prefix within a
budget, and the tokens of a truncated text, none of which encodes anything again. ``token_counts`` is both in a row.

Defined cases: null text counts as empty; empty text has 0 tokens and 0 bytes and an empty table; ties and repeated rows are
counted row by row; extra columns are ignored by ``token_counts``; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, texts

#: Entries of a worker's chunk cache; a full cache takes no more, which changes speed only.
CACHE_ENTRIES = 600_000
CACHED_LENGTH = 200
MARK = "▁"
CHUNKS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


class PrefixCounter:
    """Counts of one sentencepiece BPE vocabulary. Keeps a bounded cache of chunk counts."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = {p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))}
        self.longest = max(map(len, self.pieces))
        self.bytes = np.array([1 if self.model.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)])
        self.splits = not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        if self.longest > 100:
            raise ValueError("pieces of over 100 characters: a step may not fit a byte")
        self.cache: dict[str, bytes] = {}
        self.stable: dict[tuple[str, str], bool] = {}
        self.endings: dict = {}  # trie of the pieces from their last character; a piece stands under the empty string
        for piece in self.pieces:
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece

    def chunks(self, text: str) -> list[str]:
        """The parts of a text that no piece crosses, with spaces as word marks and the leading mark added."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return CHUNKS.findall(marked) if self.splits else [marked]

    def _encode(self, chunk: str) -> list[str]:
        if chunk == MARK:
            return [MARK]
        if chunk[0] == MARK:
            return self.model.encode(chunk[1:], out_type=str)
        return self.model.encode("\n" + chunk, out_type=str)[2:]

    def _sizes_joined(self, led: list[str]) -> list[int]:
        """Tokens of chunks that begin with the word mark and don't end with it: one call, taken apart by byte lengths."""
        if not led:
            return []
        ids = self.model.encode("".join(led)[1:])
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(c.encode()) for c in led])) + 1
        return np.diff(ends, prepend=0).tolist()

    def _sizes(self, chunks: list[str]) -> dict[str, int]:
        """The library's tokens of each chunk."""
        led = [c for c in chunks if c[0] == MARK and c != MARK and c[-1] != MARK]
        rest = [c for c in chunks if c[0] != MARK or c[-1] == MARK]
        return {c: len(self._encode(c)) for c in rest} | dict(zip(led, self._sizes_joined(led), strict=True))

    def _steps(self, chunk: str, tokens: int) -> bytes:
        counts = self.prefix_tokens(chunk)
        if counts[-1] != tokens:
            counts = [0] + [len(self._encode(chunk[:i])) for i in range(1, len(chunk) + 1)]
        return bytes([b - a & 255 for a, b in zip(counts, counts[1:], strict=False)])

    def table(self, text: str) -> np.ndarray:
        """count[k] - count[k - 1] for each code point of a text, as signed bytes."""
        chunks = self.chunks(text)
        if not chunks:
            return np.zeros(0, np.int8)
        found = list(map(self.cache.get, chunks))
        if None in found:
            fresh = list(dict.fromkeys(c for c, steps in zip(chunks, found, strict=True) if steps is None))
            sizes = self._sizes(fresh)
            new = {c: self._steps(c, sizes[c]) for c in fresh}
            found = [new[c] if steps is None else steps for c, steps in zip(chunks, found, strict=True)]
            if len(self.cache) < CACHE_ENTRIES:
                self.cache.update((c, steps) for c, steps in new.items() if len(c) <= CACHED_LENGTH)
        steps = np.frombuffer(b"".join(found), np.int8)
        out = steps[1:].copy()
        out[0] += steps[0]  # the added mark comes with the first code point
        return out

    def _follows(self, pair: tuple[str, str]) -> bool:
        if len(self.stable) > CACHE_ENTRIES:
            self.stable.clear()
        found = self.stable[pair] = self._encode(pair[0] + pair[1]) == list(pair)
        return found

    def prefix_tokens(self, chunk: str) -> list[int]:
        """Exact tokens of each prefix of a chunk, from 0 to its length."""
        count, last, stable = [0], [""], self.stable.get
        for i in range(1, len(chunk) + 1):
            node, k, ends, best = self.endings, i, [], None
            while k:
                node = node.get(chunk[k - 1])
                if node is None:
                    break
                k -= 1
                if "" in node:
                    ends.append((k, node[""]))
            while ends:  # the longest that is stable
                k, piece = ends.pop()
                before = last[k]
                if before:
                    fits = stable((before, piece))
                    if not fits and (fits is not None or not self._follows((before, piece))):
                        continue
                best = (k, piece)
                break
            if best is None:  # a character outside the vocabulary becomes its bytes, which merge with nothing
                count.append(count[-1] + len(chunk[i - 1].encode()))
                last.append("")
            else:
                count.append(count[best[0]] + 1)
                last.append(best[1])
        return count


def counts_of(steps: np.ndarray) -> np.ndarray:
    """count[k] for k from 0, of a stored table."""
    out = np.zeros(len(steps) + 1, np.int64)
    np.cumsum(steps, out=out[1:])
    return out


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """The most code points of a prefix with no more than ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


@lru_cache(maxsize=4)
def counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


def prefix_table(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes and ``steps``, the stored table of its text."""

    def make():
        count = counter(model_file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = texts(batch)
            tables = pa.array([count.table(t).tobytes() for t in rows], pa.binary())
            return pa.RecordBatch.from_pydict({key: batch.column(key), "n_bytes": pa.array([len(t.encode()) for t in rows], pa.int64()), "steps": tables})

        return step

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, docs[text].alias("text")), make, f"{key} {kind}, n_bytes long, steps binary")


def answers(tables: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Per stored table: key, n_bytes, n_tokens, over_limit, and fit_chars, the longest prefix within ``limit`` tokens."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [counts_of(np.frombuffer(b, np.int8)) for b in batch.column("steps").to_pylist()]
            tokens = [int(c[-1]) for c in counts]
            return pa.RecordBatch.from_pydict(
                {
                    key: batch.column(key),
                    "n_bytes": batch.column("n_bytes"),
                    "n_tokens": pa.array(tokens, pa.int64()),
                    "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
                    "fit_chars": pa.array([longest_prefix(c, limit) for c in counts], pa.int64()),
                }
            )

        return step

    kind = tables.schema[key].dataType.simpleString()
    return arrow_map(tables.select(key, "n_bytes", "steps"), make, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(tables: DataFrame, chars: int, key: str = "doc_id") -> DataFrame:
    """Per stored table: key and n_tokens of the text cut to ``chars`` code points."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [int(np.frombuffer(b, np.int8)[: max(0, chars)].sum(dtype=np.int64)) for b in batch.column("steps").to_pylist()]
            return pa.RecordBatch.from_pydict({key: batch.column(key), "n_tokens": pa.array(found, pa.int64())})

        return step

    kind = tables.schema[key].dataType.simpleString()
    return arrow_map(tables.select(key, "steps"), make, f"{key} {kind}, n_tokens long")


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit, and fit_chars, the longest prefix within ``limit`` tokens."""
    return answers(prefix_table(docs, model_file, key, text), limit, key)
