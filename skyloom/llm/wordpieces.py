"""Word-level byte-pair encoding and decoding (operator 11) over a trie of words.

A prefix of a word has one encoding, and it grows by one token at its end:

    encode(w[:i]) = encode(w[:i - |t|]) + [t]   for the one token t that ends at i and that the last token of
                                                encode(w[:i - |t|]) does not merge with

so the state of a prefix is its last token alone, and a prefix that many words share has one state. Words are put into a
trie, in sorted order, which walks it depth first; a node's state is computed when the node is made, from the states on the path to
it, and stays for all words below it and for all later batches of the worker. The last symbol of a word carries the end-of-word suffix, so it
is a leaf of its own. The ids of a word are read back along its path, from token to token.

Whether two tokens stay apart is the outcome of the merge rules on the two alone, kept in a table.

A text is cut where the library cuts it: at the strings of special tokens, then by the library's own normalizer and
pre-tokenizer. Both leave white space out and look at no character beyond a space, so parts between spaces or line ends are taken
apart once and kept in a bounded cache.

Defined cases: a null text is empty and has no ids; repeated rows and equal keys are rows of their own; a long word is no
path of the trie below ``DEEPEST`` symbols but is encoded by the same recurrence, in linear time; extra columns are ignored; an empty table gives
an empty table. Null ids decode to an empty text; ids outside the vocabulary have no string and are left out, as the library does.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts

#: Bounds of a worker's memory. A full cache takes no more; a full trie or table begins anew. They change speed only.
CACHE_ENTRIES = 500_000
CACHED_LENGTH = 64
TRIE_NODES = 1_000_000
KNOWN_PAIRS = 2_000_000
#: Symbols of a word that become nodes.
DEEPEST = 48
#: Code points of a text that are under way together.
SECTION = 1 << 20
NO_TOKEN = -1


class WordEncoder:
    """Ids of texts for a vocabulary of byte pairs with an end-of-word suffix."""

    def __init__(self, file: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        model = json.loads(self.library.to_str())["model"]
        self.suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.suffix or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("a vocabulary of byte pairs with an end-of-word suffix is needed")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.rank = {(a, b): k for k, (a, b) in enumerate(model["merges"])}
        self.tokens = {i: t for t, i in self.vocabulary.items()}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        if any(c.isspace() for s in self.special for c in s):
            raise ValueError("special tokens with white space are not supported")
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.length = {i: len(self.symbols(t)) for i, t in self.tokens.items()}
        self.endings: dict = {}  # tokens from their last symbol back; an id stands under the empty string
        for token, i in self.vocabulary.items():
            node = self.endings
            for symbol in reversed(self.symbols(token)):
                node = node.setdefault(symbol, {})
            node[""] = i
        self.apart: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {"": b""}
        self._new_trie()

    def _new_trie(self) -> None:
        self.children: dict[int, int] = {}  # node << 16 | character, to node
        self.state: list[int] = [NO_TOKEN]

    def symbols(self, token: str) -> list[str]:
        """The symbols that a token is made of; the suffix belongs to the last of them."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge rules applied to few symbols, the best pair first."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, k = min((self.rank.get(pair, len(self.rank)), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.rank):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _stay(self, before: int, token: int) -> bool:
        """Whether a token stands after another one (or at the beginning of a word) as it is."""
        pair = (before + 1) << 32 | token
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) >= KNOWN_PAIRS:
                self.apart.clear()
            first = [] if before == NO_TOKEN else [self.tokens[before]]
            parts = [*first, self.tokens[token]]
            known = self.apart[pair] = self.merged([s for p in parts for s in self.symbols(p)]) == parts
        return known

    def _last(self, body: str, depth: int, symbol: str, path: list[int]) -> int:
        """The last token of the encoding of body[:depth] and one more symbol; path[k] is the last token of body[:k]."""
        node, ends = self.endings.get(symbol), []
        while node is not None:
            if "" in node:
                ends.append((depth, node[""]))
            if not depth:
                break
            depth -= 1
            node = node.get(body[depth])
        for start, token in reversed(ends):
            if self._stay(path[start], token):
                return token
        raise ValueError(f"the vocabulary has no symbol {symbol!r}")

    def words(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of each word. Sorted, so that the trie is walked depth first and a path is left only for the next branch."""
        out: dict[str, list[int]] = {}
        children, state, length = self.children, self.state, self.length
        nodes, path, last = [0], [NO_TOKEN], ""
        for word in sorted(words):
            body = word[:-1]
            same, most = 0, min(len(last), len(body))
            while same < most and last[same] == body[same]:
                same += 1
            del nodes[same + 1 :], path[same + 1 :]
            for depth in range(same, min(len(body), DEEPEST)):
                edge = nodes[depth] << 16 | ord(body[depth])
                child = children.get(edge)
                if child is None:
                    child = children[edge] = len(state)
                    state.append(self._last(body, depth, body[depth], path))
                nodes.append(child)
                path.append(state[child])
            for depth in range(len(path) - 1, len(body)):
                path.append(self._last(body, depth, body[depth], path))
            ids, at = [self._last(body, len(body), word[-1] + self.suffix, path)], len(word)
            while (at := at - length[ids[-1]]) > 0:
                ids.append(path[at])
            out[word] = ids[::-1]
            last = body
        if len(state) > TRIE_NODES:
            self._new_trie()
        return out

    def pieces(self, part: str) -> list[str]:
        """The words of a part of a text, in the library's spelling of bytes."""
        if part.isascii():
            part = part.lower()
            if part.isalpha():
                return [part]
        else:
            part = self.library.normalizer.normalize_str(part)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        cut = {p: self.pieces(p) for p in parts}
        ids = self.words({w for words in cut.values() for w in words})
        joined = {w: np.array(i, np.int32).tobytes() for w, i in ids.items()}
        return {p: b"".join([joined[w] for w in words]) for p, words in cut.items()}

    def _keep(self, found: dict[str, bytes]) -> None:
        room = CACHE_ENTRIES - len(self.cache)
        if room > 0:
            self.cache.update([(p, i) for p, i in found.items() if len(p) <= CACHED_LENGTH][:room])

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids of each text, as 32-bit integers."""
        out: list[bytes] = []
        held: list[tuple[list[list[bytes | None]], list[tuple[list, int, str]]]] = []
        size = 0
        for text in rows:
            found, holes = [], []
            for segment in sections(text):
                for part in self.special_split.split(segment) if self.special else [segment]:
                    if part in self.special:
                        found.append([np.int32(self.special[part]).tobytes()])
                        continue
                    parts = part.replace("\n", " ").split(" ")
                    ids = list(map(self.cache.get, parts))
                    found.append(ids)
                    if None in ids:
                        holes += [(ids, k, parts[k]) for k, i in enumerate(ids) if i is None]
            held.append((found, holes))
            size += len(text)
            if size > SECTION:
                out += self._filled(held)
                held, size = [], 0
        return out + self._filled(held)

    def _filled(self, held: list) -> list[bytes]:
        """Ids of texts whose unknown parts are still open: those of all the texts go through the trie at once, so that their words
        share their prefixes."""
        fresh = self._learn({part for _, holes in held for _, _, part in holes})
        for _, holes in held:
            for ids, k, part in holes:
                ids[k] = fresh[part]
        self._keep(fresh)
        return [b"".join([b"".join(ids) for ids in found]) for found, _ in held]


def sections(text: str, most: int = SECTION):
    """A text in sections that end before a space."""
    start = 0
    while len(text) - start > most:
        stop = text.find(" ", start + most)
        if stop < 0:
            break
        yield text[start:stop]
        start = stop
    yield text[start:]


@lru_cache(maxsize=2)
def encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


def encode(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and ids, the array of its token ids."""

    def make():
        coder = encoder(file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = coder.encode(texts(batch))
            ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))
            return pa.RecordBatch.from_pydict({key: batch.column(key), "ids": ids})

        return step

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, docs[text].alias("text")), make, f"{key} {kind}, ids array<int>")


def decode(encoded: DataFrame, file: str, key: str = "doc_id") -> DataFrame:
    """Per row: key, ids, and decoded, the text of its ids. The library joins the strings of the tokens by spaces where a vocabulary
    has no decoder of its own; one that has is asked itself."""

    def make():
        coder = encoder(file)
        known = coder.tokens | {i: t for t, i in coder.special.items()}
        table = np.array([known.get(i) for i in range(max(known) + 1)], object)
        asked = coder.library.decoder is not None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("ids")
            flat = np.asarray(ids.flatten().fill_null(-1))
            fit = (flat >= 0) & (flat < len(table))
            strings = np.where(fit, table[np.where(fit, flat, 0)], None).tolist()
            ends = np.cumsum([0] + (ids.value_lengths().fill_null(0)).to_pylist()).tolist()
            if asked:
                made = [coder.library.decode([int(i) for i in flat[a:b] if i >= 0], skip_special_tokens=False) for a, b in zip(ends, ends[1:], strict=False)]
            else:
                gaps = None in strings
                made = [" ".join([s for s in strings[a:b] if s is not None] if gaps else strings[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            return pa.RecordBatch.from_pydict({key: batch.column(key), "ids": ids, "decoded": pa.array(made, pa.string())})

        return step

    kind = encoded.schema[key].dataType.simpleString()
    return arrow_map(encoded.select(key, "ids"), make, f"{key} {kind}, ids array<int>, decoded string")


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, and the digests of its ids and of its decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
