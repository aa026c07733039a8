"""Toxicity (operator 9): a learned lexicon, Levenshtein automata on its trie, and context windows.

Learning. From a bounded sample of labelled rows (``SAMPLE_ROWS``, by hash order, never more than that, however often
an id is repeated) all words and word beginnings whose share among toxic texts is surely higher than among clean ones become the lexicon, with the
lower bound of their log odds ratio as weight. A logistic model over a few features of a text's hits gives the score.

Matching. The lexicon is a trie. ``Automaton`` is its product with the Levenshtein automaton of distance one, made
deterministic state by state as words need it: a word costs one table look-up a character and most words leave the
automaton after three or four. A misspelled hit counts only for words of ``FUZZY_LENGTH`` letters and more (kept in the lexicon
beside their beginnings) whose neighbours are rare in clean texts of the sample: at most ``CLEAN_NEIGHBOURS`` times the share
of toxic texts that have the word; digits and signs that stand for letters count as these.

Context. A hit's weight grows with the other hits among the ``SPAN`` words around it, and falls if it stands inside
quotation marks or near a word of reporting (quotation, not abuse); both are features of their own.

Scores use the text only. Defined cases: null text counts as empty; texts without hits get the score of a clean text; with
no usable labels (none, or of one kind) every score is the share of toxic labels, 0 without any; rows with equal ids
are scored row by row; labels that are null are left out, and an id with two labels gives two training rows; extra
columns are ignored by ``score`` and kept by ``keep_clean``; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, kept_in_worker, small_batches, texts, written

SAMPLE_ROWS = 20_000
LEAST_TEXTS = 3
LEAST_WEIGHT = 1.6
PREFIXES = (4, 5, 6)
FUZZY_LENGTH = 5
FUZZY_DISCOUNT = 0.7
CLEAN_NEIGHBOURS = 0.02
SPAN = 5
#: Entries of a worker's word cache, and states of an automaton, before no more are added or it starts anew.
CACHE_ENTRIES = 600_000
STATES = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
SIGNS = str.maketrans("0134578@$!|", "oieastbasii")
OPEN, CLOSE = "\"“«„‘", "\"”»“’"
# Words that report or name another's words.
REPORTING = frozenset("said says say called calls quote quoted quotes wrote writes word words term phrase comment dit disait mot sagte sagt wort zitat dijo dice palabra".split())


def words_and_prefixes(text: str) -> set[str]:
    found = set(LETTERS.findall(text.lower()))
    return found | {w[:k] + "*" for w in found for k in PREFIXES if len(w) > k}


class Automaton:
    """Words within distance one of the lexicon's words, or that begin with one of its beginnings (``term*``)."""

    def __init__(self, lexicon: dict[str, float], fuzzy: frozenset[str] | None = None):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]
        self.begin: list[float] = [0.0]
        self.fuzzy: list[str] = [""]
        for term, weight in lexicon.items():
            at = 0
            for c in term.rstrip("*"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word.append(0.0)
                    self.begin.append(0.0)
                    self.fuzzy.append("")
                at = self.children[at][c]
            if term.endswith("*"):
                self.begin[at] = weight
            else:
                self.word[at] = weight
                if len(term) >= FUZZY_LENGTH and (fuzzy is None or term in fuzzy):
                    self.fuzzy[at] = term
        self._restart()

    def _restart(self) -> None:
        self.index: dict[tuple[frozenset, float], int] = {}
        self.sets: list[frozenset] = []
        self.best: list[float] = []
        self.moves: list[dict[str, int]] = []
        self._state(frozenset([(0, 0)]), 0.0)

    def _state(self, positions: frozenset, best: float) -> int:
        key = (positions, best)
        if key not in self.index:
            self.index[key] = len(self.sets)
            self.sets.append(positions)
            self.best.append(best)
            self.moves.append({})
        return self.index[key]

    def _move(self, state: int, c: str) -> int:
        out, best = set(), self.best[state]
        for node, edits in self.sets[state]:
            kids = self.children[node]
            if c in kids:
                out.add((kids[c], edits))
                if not edits:
                    best = max(best, self.begin[kids[c]])
            if not edits:
                out.add((node, 1))  # a letter too many
                for kid in kids.values():
                    out.add((kid, 1))  # another letter
                    if c in self.children[kid]:
                        out.add((self.children[kid][c], 1))  # a letter too few
        return self._state(frozenset(out), best)

    def match(self, word: str) -> tuple[float, str]:
        """Weight of a word, and the term that it misspells (empty for an exact hit)."""
        if len(self.sets) > STATES:
            self._restart()
        state = 0
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                to = self.moves[state][c] = self._move(state, c)
            state = to
            if not self.sets[state]:
                return self.best[state], ""
        weight, near, term = self.best[state], 0.0, ""
        for node, edits in self.sets[state]:
            if not edits:
                weight = max(weight, self.word[node])
                nodes = [node, *self.children[node].values()]
            else:
                nodes = [node]
            for n in nodes:
                if self.fuzzy[n] and self.word[n] > near:
                    near, term = self.word[n], self.fuzzy[n]
        return (weight, "") if weight >= near * FUZZY_DISCOUNT else (near * FUZZY_DISCOUNT, term)


class Scanner:
    """Hits of texts, with a cache of tokens."""

    def __init__(self, lexicon: dict[str, float], fuzzy: frozenset[str] | None = None):
        self.automaton = Automaton(lexicon, fuzzy)
        self.cache: dict[str, tuple[float, str] | None] = {}

    def token(self, token: str) -> tuple[float, str] | None:
        low = token.lower()
        parts = set(LETTERS.findall(low)) | set(LETTERS.findall(low.strip(".,;:!?\"'").translate(SIGNS)))
        hit = max((self.automaton.match(p) for p in parts), default=(0.0, ""))
        out = hit if hit[0] > 0 else None
        if len(self.cache) < CACHE_ENTRIES:
            self.cache[token] = out
        return out

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, float, str]]]:
        """The tokens of a text and (place, weight, misspelled term) of those that hit."""
        tokens, cache = text.split(), self.cache
        out = []
        for i, t in enumerate(tokens):
            if t in cache:
                hit = cache[t]
            else:
                hit = self.token(t)
            if hit:
                out.append((i, *hit))
        return tokens, out

    def features(self, text: str) -> list[float]:
        tokens, hits = self.hits(text)
        n = len(tokens)
        if not hits:
            return [0.0] * 7 + [math.log1p(n)]
        inside, quoted = False, set()
        if any(c in text for c in OPEN):
            for i, t in enumerate(tokens):
                if t[0] in OPEN:
                    inside = True
                if inside:
                    quoted.add(i)
                if inside and any(c in CLOSE for c in t[1:]):
                    inside = False
        direct, reported, peak = [], [], 0.0
        for k, (i, weight, _) in enumerate(hits):
            near = 0
            for step in (-1, 1):
                j = k + step
                while 0 <= j < len(hits) and abs(hits[j][0] - i) <= SPAN:
                    near, j = near + 1, j + step
            said = i in quoted or any(t.lower().strip(".,:;") in REPORTING for t in tokens[max(0, i - SPAN) : i + SPAN + 1])
            (reported if said else direct).append(weight)
            peak = max(peak, (0.5 if said else 1.0) * weight * (1 + near))
        strong = sum(w > 3 for w in direct)
        return [math.log1p(len(direct)), max(direct, default=0.0), sum(direct) / math.sqrt(n), len(direct) / n, math.log1p(strong), math.log1p(peak), sum(reported) / math.sqrt(n), math.log1p(n)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (constant first), means and spreads of a ridge logistic regression, by Newton steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / spread]
    w = np.zeros(a.shape[1])
    penalty = ridge * len(y) * np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w, mean, spread


def fold(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def _pruned(lexicon: dict[str, float]) -> dict[str, float]:
    """Without terms to which a beginning of theirs already gives nearly their weight; words that can be misspelled stay,
    since beginnings match exactly only."""
    out = {}
    for term in sorted(lexicon, key=lambda t: (len(t.rstrip("*")), t)):
        stem = term.rstrip("*")
        fuzzy = not term.endswith("*") and len(term) >= FUZZY_LENGTH
        if fuzzy or not any(out.get(stem[:k] + "*", 0.0) >= lexicon[term] - 0.3 for k in range(1, len(stem) + 1)):
            out[term] = lexicon[term]
    return out


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the labelled rows outside fold 0: SAMPLE_ROWS of them at most, the first by the hash of id and text."""
    chosen = labels.where((fold("doc_id") != 0) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE_ROWS)
    rows = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "sample")  # SAMPLE_ROWS rows of ids
    if rows.count() > SAMPLE_ROWS:  # ids that several rows share
        rows = written(rows.orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "doc_id", "text", "toxic").limit(SAMPLE_ROWS), "sample")
    return rows.select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from the labelled rows outside fold 0; ``docs`` needs doc_id and text, ``labels`` doc_id and toxic."""
    small_batches(docs.sparkSession)
    sample = training_rows(docs, labels)
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    if not bad or not good:
        return {"name": uuid.uuid4().hex, "share": bad / (bad + good) if bad + good else 0.0}

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                found[toxic].update(words_and_prefixes(text))
            names = list(found[1].keys() | found[0].keys())
            yield pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "bad": pa.array([found[1][t] for t in names], pa.int64()), "good": pa.array([found[0][t] for t in names], pa.int64())})

    seen = sample.mapInArrow(terms, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    sure = odds - 1.64 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    top = seen.where(F.col("bad") >= LEAST_TEXTS).select("term", "bad", sure.alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
    top = top.orderBy(F.desc("weight"), "term").collect()  # terms of the bounded sample
    lexicon = _pruned({r["term"]: r["weight"] for r in top})
    share = {r["term"]: r["bad"] / bad for r in top}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, found = Scanner(lexicon), Counter()
        for batch in batches:
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                if not toxic:
                    found.update({term for _, _, term in scanner.hits(text)[1] if term})
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    clean = {r["term"]: r["n"] / good for r in sample.mapInArrow(near, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    fuzzy = frozenset(t for t in lexicon if len(t) >= FUZZY_LENGTH and not t.endswith("*") and clean.get(t, 0.0) <= CLEAN_NEIGHBOURS * share[t])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon, fuzzy)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([scanner.features(t) for t in texts(batch)], pa.list_(pa.float64())), "toxic": batch.column("toxic")})

    table = sample.mapInArrow(rows, "x array<double>, toxic int").toArrow()  # SAMPLE_ROWS rows of eight numbers
    x, y = np.array(table.column("x").to_pylist()), np.array(table.column("toxic").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order in which tasks end
    return {"name": uuid.uuid4().hex, "lexicon": lexicon, "fuzzy": fuzzy, "fit": logistic(x[order], y[order])}


def _scorer(model: dict) -> Model:
    return kept_in_worker(("toxicity", model["name"]), lambda: Model(model))


class Model:
    def __init__(self, model: dict):
        self.share = model.get("share")
        if self.share is None:
            self.scanner = Scanner(model["lexicon"], model["fuzzy"])
            self.w, self.mean, self.spread = model["fit"]

    def scores(self, rows: list[str]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(rows), self.share)
        x = np.array([self.scanner.features(t) for t in rows])
        z = self.w[0] + ((x - self.mean) / self.spread) @ self.w[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = _scorer(shared.value)
        return lambda batch: pa.RecordBatch.from_pydict({key: batch.column(key), "score": pa.array(scorer.scores(texts(batch)), pa.float64())})

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, docs[text].alias("text")), make, f"{key} {kind}, score double")


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = _scorer(shared.value)
        return lambda batch: batch.filter(pa.array(scorer.scores(texts(batch, text)) < threshold))

    return arrow_map(docs, make, docs.schema)
