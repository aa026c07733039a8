"""Secret scans (operator 7): fixed patterns, plus values that are costly to guess in a credential context.

The base kinds are three patterns. The added kind ``guess`` looks at values assigned to, or said to be, a
credential, and estimates how many guesses an attacker needs: the minimum-cost segmentation of the value into
dictionary words, dates, repeats, keyboard walks and brute-force spans, found by dynamic programming over its
positions. Every span that is a word, date, repeat or walk by itself is relaxed, whatever its length, so the cost is the
least over all segmentations. A value whose cost reaches ``min_log10`` becomes a span unless it overlaps a base span.

- A repeat is a unit that stands twice or more and is no repeat itself; it costs the unit's own least cost and the count.
- A walk goes from key to adjacent key, with turns; a sequence goes along the alphabet or the digits, either way.

The dictionary is a fixed list of frequent passwords and the words of the corpus itself that stand in at least ``SHARE``
of its texts (``common_words``: over all texts, the values in credential contexts left out), so prose behind "the
password is" is cheap in whatever language the corpus is. A word's rank is its number of guesses. Shares and ranks do
not change when a corpus grows by more of the same, so neither do the spans; and the dictionary holds at most
(mean number of different words of a text) / SHARE words, whatever the number of texts.

Defined cases: null text counts as empty and has no spans; repeated rows are scanned row by row; a span is in
code points, end exclusive; words of one frequency are ranked by the word; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from math import inf, lgamma, log, log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_batches, texts

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}+")  # the maximal runs of 24 and more
# A word that a text must hold for a name, and the names of credentials.
NAMES = (
    ("pass", r"pass(?:word|wd|phrase|code)?"),
    ("pwd", r"pwd"),
    ("pin", r"pin"),
    ("secret", r"secret"),
    ("credential", r"credentials?"),
    ("token", r"token"),
    ("auth", r"auth"),
    ("bearer", r"bearer"),
    ("private", r"private[ _-]?key"),
    ("access", r"access[ _-]?key"),
    ("api", r"api[ _-]?key"),
)
# A name starts at the edge of a word, after "_" (DB_PASSWORD) or where the case changes (clientSecret).
CONTEXT = re.compile(
    r"""(?:\b|(?<=_)|(?-i:(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))(?:"""
    + "|".join(name for _, name in NAMES)
    + r""")["']?\x20*(?:[:=]|\bis\b|\bbearer\b)\x20*["']?([!-~]{6,})""",
    re.IGNORECASE | re.ASCII,
)
CONTEXT_WORDS = tuple(word for word, _ in NAMES)

# Frequent words of passwords, by falling frequency; the rank is the number of guesses.
WORDS = """password the qwerty dragon monkey letmein master shadow football baseball admin welcome login hello
princess sunshine superman michael jordan batman trustno killer hunter ranger soccer hockey george charlie andrew
thomas jennifer jessica summer winter spring autumn flower secret access test user root guest default changeme love
god money star blue green black white red orange yellow silver gold happy coffee cookie cheese pepper ginger tiger
eagle falcon lion wolf bear horse snake spider angel devil heaven music guitar piano game player computer internet
server windows linux apple google phone mobile friend family mother father sister brother baby girl boy king queen
prince magic wizard ninja pirate samurai rocket planet earth moon sun ocean river mountain forest garden house home
office school teacher doctor january february march april may june july august september october november december
monday tuesday wednesday thursday friday saturday sunday correct battery staple example sample demo temp new old
company pass word key token data base cloud prod dev stage""".split()
# Rows of a keyboard, each key up and right of the one below it; what its keys give with shift; sequences.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ('!@#$%^&*()_+{}:"<>?', "1234567890-=[];',./")
SEQUENCES = ("0123456789", "abcdefghijklmnopqrstuvwxyz")
#: Row and column of each key, and the steps from a key to those next to it.
KEYS = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
STEPS = ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1))
UNSHIFT = str.maketrans(*SHIFTED)
LEET = str.maketrans("0134578@$!", "oieastbasi")
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])(?:\1(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d")
DATE_LENGTHS = (4, 6, 7, 8, 10)
DATE_GUESSES = 365 * 120
#: The least characters of a word, a walk and a sequence.
SHORTEST = 3
#: A word of the corpus stands in at least one text of 2,000.
SHARE = 1 / 2000
LETTERS = re.compile(r"[^\W\d_]{3,}")
#: Units as long as this are looked for by their first characters.
SEED = 8
SEPARATE, UPPER, LEETED = 0.3, 0.3, 0.6  # log10 of the guesses for one more segment, for capitals, for letters replaced


class Guesser:
    """Guess costs with a dictionary of words and their ranks; keeps the costs of a few thousand values."""

    def __init__(self, ranks: dict[str, int] | None = None):
        self.ranks = dict(ranks or {})
        for word, rank in RANK.items():
            self.ranks[word] = min(rank, self.ranks.get(word, rank))
        lengths: dict[str, set[int]] = {}
        for word in self.ranks:
            lengths.setdefault(word[:SHORTEST], set()).add(len(word))
        self.lengths = {start: sorted(of) for start, of in lengths.items()}  # of the words that start so
        self.known: dict[tuple[str, float], float] = {}

    def cost(self, value: str, limit: float = inf) -> float:
        """log10 of the guesses for the cheapest segmentation of a value, or ``limit`` if it is not below that."""
        if (value, limit) not in self.known:
            if len(self.known) >= 4096:
                self.known.clear()
            self.known[value, limit] = self._least(value, log10(max(alphabet(value), 2)), limit, {})
        return self.known[value, limit]

    def _least(self, value: str, brute: float, limit: float, units: dict[str, float]) -> float:
        """Positions whose cost reaches the limit lead nowhere: segments only add to it."""
        if value in units:
            return units[value]
        n = len(value)
        low = value.lower()
        if len(low) != n:
            low = value  # a character that has no lower case of one character
        plain, keys = low.translate(LEET), low.translate(UNSHIFT)
        cost = [0.0] + [inf] * n
        runs: dict[int, tuple[int, int]] = {}  # by width: start and end of the last run seen
        starts: dict[tuple[int, int, int], list[int]] = {}  # of repeats, by width, end of the run and place in the unit
        furthest = 0

        def relax(i: int, j: int, guesses: float) -> None:
            nonlocal furthest
            total = cost[i] + (SEPARATE if i else 0.0) + guesses
            if total < cost[j] and total < limit:
                cost[j] = total
                furthest = max(furthest, j)

        for i in range(n):
            if i > furthest:
                break
            if cost[i] == inf:
                continue
            if cost[i] + brute < min(cost[i + 1], limit):
                cost[i + 1] = cost[i] + brute
                furthest = max(furthest, i + 1)
            self._words(value, low, plain, i, relax)
            if value[i].isdigit():
                for length in DATE_LENGTHS:
                    if i + length <= n and DATE.fullmatch(value, i, i + length):
                        relax(i, i + length, log10(DATE_GUESSES))
            for end, guesses in lines(low, i):
                relax(i, end, guesses)
            for end, guesses in walks(keys, i, limit - cost[i]):
                relax(i, end, guesses + (UPPER if keys[i:end] != value[i:end] else 0.0))
            for width, end in repeats(value, i, runs):
                kept = starts.setdefault((width, end, i % width), [])
                # From an earlier start of the same run the same ends are reached with (m + k) / k times the guesses, k >= 2.
                if any(cost[i] - cost[a] + (0.0 if a else SEPARATE) >= log10(((i - a) // width + 2) / 2) for a in kept):
                    continue
                kept.append(i)
                unit = brute if width == 1 else self._least(value[i : i + width], brute, limit, units)
                for times in range(2, (end - i) // width + 1):
                    relax(i, i + times * width, unit + log10(times))
        units[value] = min(cost[n], limit)
        return units[value]

    def _words(self, value: str, low: str, plain: str, i: int, relax) -> None:
        for length in self.lengths.get(low[i : i + SHORTEST], ()):
            if i + length <= len(value) and (rank := self.ranks.get(low[i : i + length])):
                relax(i, i + length, log10(rank + 1) + (UPPER if value[i : i + length] != low[i : i + length] else 0.0))
        for length in self.lengths.get(plain[i : i + SHORTEST], ()):
            if i + length <= len(value) and plain[i : i + length] != low[i : i + length] and (rank := self.ranks.get(plain[i : i + length])):
                relax(i, i + length, log10(rank + 1) + LEETED)


def lines(low: str, i: int) -> Iterator[tuple[int, float]]:
    """End and cost of each sequence that starts at i."""
    for row in SEQUENCES:
        for line in (row, row[::-1]):
            at, j = line.find(low[i]), i
            while 0 <= at < len(line) and j < len(low) and low[j] == line[at]:
                j, at = j + 1, at + 1
                if j - i >= SHORTEST:
                    yield j, log10(len(row) * 2 * (j - i))


def walks(keys: str, i: int, limit: float) -> Iterator[tuple[int, float]]:
    """End and cost of each keyboard walk that starts at i: first key, direction and length, then where it turns and whereto."""
    turns, last, j = 0, None, i
    while j + 1 < len(keys) and keys[j] in KEYS and keys[j + 1] in KEYS:
        (r, c), (to_r, to_c) = KEYS[keys[j]], KEYS[keys[j + 1]]
        step = (to_r - r, to_c - c)
        if step not in STEPS:
            return
        turns += last is not None and step != last
        last, j = step, j + 1
        length = j + 1 - i
        if length >= SHORTEST:
            places = (lgamma(length - 1) - lgamma(turns + 1) - lgamma(length - 1 - turns)) / log(10)  # turns among length - 2 keys
            guesses = log10(len(KEYS) * len(STEPS) * length) + turns * log10(len(STEPS) - 1) + places
            if guesses >= limit:
                return  # it never falls with the length
            yield j + 1, guesses


def alike(value: str, a: int, b: int) -> int:
    """How many characters from a and from b are the same."""
    most, step = len(value) - max(a, b), 1
    while step < most and value[a : a + step] == value[b : b + step]:
        step *= 2
    low, high = 0, min(step, most)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if value[a + low : a + middle] == value[b + low : b + middle] else (low, middle - 1)
    return low


def repeats(value: str, i: int, runs: dict[int, tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Width and end of each run at i of a unit that stands twice or more and is no repeat itself, by width.

    In a run of width w up to ``end`` no width from w + 1 to end - i - w gives a new unit: two such periods would have a
    common divisor for period. ``runs`` is filled on the way.
    """
    most = (len(value) - i) // 2
    width = 1
    while width <= most:
        if width >= SEED:
            at = value.find(value[i : i + SEED], i + width)
            if at < 0 or at - i > most:
                return
            width = at - i
        start, end = runs.get(width, (0, 0))
        if not start <= i <= end - 2 * width:
            if value[i : i + width] != value[i + width : i + 2 * width]:
                width += 1
                continue
            end = i + width + alike(value, i, i + width)
            runs[width] = (i, end)
        if (value[i : i + width] * 2).find(value[i : i + width], 1) == width:
            yield width, end
        width = max(width + 1, end - i - width + 1)


def alphabet(value: str) -> int:
    """Characters of the classes that a value draws from."""
    return 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 33 * any(not c.isalnum() for c in value)


#: The last guesser that this worker has used, by the name of its dictionary: tasks of one job share it.
_LAST: dict[str, Guesser] = {}


def _guesser(named: tuple[str, dict[str, int]]) -> Guesser:
    name, ranks = named
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Guesser(ranks)
    return _LAST[name]


_FIXED = Guesser()


def guess_cost(value: str) -> float:
    """The cost by the fixed list of passwords alone."""
    return _FIXED.cost(value)


def _held(low: str, words: tuple[str, ...]) -> bool:
    return any(w in low for w in words)


def without_values(text: str) -> str:
    """A text without what its patterns take for credentials, so that these do not become words of the dictionary."""
    low = text.lower()
    if _held(low, ASSIGN_WORDS):
        text = ASSIGN.sub(" ", text)
    return CONTEXT.sub(" ", text) if _held(low, CONTEXT_WORDS) else text


def common_words(docs: DataFrame, text: str = "text", share: float = SHARE) -> dict[str, int]:
    """The words that stand in at least ``share`` of all texts and their ranks, from 1 for the most frequent."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for t in texts(batch):
                found.update(set(LETTERS.findall(without_values(t).lower())))
            if len(found) > 200_000:  # a bounded table, handed on as it fills
                yield _counts(found)
                found.clear()
        yield _counts(found)

    rows = docs.select(docs[text].alias("text")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = rows.where(F.col("n") >= share * docs.count()).orderBy(F.desc("n"), "word").toArrow()  # at most mean words of a text / share
    return {w: i + 1 for i, w in enumerate(top.column("word").to_pylist())}


def _counts(found: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})


def scan(text: str, min_log10: float = 12.0, guesser: Guesser = _FIXED) -> list[tuple[int, str, int]]:
    """Spans (start, kind, end) of a text, by start and then by kind in the order of KINDS."""
    spans = []
    low = text.lower()
    if _held(low, ASSIGN_WORDS):
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    base = sorted(spans, key=lambda s: s[0])
    if _held(low, CONTEXT_WORDS):
        for m in CONTEXT.finditer(text):
            start, value = m.start(1), m[1].rstrip("\"',;.)")
            end = start + len(value)
            if len(value) >= 6 and guesser.cost(value, min_log10) >= min_log10 and not any(a < end and start < b for a, _, b in base):
                spans.append((start, "guess", end))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def secret_spans(docs: DataFrame, min_log10: float = 12.0, key: str = "doc_id", text: str = "text", ranks: dict[str, int] | None = None) -> DataFrame:
    """Per row: key and ``found``, an array of (kind, start, end). ``ranks``: the dictionary, by default that of ``docs``."""
    ranks = common_words(docs, text) if ranks is None else ranks
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ranks))

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        guesser = _guesser(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"kind": k, "start": a, "end": b} for a, k, b in scan(t, min_log10, guesser)] for t in texts(batch)]
            return pa.RecordBatch.from_pydict({key: batch.column(key), "found": pa.array(found, kind)})

        return step

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, docs[text].alias("text")), make, f"{key} {kind}, found array<struct<kind: string, start: bigint, end: bigint>>")


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def digest(spans: list[tuple[int, str, int]]) -> str:
    return hashlib.sha256(joined([s for s in spans if s[1] != "guess"]).encode()).hexdigest()
