"""Spelling variants (operator 12): words of a corpus that are one edit from a far more frequent word.

Words that differ by one edit are found by a rare-first prefix filter over positional bigrams. An edit spoils at most two
bigrams of a word, so of the three rarest ones of either word (ordered over the whole corpus by the number of words that hold
them, then by themselves and their place) at least one stands in both words' three, at the same place or, past an edit that
inserts, one further. The edit leaves the first half or the second half of the shorter word as it is, too. Only the three
bigrams of each word are joined, on bigram, place, length and an equal half:

    base    (bigram, place, length, half)                     of every word, for either half
    probe   (bigram, place, length, half)                     finds words of the same length
            (bigram, place or place - 1, length - 1, half)    finds words with one character less

and every candidate is verified by its edit distance in the join itself. The key of the join is the hash of these, and the
join has an exchange on it, so Spark splits a key that very many words share; nothing is capped.

All steps are DataFrame functions. Documents are read once, to count words; all later tables have a few rows for each distinct word, 18 at
most. The one table that is broadcast has a row for each bigram of the alphabet: 90 letters, 8,100 rows at most.

Defined cases: a null text has no words; a null key counts as an empty one in the hash that deletes a letter; empty texts and an empty
table give no rows; repeated documents count again; of near words with equal counts the least in code-point order is the form; extra
columns are ignored. A word of any length is compared whole: the distance stops at one edit, so it costs its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

# Letters, the least length of a word, and one occurrence in so many that loses a letter.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
SPOILT = 31
#: A form is so many times as frequent as its variant.
TIMES = 10
PREFIX = 3


def _lower(run: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(run.rlike("[A-Z]"), F.translate(run, upper, upper.lower())).otherwise(run)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): the letter runs of all texts that have ``least`` letters after one in ``SPOILT`` occurrences has lost one."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), 0)).alias("run"))
    runs = runs.select("k", _lower(F.col("run")).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("h") % SPOILT == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def bigrams(known: DataFrame) -> DataFrame:
    """(word, gram, place) of words: two letters and where they begin."""
    letters = F.split("word", "")
    cut = known.select("word", letters.alias("c"))
    first, second = F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1)
    cut = cut.where("size(c) > 1").select("word", F.posexplode(F.arrays_zip(first.alias("a"), second.alias("b"))).alias("place", "g"))
    return cut.select("word", F.concat("g.a", "g.b").alias("gram"), "place")


def rarest(known: DataFrame, most: int = PREFIX) -> DataFrame:
    """(word, gram, place): the rarest bigrams of each word by the number of bigrams in all words."""
    grams = bigrams(known)
    counts = grams.groupBy("gram").agg(F.count("*").alias("held"))
    order = Window.partitionBy("word").orderBy("held", "gram", "place")
    few = grams.join(F.broadcast(counts), "gram").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return few.select("word", "gram", "place")


def near_words(known: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): all pairs of different words with one edit between them, each once; b is the longer, or the later of equal length."""
    entries = scratch.write(rarest(known), "entries")

    def keys(length: Column, places: list[Column]) -> Column:
        """Keys of the word as one of this length, or of what is left of it after one character before or after the bigram."""
        half = (length / 2).cast("int")
        parts = (F.substring("word", F.lit(1), half), F.substring("word", F.length("word") - (length - half) + 1, length - half))
        return F.array(*[F.xxhash64("gram", place, length, F.lit(side), part) for place in places for side, part in enumerate(parts)])

    own, place = F.length("word"), F.col("place")
    base = entries.select(F.explode(keys(own, [place])).alias("key"), F.col("word").alias("a"))
    probes = F.concat(keys(own, [place]), keys(own - 1, [place, place - 1]))
    probe = entries.select(F.explode(probes).alias("key"), F.col("word").alias("b"))
    fits = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    found = base.hint("merge").join(probe, "key").where(fits & (F.levenshtein("a", "b", 1) == 1))
    return scratch.write(found.select("a", "b").distinct(), "near")


def _roots(forms: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(word, root): forms followed to the last. A form is TIMES as frequent as its word, so a chain has at most log(most) steps and
    doubling ends after few rounds."""
    steps = max(1, math.ceil(math.log(max(2, most), TIMES)))
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        at = scratch.write(at, "roots")
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return at


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with two occurrences at least."""
    scratch = Scratch(docs.sparkSession)
    known = scratch.write(words(docs, key, text).where("n >= 2"), "words")
    near = near_words(known, scratch)
    scratch.drop("entries")
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other")))
    seen = both.join(known.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = seen.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best"))
    placed = known.join(best, "word", "left")
    is_form = -F.col("best.m") >= times * F.col("n")
    placed = placed.select("word", F.when(is_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.m")).alias("form_n"))
    placed = scratch.write(placed, "placed")
    most = known.agg(F.max("n")).first()[0] or 0
    roots = _roots(placed.where("form is not null"), most, scratch)
    out = scratch.write(placed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    scratch.close("variants")
    return out
