"""Fill-in-middle (operator 13): documents cut at token borders and put together again for infilling.

The Split pre-tokenizer of the tokenizers library, with its matches isolated, needs no training and gives the code-point
offsets of every match of a pattern. Here the pattern matches everything: a token is a run of white space with the
run of other characters after it, or the white space at the end of a text. The length of the offset array is n; the ends that stand
at two ranks of it cut the text into prefix, middle and suffix. Ranks and form come from a hash of seed and key, so every run cuts alike.

    plain   the text
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

A text that holds a mark stays plain, and no mark overlaps another, so ``restored`` finds the parts by the first occurrence of each mark.

Defined cases: a null text is empty; an empty text is plain, with n 0; a null key hashes as an empty one; a text with a mark, or a
row that the rate leaves out, is plain, with null lengths; repeated rows and equal keys are rows of their own and are cut
alike; extra columns are ignored; an empty table gives an empty table. A long text is split in sections that end where a token
ends, so a task holds the offsets of one section beside the ends themselves.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts

# White space and the marks.
SPACE = r"\x20\x09-\x0D"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The possessive run gives the matches of a plain one, without going back over a long run of white space.
TOKEN = rf"[{SPACE}]*+[^{SPACE}]+|[{SPACE}]+"
SECTION = 1 << 20
BORDER = re.compile(rf"(?<=[^{SPACE}])[{SPACE}]")


def token_ends(split, text: str, section: int = SECTION) -> np.ndarray:
    """The code-point offset at which each token ends."""
    found, start = [], 0
    while start < len(text):
        border = BORDER.search(text, start + section)
        stop = border.start() if border else len(text)
        found.append(np.array([end for _, (_, end) in split.pre_tokenize_str(text[start:stop])], np.int64) + start)
        start = stop
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n, form, prefix_chars, middle_chars, output. ``rate`` per cent of the rows are cut, ``spm_rate`` per cent of those in
    the order of spm."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    words = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = docs.schema[key].dataType.simpleString()

    def make():
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(TOKEN), "isolated")

        def cut(body: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
            ends = token_ends(split, body)
            n = len(ends)
            if h3 % 100 >= rate or not body or any(m in body for m in (PREFIX, SUFFIX, MIDDLE)):
                return n, "plain", None, None, body
            one, two = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
            prefix, middle, suffix = body[:one], body[one:two], body[two:]
            if h4 % 100 < spm_rate:
                return n, "spm", one, two - one, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
            return n, "psm", one, two - one, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = list(map(cut, texts(batch), *[batch.column(f"h{k}").to_pylist() for k in range(1, 5)]))
            kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
            return pa.RecordBatch.from_pydict({key: batch.column(key)} | {c: pa.array([m[k] for m in made], t) for k, (c, t) in enumerate(kinds.items())})

        return step

    rows = docs.select(F.col(key), docs[text].alias("text"), *words)
    return arrow_map(rows, make, f"{key} {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone."""

    def between(first: str, second: str) -> Column:
        start = F.locate(first, output) + len(first)
        return F.substring(output, start, F.locate(second, output) - start)

    tail = F.substring(output, F.locate(MIDDLE, output) + len(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), tail, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), tail, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of an output: its numbers, and the digests of the output and of the text restored from it."""
    back = restored(F.col("output"), F.col("form"))
    return made.select(key, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
