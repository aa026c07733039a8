"""Word byte pairs, spelling variants and fill-in-middle: against the library, brute force and exact round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from skyloom.llm import infill, variants, wordpieces

FILE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, word string, n long, h1 long, output string"
HARD = [
    "", None, " ", "<|endoftext|>a<|STARTOFTEXT|> b<|startoftext|><|endoftext|>", "ΑΣ Σ né İIİ ſ ß ẞ Ǆ", "a b\tc\x1cd\r\ne", "It's 'S''re <<<>>> 😀😀 ﷺ", "a\0b \0",
    "</w> a</w>b", " ́x \ńy é", "<P>", "x <S> y", "one <M", "  lead and trail  \n", " nb sp",
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 1, 2, "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def random_texts(n, seed=3):
    draw, letters = random.Random(seed), "abcdeé 'ΣσİI<|>endoftext\n\t́ ʼ1２Ⅷ_-</w>"
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(50))) for _ in range(n)]


def test_word_ids_are_the_library_s(library, monkeypatch):
    coder = wordpieces.WordEncoder(FILE)
    rows = [t or "" for t in HARD] + random_texts(3000) + ["aaaa" * 3000, "x" * 100_000, "incomprehensibilities " * 2000]
    for most in (1 << 20, 50):  # whole, and in sections
        monkeypatch.setattr(wordpieces, "SECTION", most)
        monkeypatch.setattr(wordpieces.sections, "__defaults__", (most,))
        got = [np.frombuffer(b, np.int32).tolist() for b in coder.encode(rows)]
        assert got == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]


def test_a_full_trie_and_cache_change_nothing(library, monkeypatch):
    for name, value in (("CACHE_ENTRIES", 3), ("TRIE_NODES", 20), ("KNOWN_PAIRS", 50), ("DEEPEST", 3)):
        monkeypatch.setattr(wordpieces, name, value)
    coder = wordpieces.WordEncoder(FILE)
    for rows in (random_texts(300, 5), ["internationalisation internationally interned"] * 3):
        assert [np.frombuffer(b, np.int32).tolist() for b in coder.encode(rows)] == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]


def test_shared_prefixes_are_computed_once(monkeypatch):
    coder, asked = wordpieces.WordEncoder(FILE), []
    plain = coder._last
    monkeypatch.setattr(coder, "_last", lambda body, depth, symbol, path: asked.append(body[:depth] + symbol) or plain(body, depth, symbol, path))
    coder.words({"interest", "interested", "interesting", "internal"})
    coder.words({"interests", "internals"})
    assert len(asked) == len(set(asked))


def test_word_bpe_over_rows(spark, library):
    rows = [*enumerate(HARD), (None, "null id"), (3, "again"), (3, "again")]
    made = wordpieces.digests(wordpieces.decode(wordpieces.encode(table(spark, rows), FILE), FILE)).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, want))
    assert wordpieces.encode(table(spark, []), FILE).isEmpty()
    odd = spark.createDataFrame([(1, None), (2, [320, 99999, -4, None, 49407])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in wordpieces.decode(odd, FILE).collect()} == {1: "", 2: "a</w> <|endoftext|>"}


def test_word_ids_of_all_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.ids for r in wordpieces.encode(docs, FILE).collect()}
    rows = docs.collect()
    assert [got[r.doc_id] for r in rows] == [e.ids for e in library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = {}
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in best.items() if n[f] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def edited(draw, word):
    k, c = draw.randrange(len(word) + 1), draw.choice("abcdé")
    return draw.choice([word[:k] + c + word[k:], word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :]])


def test_variants_equal_brute_force(spark):
    draw = random.Random(11)
    stems = ["".join(draw.choice("abcdé") for _ in range(draw.randrange(7, 12))) for _ in range(25)] + ["aaaaaaaa", "abababab", "ÀÉÎõüñçab"]
    known = {s: draw.choice([2, 3, 25, 300]) for s in stems}
    for s in stems:
        for _ in range(8):
            w = edited(draw, draw.choice([s, edited(draw, s)]))
            known[w] = known.get(w, draw.choice([2, 2, 3, 21, 30]))
    known |= {"kettenglied": 900, "kettengliedx": 60, "kettengliedxy": 4}  # a chain of forms
    words = [w for w, k in known.items() for _ in range(k)]
    draw.shuffle(words)
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    rows += [(None, "Kennwort, KENNWORT kennwort-kennworte kennworte"), (7, None), (8, ""), (9, "z" * 20_000), (9, "Z" * 20_000 + " " + "z" * 20_001), (10, "z" * 20_001)]
    got = {tuple(r) for r in variants.spelling_variants(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute_variants(rows)
    assert got == want and sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)
    assert variants.spelling_variants(table(spark, [])).isEmpty() and variants.spelling_variants(table(spark, [(1, "short"), (2, None)])).isEmpty()


def test_three_rarest_bigrams_meet_in_every_near_pair(spark):
    """Any pair with one edit is found, whatever the order of the bigrams."""
    draw = random.Random(2)
    words = {"".join(draw.choice("ab") for _ in range(draw.randrange(7, 10))) for _ in range(150)}
    from skyloom.llm.common import Scratch

    known = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {frozenset((r.a, r.b)) for r in variants.near_words(known, Scratch(spark)).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}


def test_token_ends_are_those_of_the_pattern(monkeypatch):
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(infill.TOKEN), "isolated")
    plain = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
    for text in [t or "" for t in HARD] + random_texts(300) + [" " * 50_000 + "x" + "\t" * 50_000]:
        for section in (1, 7, 1 << 20):
            assert infill.token_ends(split, text, section).tolist() == [m.end() for m in plain.finditer(text)]


def test_fill_in_middle_round_trip(spark):
    texts = [t or "" for t in HARD] + random_texts(200) + ["<", "<S", "P>", "a <P", "S> b", "word " * 30_000]
    rows = [*enumerate(texts), (None, "null id and words"), (5, None)]
    docs = table(spark, rows)
    made = infill.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    by = {r.doc_id: r for r in made.where("doc_id is not null and doc_id <> 5").collect()}
    plain = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
    for i, text in rows:
        if i in (None, 5):
            continue
        digest, tokens = hashlib.sha256(f"42:{i}".encode()).hexdigest(), plain.findall(text)
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        one, two = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
        p, m, s = "".join(tokens[:one]), "".join(tokens[one:two]), "".join(tokens[two:])
        form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want = (i, len(tokens), form, None if form == "plain" else len(p), None if form == "plain" else len(m), output)
        assert tuple(by[i]) == want
    assert {r.form for r in by.values()} == {"plain", "psm", "spm"}
    back = infill.digests(made).collect()
    want = sorted((repr(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((repr(r.doc_id), r.restored_sha256) for r in back) == want
    assert infill.fill_in_middle(table(spark, [])).isEmpty()
