"""Search, near-duplicates, leaks, toxicity, mixing and the pipeline against brute force and on edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import leaks, mixing, neardup, topk, toxicity


def words(rng, n):
    return [rng.choice("tha on er wh in ed re ti nd sh ou an".split()) + rng.choice("ble ing est ly or ea st nt he".split()) + rng.choice("abcdefghij") for _ in range(n)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, uid string, score string")


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 16).round(3).tolist(), "x", "y") for i in range(700)]
    rows += [(900 + i, rows[5][1], "x", "y") for i in range(40)]  # a common vector: ties
    rows += [(7, rows[9][1], "x", "y"), (2000, None, "", ""), (2001, [], "", ""), (2002, [float("nan")] * 16, "", ""), (2003, [None] * 16, "", ""), (100, [0.5] * 8, "", "")]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=10).collect()
    fine = [(i, np.floor(1024 * np.pad(np.array(v, np.float32).astype(float), (0, 16 - len(v))))) for i, v, *_ in rows if v and None not in v and np.isfinite(np.array(v, float)).all()]
    want = []
    for q, (i, v) in enumerate(fine):
        if i % 100 == 0:
            best = sorted((-int(v @ w), j) for p, (j, w) in enumerate(fine) if p != q)[:10]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(vectors(spark, rows[:3]), F.col("vec_id") == 1, k=10).count() == 2
    assert topk.top_k(vectors(spark, []), F.col("vec_id") == 1).count() == 0


def test_top_k_over_many_shards_and_huge_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 12).tolist(), "x") for i in range(900)] + [(1000, [1e306] * 12, "x"), (1001, [float("inf")] * 12, "x"), (1002, [1e15] * 12, "x"), (1100, [0.1] * 20, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, hits string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=7).collect()
    fine = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows if np.isfinite(1024 * np.array(v)).all()]
    want = []
    for i, v in fine:
        if i % 50 == 0:
            best = sorted((-min(topk.LONG, max(-topk.LONG - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in fine if j != i)[:7]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_large_scores_saturate():
    big = np.array([[1e15, 1e15]])
    assert topk.exact(big, np.array([1e15, 1e15]))[0] == topk.LONG
    assert topk.exact(np.array([[3e9, 1.0]]), np.array([3e9, 1.0]))[0] == 9 * 10**18 + 1


def brute_classes(rows):
    seqs, first = {}, {}
    hasher = neardup.Hasher()
    for i, t in sorted(rows):
        own = neardup.WORD.findall(t.lower())
        node = neardup.digest(t, own)
        first.setdefault(node, i)
        seqs.setdefault(node, hasher.shingles(own) if own else np.zeros(0, np.uint64))
    parent = {n: n for n in seqs}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    names = list(seqs)
    for a in range(len(names)):
        for b in range(a):
            if len(seqs[names[a]]) and len(seqs[names[b]]) and neardup.similarity(seqs[names[a]], seqs[names[b]]) >= 0.8:
                parent[find(names[a])] = find(names[b])
    least = {}
    for n in names:
        least[find(n)] = min(least.get(find(n), 10**9), first[n])
    return {i: least[find(neardup.digest(t, neardup.WORD.findall(t.lower())))] for i, t in rows}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    base, passage = words(rng, 160), words(rng, 70)
    rows = []
    for k in range(90):  # a large group of near copies, some far from its hub
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            own[rng.randrange(len(own))] = "edit" + str(rng.randrange(10**6))
        rows.append(" ".join(own))
    rows += [" ".join(words(rng, rng.randrange(2, 30)) + passage) for _ in range(60)]  # a passage that many share
    rows += [" ".join(words(rng, 80)) for _ in range(40)] + [" ".join(base)] * 5
    rows += ["", "", "!!", "??", "one two", "one two", "One, two.", "one two three"]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, "n", "k") for i, t in rows], "doc_id long, text string, node string, key string").repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == brute_classes(rows)


def independent_classes(rows):
    """Classes by the definition: longest common ordered chain of labelled five-word shingles, over every pair of texts."""

    def labelled(text):
        own = re.findall(r"\w+", text.lower())
        seen, out = defaultdict(int), []
        for k in range(max(1, len(own) - 4)):
            s = tuple(own[k : k + 5])
            out.append((s, seen[s]))
            seen[s] += 1
        return out

    def chain(a, b):
        place = {s: j for j, s in enumerate(b)}
        best = []
        for s in a:
            if s in place:
                j = place[s]
                best.append((j, 1 + max((n for i, n in best if i < j), default=0)))
        return max((n for _, n in best), default=0)

    seqs = [labelled(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and min(len(seqs[i]), len(seqs[j])) >= 0.8 * max(len(seqs[i]), len(seqs[j])):
                c = chain(seqs[i], seqs[j])
                if c >= 0.8 * (len(seqs[i]) + len(seqs[j]) - c):
                    head[find(i)] = find(j)
    classes = defaultdict(set)
    for i in range(len(rows)):
        classes[find(i)].add(i)
    return {frozenset(c) for c in classes.values()}


@pytest.mark.parametrize("tile", [320, 7])
def test_near_duplicates_equal_the_definition_over_all_pairs(spark, monkeypatch, tile):
    """A family that one hub does not hold together, a passage that many share, rows without ids, texts of few words; small
    tiles give what one tile gives."""
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "TEXT_TILE", tile)
    rng = random.Random(31)
    rows, base = [], words(rng, 200)
    for step in range(30):  # a chain: each text is near the next, the ends are far from each other
        base = list(base)
        base[6 * step] = f"step{step}"
        rows += [" ".join(base), " ".join([*base[:-1], f"end{step}"])]
    passage = words(rng, 90)
    rows += [" ".join(words(rng, 25) + passage + words(rng, 10)) for _ in range(45)]
    short = words(rng, 9)
    rows += [" ".join(short), " ".join(short[:-1]), " ".join(words(rng, 60)), "a b c d e f g h i j k l", "a b c d e f g h i j k l m"]
    docs = spark.createDataFrame([(i if i % 3 else None, t, i) for i, t in enumerate(rows)], "doc_id long, text string, row long")
    scratch = neardup.Scratch(spark)
    found = neardup._classes(docs, scratch, 0.8, "doc_id", "text")
    part = {(r.doc_id, r.raw): r.component for r in found.collect()}
    named = docs.select("row", "doc_id", F.xxhash64("text").alias("raw")).collect()
    got = defaultdict(set)
    for r in named:
        got[part[r.doc_id, r.raw]].add(r.row)
    assert {frozenset(c) for c in got.values()} == independent_classes(list(enumerate(rows)))


def test_recall_at_lower_similarity(spark):
    """Of pairs whose similarity is 0.8 to 0.85, none of 300 is missed (expected: 1e-4 of them at most)."""
    rng = random.Random(32)
    rows = []
    while len(rows) < 600:
        own = words(rng, rng.randrange(40, 200))
        other = list(own)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(other))
            other[at : at + 1] = [] if rng.random() < 0.5 else [f"e{rng.randrange(10**6)}"]
        h = neardup.Hasher()
        if 0.8 <= neardup.similarity(h.shingles(own), h.shingles(other)) <= 0.85:
            rows += [" ".join(own), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {i: i - i % 2 for i in range(600)}


def test_near_duplicates_of_long_texts(spark):
    rng = random.Random(33)
    own = words(rng, 60_000)
    docs = spark.createDataFrame([(1, " ".join(own)), (2, " ".join([*own[:-9], "x"])), (3, " ".join(words(rng, 50_000))), (4, "a " * 40_000), (5, "a " * 39_000)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_near_duplicates_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, None), (None, "a b c d e f"), (3, "a b c d e f"), (4, "x y"), (4, "x y"), (5, "x y")], "doc_id long, text string")
    got = [(r.doc_id, r.class_id) for r in neardup.classes(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (None, 3), (3, 3), (4, 4), (4, 4), (5, 4)], key=str)
    kept = neardup.keep_first(docs)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, None), (2, None), (None, "a b c d e f"), (3, "a b c d e f"), (4, "x y")], key=str)
    assert neardup.classes(docs.limit(0)).count() == 0


def test_kept_rows_have_all_columns_whatever_their_names(spark):
    rows = [(1, "a b c d e f", 7, 8), (2, "a b c d e f", 9, 1), (2, "a b c d e f", 9, 1), (None, "x y z", 5, 5), (None, "x y z", 5, 6), (None, "x", 5, 5), (None, None, 1, 1), (3, "", 2, 2)]
    names = "component class_id head rows n_texts again id"
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id long, raw long").selectExpr("*", *[f"1 as `{n}`" for n in names.split()])
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, "a b c d e f"), (3, ""), (None, "x y z"), (None, "x"), (None, None)], key=str)
    assert {(r.gone_id, r.raw) for r in got if r.doc_id == 1} == {(7, 8)}


def test_pipeline_leaves_store_and_result(spark, sf, tmp_path, monkeypatch):
    import os

    import corpus_pipeline
    from skyloom.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = sorted(name for folder in os.listdir(tmp_path) for name in os.listdir(tmp_path / folder))
    assert [n for n in left if not n.startswith(".")] == ["store", "token_store"]


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rng = random.Random(20)
    own = [words(rng, 90) for _ in range(4)]
    a, b, c, d = (" ".join(w) for w in own)
    near = lambda w: " ".join([*w[:-1], "edit"])
    rows = [(3, a), (5, near(own[0])), (5, b), (7, near(own[1])), (9, c), (9, d), (None, near(own[2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in neardup.keep_first(docs).collect()}
    assert kept == {(3, a), (5, b), (9, c), (9, d), (None, near(own[2]))}
    alone = spark.createDataFrame([(4, c), (None, near(own[2]))], "doc_id long, text string")
    assert {r.class_id for r in neardup.classes(alone).collect()} == {4}


def test_sizes_of_classes_are_whole(spark):
    rng = random.Random(21)
    big, small = words(rng, 120), words(rng, 120)
    rows = [(i, " ".join([*big[:-1], f"edit{i}"])) for i in range(30)] + [(40 + i, " ".join([*small[:-1], f"edit{i}"])) for i in range(3)] + [(50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_texts) for r in neardup.classes(docs).collect()} == {(i, 30) for i in range(30)} | {(40 + i, 3) for i in range(3)} | {(50, 1)}


def test_order_counts_for_similarity():
    h = neardup.Hasher()
    a = words(random.Random(1), 200)
    same, turned = h.shingles(a), h.shingles(a[100:] + a[:100])
    assert neardup.similarity(same, same) == 1.0 and neardup.similarity(same, turned) == 0.0
    keys = neardup.sketch(same)
    assert (keys == neardup.sketch(h.shingles(a))).all() and (keys == neardup.sketch(turned)).mean() < 0.9
    assert len(set(h.shingles(["a"] * 50).tolist())) == 46


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, rng.randrange(16, 60)))) for i in range(50)] + [(90, "What is it? forty two of all the whole"), (91, None), (92, "")]
    docs = []
    for i in range(60):
        own = words(rng, rng.randrange(0, 400))
        if i % 3 == 0:
            at = rng.randrange(len(own) + 1)
            own[at:at] = items[rng.randrange(50)][1].upper().split()
        docs.append((i, " ".join(own), "c"))
    docs += [(100, None, "c"), (101, "", "c"), (102, items[3][1].replace(" ", ", ", 5), "c")]
    half = items[4][1].split()
    docs.append((103, " ".join(half[: len(half) // 2]), "c"))  # the question without its answer
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, table).collect()}
    want = set()
    for i, t, _ in docs:
        own = leaks.words(t or "")
        for j, item in items:
            q, a = leaks.parts(item or "")
            if q and any(leaks.overlap(q, own[s : s + 130]) >= 0.8 and leaks.overlap(a, own[s : s + 130]) >= 0.8 for s in range(0, max(1, len(own)), 8)):
                want.add((i, j))
    assert got == want and len(want) > 18
    kept = {r.doc_id for r in leaks.without_leaks(df, table).collect()}
    assert kept == {i for i, *_ in docs} - {i for i, _ in want}
    assert leaks.find_leaks(df.limit(0), table).count() == 0 and leaks.find_leaks(df, table.limit(0)).count() == 0


def test_leaks_do_not_depend_on_other_items(spark, monkeypatch):
    rng = random.Random(16)
    short = [(i, " ".join(words(rng, 15))) for i in range(40)]
    pool = sorted({w for _, t in short for w in t.split()})
    docs = [(i, " ".join(rng.choice(pool) for _ in range(5000))) for i in range(6)]  # all words of the items, in no order
    docs += [(10, " ".join(words(rng, 50)) + " " + short[7][1] + " " + " ".join(words(rng, 50)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame([*short, (99, " ".join(words(rng, 5000)))], "item_id long, text string")
    rows = sorted(map(tuple, leaks.find_leaks(df, table).collect()))
    assert [r[:2] for r in rows] == [(10, 7)]
    assert {r.doc_id for r in leaks.without_leaks(df, table).collect()} == set(range(6))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 100)  # scores do not depend on blocks
    assert sorted(map(tuple, leaks.find_leaks(df, table).collect())) == rows


def test_wand_equals_scoring_all():
    rng = random.Random(8)
    index = leaks.Index([(i, " ".join(words(rng, 40))) for i in range(300)], threshold=0.2)
    for _ in range(100):
        terms = set(words(rng, 90))
        scores = defaultdict(float)
        for t in terms & index.lists.keys():
            for i, w in zip(index.lists[t].items, index.lists[t].weights, strict=True):
                scores[i] += w
        assert {i for i, _ in index.retrieve(terms)} == {i for i, s in scores.items() if s >= 0.2 - 1e-9}


def test_automaton_equals_edit_distance():
    rng = random.Random(9)
    lexicon = {"stupid": 5.0, "idiot": 4.0, "scum": 3.0, "trashy": 2.0, "lowe*": 2.5}
    automaton = toxicity.Automaton(lexicon)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    tried = list(lexicon) + ["".join(rng.choice("stupidocarhylwe") for _ in range(rng.randrange(1, 8))) for _ in range(500)]
    for w in ("stupid", "idiot", "scum", "trashy"):
        tried += [w[:i] + c + w[i + d :] for i in range(len(w) + 1) for d in (0, 1) for c in ("", "x", "t")]
    for w in tried:
        exact = max([lexicon.get(w, 0.0) if not w.endswith("*") else 0.0] + [2.5] * w.startswith("lowe"))
        near = max([v for t, v in lexicon.items() if not t.endswith("*") and len(t) >= 5 and 0 < distance(w, t) <= 1] + [0.0])
        got = automaton.match(w)[0]
        assert got == pytest.approx(max(exact, toxicity.FUZZY_DISCOUNT * near, toxicity.FUZZY_DISCOUNT * (lexicon.get(w, 0.0) if len(w) >= 5 else 0.0)))


def test_toxicity_held_out(spark, sf01):
    from skyloom.llm import queries

    scored = queries.op9_toxicity(spark, sf01).join(spark.read.parquet(f"{sf01}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in scored]) > 0.9
    assert all(0 <= r.score <= 1 for r in scored)


def test_toxicity_without_labels_and_quotes(spark):
    docs = spark.createDataFrame([(i, f"you are an awful grumbler number {i}" if i % 2 else f"fine words here {i}") for i in range(60)] + [(100, None), (101, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(rows) == 62 and rows[1] > 0.5 > rows[2] and rows[100] == rows[101] < 0.5
    scanner = toxicity.Scanner({"grumbler": 4.0})
    direct, quoted = scanner.features("you grumbler go away"), scanner.features('he said "grumbler" and left')
    assert direct[0] > 0 and quoted[0] == 0 and quoted[6] > 0
    assert scanner.features("you grumblr go away")[0] > 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id % 2 = 1 and doc_id < 60").isEmpty()


def test_misspelled_learned_words_are_found(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(words(rng, 9) + (["grumbler"] if i % 4 == 0 else []) + words(rng, 9))) for i in range(600)]
    rows += [(600, "a clean text about a grambler"), (601, "another clean one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0 and i < 600)) for i in range(602)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert "grumbler" in model["fuzzy"]
    asked = {"grumbler": True, "grimbler": True, "gumbler": True, "grumbbler": True, "g-umb": False, "rumble": False}
    tried = spark.createDataFrame([(w, " ".join(words(rng, 9) + [w] + words(rng, 9))) for w in asked], "doc_id string, text string")
    assert {r.doc_id: r.score > 0.5 for r in toxicity.score(tried, model).collect()} == asked


def test_training_rows_are_bounded_however_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 50)
    docs = spark.createDataFrame([(i % 3, f"text {i}", "x") for i in range(900)] + [(7, None, "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (7, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels)
    assert rows.count() == 50 and sorted(map(tuple, rows.collect())) == sorted(map(tuple, toxicity.training_rows(docs.repartition(5), labels).collect()))
    model = toxicity.train(docs, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())


def test_hits_equal_a_search_of_the_whole_lexicon(spark):
    """Each word against every term, by plain edit distance, as the automaton must find them; the score follows from these hits."""
    rng = random.Random(18)
    lexicon = {w: round(rng.uniform(1, 6), 3) for w in words(rng, 40)} | {"grum*": 2.5, "idiot": 4.0, "stupid": 5.0}
    scanner = toxicity.Scanner(lexicon)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    def weight(word):
        exact = [v for t, v in lexicon.items() if t == word or (t.endswith("*") and word.startswith(t[:-1]))]
        near = [0.7 * v for t, v in lexicon.items() if not t.endswith("*") and len(t) >= 5 and distance(t, word) <= 1]
        return max(exact + near, default=0.0)

    terms = [t.rstrip("*") for t in lexicon]
    for _ in range(60):
        own = words(rng, 12) + [t[:k] + rng.choice("xyzab") + t[k + rng.randrange(2) :] for t in rng.sample(terms, 6) for k in [rng.randrange(len(t))]]
        rng.shuffle(own)
        want = [(i, pytest.approx(weight(w))) for i, w in enumerate(own) if weight(w) > 0]
        assert [(i, w) for i, w, _ in scanner.hits(" ".join(own))[1]] == want
    long = "fine words " * 40_000 + "stup1d idi0t"
    assert len(scanner.hits(long)[1]) == 2 and scanner.features("")[7] == 0.0
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), {"name": "x", "share": 0.0}).count() == 0


def test_leaks_in_long_texts_and_repeated_rows(spark):
    rng = random.Random(19)
    items = [(i, " ".join(words(rng, 30))) for i in range(20)]
    long = " ".join([*words(rng, 60_000), items[4][1], *words(rng, 100)])
    docs = spark.createDataFrame([(1, long, "x"), (2, items[5][1], "x"), (2, items[5][1], "x"), (None, items[6][1], "x")], "doc_id long, text string, score string")
    table = spark.createDataFrame([*items, items[5]], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in leaks.find_leaks(docs, table).collect())
    assert got == [("1", 4)] + [("2", 5)] * 4 + [("None", 6)]
    assert leaks.without_leaks(docs, table).count() == 0


def test_mix_targets_and_bounds(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "b", "b", "b", "c", None]), " ".join(["w"] * rng.randrange(0, 60)), "x") for i in range(400)] + [(1000, "tiny", "one two", "x"), (1001, "a", None, "x"), (5, "a", "same id again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    got = mixing.mix(docs, blocks=300).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = {s: (n, t) for s, n, t in mixing.targets([(s, sizes[s]) for s in order])}
    assert sum(t for _, t in want.values()) == pytest.approx(sum(sizes.values()))
    taken, by_id = defaultdict(int), defaultdict(list)
    for i, s, t, _ in rows:
        by_id[i].append((s, len((t or "").split())))
    for r in got:
        assert r.taken <= 3 * r["size"]
        s = next(s for s, n in by_id[r.doc_id] if n == r["size"] and want[s] == (r.source_size, r.target))
        taken[s] += r.taken
    for s, (n, t) in want.items():
        assert taken[s] == int(t) and t <= 3 * n + 1e-9
    again = {(r.row, r.taken) for r in mixing.mix(docs, blocks=300).collect()}
    assert again == {(r.row, r.taken) for r in got}
    assert mixing.mix(docs.limit(0)).count() == 0
    copies = mixing.mixed(docs.drop("size"))
    assert copies.columns == ["doc_id", "source", "text"] and copies.count() > 0


def test_mixed_rows_stand_in_the_order_of_their_slots(spark):
    rng = random.Random(15)
    docs = spark.createDataFrame([(i, "abc"[i % 3 if i % 2 else 1], " ".join(["w"] * rng.randrange(1, 40))) for i in range(600)], "doc_id long, source string, text string")
    first = {r.doc_id: (r.first_slot, r.taken, r["size"]) for r in mixing.mix(docs, blocks=400).collect()}
    rows = mixing.mixed(docs, blocks=400).select("doc_id", "source", F.spark_partition_id().alias("part")).collect()  # collected by partition
    seen, order = set(), []
    for r in rows:
        if r.doc_id not in seen:
            seen.add(r.doc_id)
            order.append(first[r.doc_id][0])
    assert order == sorted(order) and seen == {i for i, (_, n, _) in first.items() if n} and len({r.part for r in rows}) > 1
    assert len(rows) == sum(-(-n // size) for _, n, size in first.values())
    words, early = defaultdict(int), rows[: len(rows) // 4]
    for r in early:  # the first quarter already stands near the weights 5 : 2 : 1
        words[r.source] += first[r.doc_id][2]
    whole = {s: t for s, _, t in mixing.targets(sorted((r.source, r.n) for r in docs.groupBy("source").agg(F.sum(mixing.words_of(F.col("text"))).alias("n")).collect()))}
    for s, t in whole.items():
        assert abs(words[s] / sum(words.values()) - t / sum(whole.values())) < 0.08


def test_mix_of_null_ids_and_long_blocks(spark):
    docs = spark.createDataFrame([(None, "a" if i % 2 else None, f"w{i} " * (i % 7 + 1)) for i in range(200)], "doc_id long, source string, text string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 200 and len({r.first_slot for r in rows if r.taken}) > 100
    assert mixing.mixed(docs).count() == sum(-(-r.taken // r["size"]) for r in rows)


def test_schedule_keeps_its_pace(spark):
    sources = [mixing.Source("a", 0, 0.0, 500), mixing.Source("b", 0, 0.0, 200), mixing.Source("c", 0, 0.0, 3)]
    rows = mixing.schedule(spark, sources).orderBy("slot").collect()
    assert len(rows) == 703
    for no, s in enumerate(sources):
        ranks = [r["rank"] for r in rows if r.source_no == no]
        assert ranks == list(range(s.quota))
    half = sum(r.source_no == 0 for r in rows[:200])
    assert abs(half - 200 * 500 / 703) < 6


def test_pipeline_against_its_parts(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_store"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, at = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in at.select("doc_id", "text").collect()]
            assert kept == set(brute_classes(rows).values())
        at = out.cache()
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() == at.count()


def test_members_of_large_keys_meet_their_hub_in_one_join(spark, monkeypatch):
    plans, write = {}, neardup.Scratch.write

    def told(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, df, name)

    monkeypatch.setattr(neardup.Scratch, "write", told)
    same = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(i, f"{same} tail{i}") for i in range(30)], "doc_id long, text string")
    assert {r.class_id for r in neardup.classes(docs).collect()} == {0}
    joined = [name for name in ("met", "pairs", "placed") if re.search(r"Join Inner, \(key#\d+L? = key#", plans.get(name, ""))]
    assert joined == ["met"] and {"met", "placed"} <= set(plans)


def test_members_of_large_keys_go_through_joins_in_chunks(spark, monkeypatch):
    rows, write = {}, neardup.Scratch.write

    def told(self, df, name):
        out = write(self, df, name)
        if name in ("hubs", "met"):
            rows[name] = out.count()
        return out

    monkeypatch.setattr(neardup.Scratch, "write", told)
    same = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(i, f"{same} tail{i}") for i in range(30)], "doc_id long, text string")
    assert {r.class_id for r in neardup.classes(docs).collect()} == {0}
    assert rows["met"] == rows["hubs"] > 0  # 30 members of each key are one row of its join
    members = spark.range(1000).select(F.lit(1).alias("key"), "id", F.lit(1000).alias("size"), F.lit(7).alias("component"), (F.col("id") < 3).alias("query"))
    counted = neardup._with_counts(members).collect()
    assert sorted(r.id for r in counted) == list(range(1000)) and {(r.key, r.size, r.queries, r.component) for r in counted} == {(1, 1000, 3, 7)}
    assert sorted(r.id for r in counted if r.query) == [0, 1, 2] and neardup._chunks(members).count() == 4
