import random
import re

import numpy as np

from weftline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def brute_scores(texts, target, bits):
    """Mean log ratio by counting n-grams as strings; right where no two n-grams of the fixture share a bin."""
    grams = lambda t: [(w,) for w in t] + list(zip(t, t[1:]))
    split = [WORD.findall(t or "") for t in texts]
    raw, good = {}, {}
    for k, t in enumerate(split):
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            if target[k]:
                good[g] = good.get(g, 0) + 1
    a, size = quality.ALPHA, 1 << bits
    n, m = sum(raw.values()), sum(good.values())
    score = lambda g: np.log((good.get(g, 0) + a) / (m + a * size)) - np.log((raw[g] + a) / (n + a * size))
    return [float(np.mean([score(g) for g in grams(t)])) if t else 0.0 for t in split]


def test_base_counts_scores_and_threshold(spark):
    rng = random.Random(2)
    good, bad = [f"word{i}" for i in range(30)], [f"junk{i}###" for i in range(20)]
    texts = [None, "", " \n\t", "a b c d e " * 9, "x\nx\n\nx\n", "é ü|<> ß", "w " * 9, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"]
    for k in range(60):
        texts.append(rng.choice([" ", "\n", "  "]).join(rng.choice(bad if k % 5 == 0 else good) for _ in range(rng.randint(3, 40))))
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id bigint, text string, kept boolean")
    labels = [(i, 0 if (i - 8) % 5 == 0 else 1, 0) for i in range(8, 60)] + [(9, 1, 0), (10, None, None), (None, 1, 0), (999, 1, 0)]
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), bits=22)
    target = [8 <= i < 60 and (i - 8) % 5 != 0 for i in range(len(texts))]
    want = brute_scores(texts, target, 22)
    got = sorted(quality.judge(df, model).collect())
    for r, t, s in zip(got, texts, want):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), (t, r)
        assert abs(r.score - s) < 1e-9
        assert r.kept == (not r.base_failed and r.score >= model.threshold)
    assert all(r.kept != ((r.doc_id - 8) % 5 == 0) for r in got if r.doc_id >= 8 and not r.base_failed)
    kept = quality.keep(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [r.doc_id for r in got if r.kept]


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    held = quality.judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in held]) > 0.95


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (1, "one two three four five six seven eight nine ten"), (2, "short")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.fit(df, none)
    assert model.threshold is None and [r.kept for r in sorted(quality.judge(df, model).collect())] == [True, True, False]
    assert quality.judge(df.limit(0), quality.fit(df.limit(0), none)).count() == 0


def test_toxic_documents_are_bad_ones_in_the_threshold(spark):
    rng = random.Random(5)
    words = lambda stem: " ".join(f"{stem}{rng.randrange(30)}" for _ in range(30))
    docs = [(i, words("nasty" if i % 5 == 0 else "word")) for i in range(200)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert {r.doc_id for r in quality.judge(df, model).collect() if not r.kept} == {i for i in range(200) if i % 5 == 0}


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, long), (2, f"{long} w0 w1 w2 w3 w4"), (3, None)], "doc_id bigint, text string")
    model = quality.fit(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.kept) for r in quality.judge(df, model).collect()}
    assert got == {1: (300_000, 0, True), 2: (300_005, 10, True), 3: (0, 0, False)}
