import math
import random
import re

from weftline.llm import lexical_search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    docs = [(d, cut(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        asked = [t for text in {x for i, x in items if i == item} for t in cut(text)]
        df = {t: sum(t in w for _, w in docs) for t in set(asked)}
        scored = []
        for d, w in docs:
            if w and d is not None:
                m = 25 + 75 * len(w) * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in asked if t in w)
                scored += [(-score, d)] if score > 0 else []
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éa", "ABC", "abc", "x9", "日本", "ß"]
    text = lambda n: rng.choice([" ", ", ", "\n", "\x00_"]).join(rng.choice(words[: rng.choice([5, 30, len(words)])]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 3, 8, 40, 40, 200]))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(120)] + [(7, docs[7][1]), (None, "w1 w2"), (2000, None), (2001, ""), (2002, " .;_ "), (2003, "w3 " * 40_000)]
    rng.shuffle(docs)
    items = [(i, text(rng.randint(0, 12))) for i in range(30)] + [(3, "w1 w1 w9"), (40, None), (41, "nowhere"), (42, ""), (None, "w1")]
    items += items[:4]
    want = brute(docs, items)
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id bigint, text string, n int, term string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    for each, rows_each in ((8192, 400_000), (16, 40)):
        got = lexical_search.search(docs, items, docs_each=each, rows_each=rows_each)
        assert sorted(map(tuple, got.collect())) == want
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_slices_equal_the_whole():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "é", "7", " ", "-", "\x85", "字", "\x00"]) for _ in range(rng.randint(0, 60)))
        for size in (1, 2, 7, 1 << 20):
            assert [w.decode() for s in terms.slices(text.encode(), terms.LETTERS_AND_DIGITS, size) for w in s] == cut(text)


def test_strata_that_cannot_win_are_skipped(monkeypatch):
    import numpy as np

    m = np.repeat(np.arange(26, 126), 300)
    n = len(m)
    tf = np.where(np.arange(n) < 300, 5, 1)
    part = lexical_search.Part(np.arange(n), m, np.ones(n, int), np.zeros(n, int), tf, 1)
    seen, ranges = [], lexical_search._ranges
    monkeypatch.setattr(lexical_search, "_ranges", lambda a, b: seen.append(b.sum()) or ranges(a, b))
    best, _ = part.best(np.array([0]), np.array([3]), 10)
    assert part.doc[best].tolist() == list(range(10)) and sum(seen[1:]) == 300
