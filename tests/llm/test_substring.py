import random

from weftline.llm import substring_dedup


def brute(docs, w=20):
    seen, out = {}, {}
    words = {d: (t or "").split() for d, t in docs}
    for d in sorted(words):
        for s in range(len(words[d]) - w + 1):
            seen.setdefault(tuple(words[d][s : s + w]), (d, s))
    for d, t in words.items():
        gone = set()
        for s in range(len(t) - w + 1):
            if seen[tuple(t[s : s + w])] != (d, s):
                gone.update(range(s, s + w))
        out[d] = (len(t), len(gone), " ".join(x for i, x in enumerate(t) if i not in gone))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}é" if rng.random() < 0.7 else rng.choice(["a", "the"]) for _ in range(n)]
    passages = [fresh(rng.choice([12, 19, 20, 21, 35, 60])) for _ in range(12)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "a " * 70), (4, "a " * 19), (5, "a b " * 30), (6, "x\ty\x0bz")]
    for d in range(7, 160):
        t = []
        for _ in range(rng.randint(1, 5)):
            t += fresh(rng.randint(0, 40))
            if rng.random() < 0.6:
                t += rng.choice(passages)
        docs.append((d * 3, rng.choice([" ", "\n", "  "]).join(t)))
    docs += [(1000, docs[20][1]), (900, docs[20][1])]
    rng.shuffle(docs)
    want = brute(docs)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, bucket int")
    for each in (14_000_000, 500):
        got = {r.doc_id: r for r in substring_dedup.repeats(df, bytes_each=each).collect()}
        assert {d: (r.n_words, r.n_removed, r.text) for d, r in got.items()} == want
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got.values())


def test_repeated_rows_null_keys_and_empty(spark):
    long = " ".join(f"t{i}" for i in range(50))
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.repeats(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 50)]
    assert substring_dedup.repeats(df.limit(0)).count() == 0
