import random

import numpy as np
import xxhash

from weftline.llm import simhash


def brute(texts, k=3):
    out = {}
    for i, t in texts:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        grams = [" ".join(words[j : j + k]) for j in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        out[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out


def closure(prints, budget=2):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= budget:
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints_and_links_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["Alpha", "beta", "Ünï", "x", "gamma", "delta", "eps", "zeta", "eta"]
    texts = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one TWO"), (5, "É é"), (6, "É é")]
    for i in range(7, 150):
        base = rng.choice(texts)[1] if rng.random() < 0.5 else None
        t = (base or " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))).split(" ")
        if base and rng.random() < 0.6:
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append((i, rng.choice([" ", " ", "\n"]).join(t)))
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id bigint, text string, fp string")
    want = brute(texts)
    groups = closure(want)
    for size in (1000, 4):  # with and without splitting of groups
        got = simhash.link(simhash.fingerprints(df), group=size).collect()
        assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == want
        assert {r.doc_id: r.component_id for r in got} == groups


def test_dense_ball_of_fingerprints(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {i: centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5]))) for i in range(400)}
    prints |= {i: rng.getrandbits(64) for i in range(400, 500)}
    rows = [(i, int(np.uint64(v).view(np.int64))) for i, v in prints.items()] + [(None, 5), (3, int(np.uint64(prints[3]).view(np.int64)))]
    df = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    for size in (1000, 20):
        got = [r for r in simhash.link(df, group=size).collect()]
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == closure(prints)
        assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_empty(spark):
    assert simhash.link(simhash.fingerprints(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0


def family(rng, n, true_pairs):
    """n texts that are alike at 0.77 to 0.79 by five-word shingles, and for so many of them one more that is alike at 0.82."""
    q = 13  # each text changes a word in q columns of q places, along a parabola of its own: two have two changes in common at most
    base = [f"w{rng.randrange(10**6)}" for _ in range(6 * q * q + 10)]

    def change(words, places):
        out = list(words)
        for p in places:
            out[5 + 6 * p] = f"x{rng.randrange(10**9)}"
        return out

    chosen = [{q * c + (k + k // q * c + k // q**2 * c * c) % q for c in range(q)} for k in rng.sample(range(q**3), n)]
    texts = [change(base, sorted(c)) for c in chosen]
    texts += [change(t, rng.sample(sorted(set(range(q * q)) - c), 20)) for t, c in zip(texts[:true_pairs], chosen)]
    return [" ".join(t) for t in texts]


def test_candidates_in_a_family_just_below_the_similarity(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PRINTS", 2)
    texts = family(random.Random(4), 300, 100)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    fps = {r.doc_id: [x & (2**64 - 1) for x in r.fps] for r in simhash.fingerprints(df, shingle=5, tables=2).collect()}
    halves = lambda i: [h for x in fps[i] for h in (x >> 32, x & 0xFFFFFFFF)]
    bits = lambda i, j: [(x ^ y).bit_count() for x, y in zip(halves(i), halves(j))]
    want = {300 + k: k for k in range(100) if min(bits(k, 300 + k)) <= simhash.TABLE_BUDGET and sum(bits(k, 300 + k)) <= simhash.NEAR}
    got = {r.node: r.component for r in simhash.near_duplicates(df).collect()}
    assert len(want) > 40 and got == want, (len(got), len(want))


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(200_000)]
    other = words[:100_000] + ["x"] + words[100_001:]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "short"), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.link(simhash.fingerprints(df)).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3 and got[4] == 4
