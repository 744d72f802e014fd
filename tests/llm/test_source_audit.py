import random
import re
from collections import Counter

from weftline.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=3, most=200):
    docs = [(lang or "", source or "", Counter(t.translate(LOWER) for t in TERM.findall(text or ""))) for text, lang, source in docs]
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for lang in {d[0] for d in docs}:
        df, groups = Counter(), {}
        for a, source, n in docs:
            if a == lang:
                df.update(n.keys())
                groups.setdefault(source, Counter()).update(n)
        kept = [t for t in df if df[t] >= least]
        total = sum((Counter({t: n[t] for t in kept}) for n in groups.values()), Counter())

        def shares(n):
            size = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 1) // (size + len(kept)) for t in kept}

        whole, own = shares(total), {s: shares(n) for s, n in groups.items()}
        for s, p in own.items():
            pairs = [(o, sum(f(p[t], q[t]) for t in kept)) for o, q in own.items() if o != s]
            found = [(t, f(p[t], whole[t])) for t in kept if groups[s][t] and p[t] > whole[t]]
            for part, rows in (("pair", pairs), ("term", found)):
                rows.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (item, v) in enumerate(rows) if part == "pair" or r < most]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Éa", "éa", "ABC", "abc", "日本", "ß", "d'un"]
    docs = []
    for _ in range(500):
        lang = rng.choice(["en", "en", "de", None, "lone"])
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", "S2", "é", None, ""]) if lang != "lone" else "only"
        docs.append((rng.choice([" ", "\x00", "7-", "\n"]).join(rng.choice(words[: rng.choice([10, len(words)])]) for _ in range(rng.choice([0, 1, 5, 60]))), lang, source))
    docs += [docs[0]] * 30 + [(None, "en", "silent"), ("", "xx", "a"), ("once", "xx", "b"), ("twice twice twice", "xx", "c"), ("ABC " * 50_000, "en", "s1")]
    want = brute(docs)
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "text string, lang string, source string, n int, term int").repartition(5)
    for how in ({}, {"bucket_rows": 100, "block_sources": 2}):
        got = source_audit.audit(df, **how)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == want


def test_few_terms_held_and_the_first_ranks(spark):
    docs = [(f"a b c d{chr(97 + i % 20)} e{chr(97 + i % 7)}", "en", f"s{i % 3}") for i in range(120)]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(map(tuple, source_audit.audit(df, most_terms=3).collect())) == brute(docs, most=3)
    sums = source_audit.count_terms(df, held=2).groupBy("lang", "source", "term").sum("n", "docs")
    assert sums.collect() and sorted(map(tuple, sums.collect())) == sorted(map(tuple, source_audit.count_terms(df).groupBy("lang", "source", "term").sum("n", "docs").collect()))


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert source_audit.audit(df).count() == 0
    one = spark.createDataFrame([(None, None, None), ("x x", "", "b")], df.schema)
    assert sorted(map(tuple, source_audit.audit(one).collect())) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]
