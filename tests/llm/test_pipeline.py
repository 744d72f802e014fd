"""Each stage against brute force on its own input, on the smallest tables."""

import re
from hashlib import sha256

from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_lines import brute as brute_lines
from weftline.llm import bpe, quality, simhash

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(cp.STAGES) <= 5
    seen = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(cp.STAGES) - 1:
            assert docs.columns == cp.COLUMNS and dict(docs.dtypes) == dict(before.dtypes)
        a, b = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()}
        assert set(b) <= set(a) and len(b) == docs.count() and b
        seen.append(name)
        if k == 0:
            model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(b) == {r.doc_id for r in quality.judge(before, model).collect() if r.kept}
        if k == 1:
            gone = brute_lines([(i, r.text) for i, r in a.items()])
            left = {i: "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone.get(i, ())) for i, r in a.items()}
            assert {i: r.text for i, r in b.items()} == {i: t for i, t in left.items() if t.split()}
            assert all(r.n_chars == len(r.text) for r in b.values())
        if k == 2:
            sets = {i: shingles(r.text) for i, r in a.items()}
            for i in set(a) - set(b):
                assert any(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in a)
            for i in b:
                assert not any(j < i and len(sets[i] & sets[j]) >= 0.9 * len(sets[i] | sets[j]) for j in b)
        if k == 3:
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            fold = lambda t: re.sub(r"[0-9]+(?:[.,:/][0-9]+)*%?", "0", t.lower()).split()
            grams = {tuple(w[i : i + 8]) for w in map(fold, items) for i in range(len(w) - 7)}
            for i, r in a.items():
                text = " ".join(r.text.split())
                if any(" ".join(t.split()) in text for t in items):
                    assert i not in b
                w = fold(r.text)
                names = re.sub(r"[A-ZÀ-Þ]\w*", "X", r.text)
                if not grams & {tuple(w[j : j + 8]) for j in range(len(w) - 7)} and names == r.text:
                    assert i in b
            assert all(b[i].text == a[i].text for i in b)
        if k == 4:
            library = Tokenizer.from_file(bpe.public_path("byte_bpe_50k.json"))
            for i, r in a.items():
                ids = library.encode(r.text, add_special_tokens=False).ids
                decoded = library.decode(ids, skip_special_tokens=False)
                assert (b[i].n_tokens, b[i].ids_sha256, b[i].decoded_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest())
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert cp.run(spark, SF, f"{tmp_path}/run").count() == docs.count()


def test_nulls_repeated_rows_and_empty_tables(spark, tmp_path):
    text = " ".join(f"word{i} other{i}" for i in range(30))
    other = " ".join(f"more{i} text{i}" for i in range(40))
    rows = [(1, text, None, "s", 5), (1, text, None, "s", 5), (None, other, "en", None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (9, text, "en", "s", 5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for given, want in ((rows, [(1, "s"), (1, "s"), (None, None)]), ([], [])):
        docs = spark.createDataFrame(given, schema)
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, SF)
            out.write.parquet(f"{tmp_path}/{len(given)}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{len(given)}/{k}")
            if k == 3:
                assert sorted(((r.doc_id, r.source) for r in docs.collect()), key=str) == sorted(want, key=str)
        assert docs.count() == len(want)


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    index, want = {}, {}
    for i in sorted(sets):
        near = {j for s in sets[i] for j in index.get(s, ())}
        want[i] = [j for j in near if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, near in want.items():
        for j in near:
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    expected = {i for i in sets if root(i) != i}
    got = {r.node for r in simhash.near_duplicates(docs).collect()}
    assert len(got & expected) >= 0.9 * len(expected), (len(got), len(expected))
    assert len(got - expected) <= 0.01 * len(sets)
