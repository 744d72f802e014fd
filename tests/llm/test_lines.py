import random

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import line_dedup, packing


def brute(docs):
    lines = []
    for d, t in sorted((d, t) for d, t in docs if d is not None):
        for n, line in enumerate((t or "").split("\n")):
            lines.append((d, n, set(line.encode().split())))
    gone = {}
    for k, (d, n, a) in enumerate(lines):
        if a and any(5 * len(a & b) >= 4 * len(a | b) for _, _, b in lines[:k] if b):
            gone.setdefault(d, []).append(n)
    return gone


@pytest.mark.parametrize("each, hot", [(100_000, 8_192), (300, 20), (100_000, 3)])
def test_equals_brute_force(spark, each, hot):
    rng = random.Random(7)
    common = ["the", "of", "and", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(400)}"
    pool = [[word() for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 10, 12, 25, 40]))] for _ in range(40)]
    docs = [(0, None), (1, ""), (2, "\n\n \n"), (3, "the\nthe\nof the\nthe of")]
    for d in range(4, 90):
        out = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(pool)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 20))]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                line[rng.randrange(len(line))] = word()
            rng.shuffle(line)
            out.append(" ".join(line))
        docs.append((d * 7, "\n".join(out)))
    rng.shuffle(docs)
    want = brute(docs)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs] + [(None, "the\nthe", "x")], "doc_id bigint, text string, line string")
    got = line_dedup.dedup(df, words_each=each, hot=hot).collect()
    assert {r.doc_id: list(r.removed) for r in got if r.removed} == want
    texts = dict(docs) | {None: "the\nthe"}
    for r in got:
        assert r.text == "\n".join(x for n, x in enumerate((texts[r.doc_id] or "").split("\n")) if n not in r.removed)


def test_empty(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("parts", [1, 2])
def test_repeated_rows_are_one_document(spark, parts):
    docs = [(1, "one two three\nfour five six"), (1, "one two three\nfour five six"), (2, "four five six\nseven eight nine"), (2, "four five six\nseven eight nine")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup(df).collect())
    assert got == [(1, docs[0][1])] * 2 + [(2, "seven eight nine")] * 2


def test_very_long_lines_and_large_keys(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(5, long), (-(2**60), f"{long} end"), (2**61, f"x y\n{' '.join(reversed(long.split()))}"), (7, "x  y"), (2**62, "y x")]
    want = brute(docs)
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: list(r.removed) for r in got if r.removed} == want


def test_entries_of_wanted_lists_are_those_of_all_filtered():
    """What the second reading keeps is decided before parities and digests are made, and nothing changes by it."""
    import numpy as np
    import pyarrow as pa

    from weftline.llm import line_dedup, textnp

    texts = ["\n".join(" ".join(f"w{(i * j + k * k) % 41}" for k in range(1 + (i + j) % 90)) for j in range(9)) for i in range(30)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(30)), "text": texts})
    (chunk,) = textnp.chunks(iter([batch]), "text")
    lines = line_dedup.Lines(chunk, np.arange(30))
    rest = (np.ones(len(lines.row), bool), np.full(1 << line_dedup.BITS, 40, np.uint8), 4, 5, 8)
    line, values = line_dedup._entries(lines, *rest)
    number_of = lambda name: (name >> np.uint64(8)).astype(np.int64)
    for wanted in (np.unique(number_of(values["list"]))[::7], np.array([-5])):
        ok = np.isin(number_of(values["list"]), wanted)
        some, own = line_dedup._entries(lines, *rest, line_dedup._among(wanted, number_of))
        assert (some == line[ok]).all() and all(np.array_equal(own[n], values[n][ok]) for n in values)


def test_entries_of_chunks_are_packed_together(spark, monkeypatch):
    """A row of packed entries costs much, so the chunks of a task share rows; a key whose rows are in two chunks keeps its lines apart."""
    packs, own = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda bucket, *a, **k: packs.append(len(bucket)) or own(bucket, *a, **k))
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 9, 40)
    key, pos = np.repeat(np.arange(40) // 2 % 15, sizes), np.concatenate([np.sort(rng.choice(50, n, False)) for n in sizes])
    bucket = rng.integers(0, 4, len(key))
    got = packing.unpack(pa.Table.from_batches([packing.pack(bucket, key, pos, in_order=True, v=np.arange(len(key), dtype=np.uint32))]), v=np.uint32)
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(key.tolist(), pos.tolist(), range(len(key))))
    # the function that indexes, as Spark gets it
    indexed, frame = [], type(spark.range(1))
    mapped = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, schema, *a, **k: indexed.append(f) or mapped(df, f, schema, *a, **k))
    texts = [" ".join(f"w{rng.integers(0, 60)}" for _ in range(9)) for _ in range(400)]
    line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).count()
    index = next(f for f in indexed if f.__qualname__.endswith("index.<locals>.run"))
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(400), pa.int64()), "text": texts})
    monkeypatch.setattr("weftline.llm.textnp.CHUNK_BYTES", 500)
    packs.clear()
    few = pa.Table.from_batches(list(index(iter([batch]))))
    assert len(packs) <= 2 and len(few) <= 32
    assert len(packing.unpack(few, {"wide": 8}, **line_dedup.ENTRY)[0]) == sum(packs) > 400
