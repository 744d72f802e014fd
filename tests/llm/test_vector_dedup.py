import numpy as np
import pytest

from weftline.llm import vector_dedup


def brute(rows, least=0.95):
    ids, links = [i for i, _ in rows], {}
    for i, x in rows:
        for j, y in rows:
            if i < j and x is not None and y is not None and len(x) == len(y) and all(v is not None and np.isfinite(v) for v in [*x, *y]) and any(x) and any(y):
                a, b = np.array(x, float), np.array(y, float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links.setdefault(i, set()).add(j)
                    links.setdefault(j, set()).add(i)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out[i] = (len(links.get(i, ())), min(seen), i == min(seen))
    return out


def made(seed=4, d=8):
    """Groups of copies of all sizes, chains of vectors just within reach, one group with a third of all rows, and noise."""
    rng = np.random.default_rng(seed)
    unit = lambda: (lambda x: x / np.linalg.norm(x))(rng.normal(size=d))
    out = [unit() for _ in range(250)]
    for size, spread in ((300, 0.05), (40, 0.1), (12, 0.12), (2, 0.05), (2, 0.1), (30, 0.2)):
        base = unit()
        out += [base + spread * rng.normal(size=d) / np.sqrt(d) * 2 for _ in range(size)]
    base, side = unit(), unit()
    out += [np.cos(t) * base + np.sin(t) * side for t in np.arange(0, 3, 0.2)]  # a chain over many cells
    out += [out[300], 3 * out[300]]
    return [np.float32(x).tolist() for x in out]


@pytest.mark.parametrize("cell_rows,block", [(2000, 4096), (40, 64), (300, 20)])
def test_equals_brute_force(spark, cell_rows, block):
    rows = list(enumerate(made()))
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] * 4), (2003, [float("nan")] * 8), (2004, [float("inf")] + [1.0] * 7), (2005, []), (2006, [1.0, 0.5, 0.2]), (2007, [2.0, 1.0, 0.4]), (2008, [1e-30] * 8), (2009, [1e30] * 8)]
    want = brute(rows)
    df = spark.createDataFrame([(i, x, 0, "c") for i, x in rows + rows[5:9]], "vec_id bigint, embedding array<float>, cell int, home string").repartition(6)
    got = vector_dedup.link(df, cell_rows=cell_rows, block=block).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in got} == want
    assert sum(n for n, _, _ in want.values()) > 50_000


def test_null_keys_doubles_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [1e200, 0.0]), (2, [1e-200, 0.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = sorted((r.id or 0, r.n_links, r.component_id, r.kept) for r in vector_dedup.link(df).collect())
    assert got == [(0, 0, None, True), (0, 0, None, True), (2, 1, 2, True), (3, 0, 3, True), (4, 1, 2, False)]
    assert sorted((r.vec_id or 0) for r in vector_dedup.dedup(df).collect()) == [0, 0, 2, 3]
    assert vector_dedup.link(df.limit(0)).count() == 0


def test_recall_of_a_narrow_margin(spark):
    rows = list(enumerate(made(9)))
    want = sum(n for n, _, _ in brute(rows).values())
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = vector_dedup.link(df, cell_rows=40, block=64, margin=0.05).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * want <= got <= want


def test_a_tight_group_is_not_multiplied(spark, monkeypatch):
    """All rows of the core are linked by the triangle inequality: what is sent grows with the group, not with its square."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.02 * rng.normal(size=16)).tolist()) for i in range(600)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = vector_dedup.link(df, cell_rows=400, block=50)
    assert [tuple(r) for r in got.where("id < 600").select("n_links", "component_id").distinct().collect()] == [(599, 0)]
