"""Entries (bucket, row key, position, values) packed into one row for each bucket and batch.

A shuffle of single words or windows costs more in row headers than in content. Here a task sorts its entries by bucket
and sends, per bucket, a few binary columns: the row keys that occur, the number of entries of each, the gaps between
their positions, and the values. Byte planes let the shuffle's compression remove the empty bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.llm import textnp

_FOLDS = (7, 15, 29, 43)


def home(key: Column, buckets: int) -> Column:
    """Bucket (a power of two many) of a row key; ``home_of`` is the same on numpy arrays."""
    out = key
    for n in _FOLDS:
        out = out.bitwiseXOR(F.shiftrightunsigned(key, n))
    return out.bitwiseAND(F.lit(buckets - 1).cast("bigint")).cast("int")


def home_of(key: np.ndarray, buckets: int) -> np.ndarray:
    k = key.astype(np.int64).view(np.uint64)
    out = k.copy()
    for n in _FOLDS:
        out ^= k >> np.uint64(n)
    return (out & np.uint64(buckets - 1)).astype(np.int64)


def schema(*names: str) -> str:
    return ", ".join(["bucket int", *(f"{n} binary" for n in ("ids", "counts", "gaps", *names))])


def pack(bucket: np.ndarray, key: np.ndarray, pos: np.ndarray, in_order: bool = False, **values: np.ndarray) -> pa.RecordBatch:
    """One row per bucket. in_order: the entries are sorted by (key, pos) already, or are several such runs; a key of two runs is packed twice."""
    names = ["bucket", "ids", "counts", "gaps", *values]
    types = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    if not len(bucket):
        return pa.RecordBatch.from_arrays([pa.array([], type=t) for t in types], names=names)
    small = bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket
    order = np.argsort(small, kind="stable") if in_order else np.lexsort((pos, key, small))
    key, pos, bucket = key[order].astype(np.int64), pos[order].astype(np.int64), bucket[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1]) | (pos[1:] < pos[:-1])])
    gaps = pos.copy()
    gaps[1:] -= np.where(new[1:], 0, pos[:-1])
    gaps = gaps.astype(np.uint32)
    sorted_values = {n: v[order] for n, v in values.items()}
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(key))).astype(np.uint32)
    out: list[list] = [[] for _ in names]
    ids = key[heads]
    starts, lengths = textnp.runs(bucket)
    firsts = np.searchsorted(heads, starts)
    steps = np.diff(ids, prepend=ids[:1])
    steps[firsts] = ids[firsts]
    for a, n, x, y in zip(starts.tolist(), lengths.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(heads)]):
        row = [int(bucket[a]), textnp.planes(steps[x:y]), textnp.planes(sizes[x:y]), textnp.planes(gaps[a : a + n]), *(textnp.planes(v[a : a + n]) for v in sorted_values.values())]
        for column, cell in zip(out, row):
            column.append(cell)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], names=names)


def unpack(table: pa.Table, widths: dict[str, int] | None = None, **dtypes) -> tuple[np.ndarray, ...]:
    """(key, pos, *values) of all rows of the table; positions of a row key ascend within each packed row.

    widths: of some columns, of whose rows each has up to so many values in its entries, the width; zeros fill it up.
    """
    wide = widths or {}
    parts: list[list[np.ndarray]] = [[] for _ in range(2 + len(dtypes))]
    for row in table.to_pylist():
        ids, counts, gaps = np.cumsum(textnp.unplanes(row["ids"], np.int64)), textnp.unplanes(row["counts"], np.uint32).astype(np.int64), textnp.unplanes(row["gaps"], np.uint32).astype(np.int64)
        total = np.cumsum(gaps)
        heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
        parts[0].append(np.repeat(ids, counts))
        parts[1].append(total - np.repeat(total[heads] - gaps[heads], counts))
        for k, (name, dtype) in enumerate(dtypes.items()):
            if name in wide:
                full = np.zeros((len(gaps), wide[name]), dtype=dtype)
                if row[name]:
                    some = np.frombuffer(row[name], dtype=np.uint8).reshape(-1, len(gaps)).T
                    some = np.ascontiguousarray(some).view(dtype)
                    full[:, : some.shape[1]] = some
                parts[2 + k].append(full)
            else:
                parts[2 + k].append(textnp.unplanes(row[name], dtype))
    empty = [(0, np.int64), (0, np.int64), *(((0, wide[n]) if n in wide else 0, t) for n, t in dtypes.items())]
    return tuple(np.concatenate(p) if p else np.zeros(n, dtype=t) for p, (n, t) in zip(parts, empty))
