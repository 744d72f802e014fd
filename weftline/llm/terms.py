"""Terms of whole texts by a translate table: one pass lowers A-Z and blanks the separators, ``bytes.split`` cuts the rest.

On UTF-8 a byte from 0x80 belongs to a character beyond ASCII, so runs of the bytes that are kept equal the runs of code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that are cut at once.
SLICE = 1 << 20


def table(kept: str = "") -> bytes:
    """The translate table that keeps letters, the ASCII characters in ``kept`` and all bytes from 0x80, with A-Z lowered and the rest blank."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in range(ord("a"), ord("z") + 1):
        out[c] = out[c - 32] = c
    for c in kept.encode("ascii"):
        out[c] = c
    return bytes(out)


#: Runs of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]``.
LETTERS = table()
#: Runs of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]``.
LETTERS_AND_DIGITS = table("0123456789")


def slices(raw: bytes | None, how: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a text in order, slice by slice, so that a very long text never lies in memory as a list of all its terms. Null has none."""
    if not raw:
        return
    at, end = 0, len(raw)
    while at < end:
        to, step = min(at + size, end), size
        clean = raw[at:to].translate(how)
        while to < end and b" " not in clean:  # one term longer than the slice
            step *= 2
            to = min(to + step, end)
            clean = raw[at:to].translate(how)
        cut = len(clean) if to == end else clean.rindex(b" ") + 1
        yield clean[:cut].split()
        at += cut


def raw_texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """The UTF-8 of each row of a string column."""
    for value in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()):
        yield value.as_py()


def strings(found: list[bytes]) -> pa.Array:
    """Terms as an Arrow string column; nothing is decoded."""
    return pa.array(found, pa.binary()).view(pa.string())
