"""Byte-level BPE encoding and decoding by tree concatenation.

Method. A text longer than ``segment`` code points is cut into leaves by halving; Spark encodes the leaves in
parallel. Neighbouring results are then concatenated pairwise up the tree: around a join, a window of the last
pieces of the left side and the first pieces of the right side is encoded again, and grows until its piece borders
agree with a border that each side already has. The same holds one level below for one long unsplit piece (a word of
thousands of letters): its halves are encoded alone, and a window of tokens around the join is encoded again and
doubled until the tokens at both seams are what the merges give for the two together. A sequence in which every
neighbouring pair of tokens encodes to itself is the encoding of the whole, so agreement is exact.

Defined cases: a null text counts as empty and gives no ids; repeated rows give repeated results; only the named
columns are read, so extra columns cannot clash; a null id column is kept as it is; an empty table gives an empty table.
The tokenizer file's truncation and padding are not used and no special tokens are added, but the strings of the file's
own special tokens become their ids when they occur in a text, as the tokenizers library does.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Longest text, in code points, that one row encodes in one go.
SEGMENT = 65_536
#: Longest piece, in bytes, that the library encodes without halving.
LEAF = 512
#: No decision about a piece looks further ahead than a special token or a contraction.
REACH = 64
#: Pieces kept in each of the two generations of a worker's cache.
CACHE = 50_000

# The pattern of byte-level vocabularies for texts of Latin letters alone, where its classes are short; other texts are left to the library.
_L, _N, _S = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_PLAIN = re.compile(r"[\x00-\u024f\u2010-\u2027]*")
_PIECES = re.compile(rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(extra)) for b in range(256)]


class Codec(dict):
    """Pieces of text to their ids; the dictionary itself is the bounded cache of pieces already met."""

    def __init__(self, path: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.letters = _byte_letters()
        of = {c: b for b, c in enumerate(self.letters)}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = [b""] * (max(self.library.get_vocab(True).values()) + 1)
        for word, i in self.library.get_vocab(True).items():
            self.bytes[i] = word.encode() if word in self.special else bytes(of[c] for c in word)
        self.older: dict[str, tuple[int, ...]] = {}
        self.ranks = self._by_rank(json.loads(self.library.to_str())["model"])

    def _by_rank(self, model: dict) -> tiktoken.Encoding | None:
        """A quicker merger for vocabularies whose ids are the order of their merges; None for others."""
        if any(model["vocab"].get("".join(pair)) != 256 + k for k, pair in enumerate(model["merges"])) or model["ignore_merges"] or {*range(256)} - {model["vocab"].get(c) for c in self.letters}:
            return None
        ranks = {raw: i for i, raw in enumerate(self.bytes) if i < 256 + len(model["merges"])}
        return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def pieces(self, text: str) -> list[str]:
        """The pieces within which merges happen, in order; together they are the text."""
        if self.split is not None and any(s in text for s in self.special):
            return [p for part in self.split.split(text) if part for p in ([part] if part in self.special else self._scan(part))]
        return self._scan(text)

    def _scan(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or ((self.special[piece],) if piece in self.special else tuple(self.tree(piece.encode())))
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a short run of bytes within one piece."""
        if self.ranks is not None:
            return self.ranks._core_bpe.encode_single_piece(raw)
        return [t.id for t in self.library.model.tokenize("".join(map(self.letters.__getitem__, raw)))]

    def tree(self, raw: bytes) -> list[int]:
        """Ids of one piece; long ones by halves."""
        if len(raw) <= LEAF:
            return self.merge(raw)
        return self.join(self.tree(raw[: len(raw) // 2]), self.tree(raw[len(raw) // 2 :]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of what left and right encode, both within one piece."""
        w = 2
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            raw = b"".join(self.bytes[i] for i in left[a:] + right[:b])
            middle = self.merge(raw)
            if (a == 0 or self.fits(left[a - 1], middle[0])) and (b == len(right) or self.fits(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            w *= 2

    def fits(self, x: int, y: int) -> bool:
        return self.merge(self.bytes[x] + self.bytes[y]) == [x, y]

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.__getitem__, self.pieces(text))))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def concatenate(self, left: list[str], right: list[str]) -> list[str]:
        """Pieces of the concatenated texts, from the pieces of each."""
        if not left or not right:
            return left or right
        reach = REACH
        while True:
            a, got = len(left), 0
            while a and got < reach:
                a -= 1
                got += len(left[a])
            b, got = 0, 0
            while b < len(right) and got < 2 * reach:
                got += len(right[b])
                b += 1
            window = "".join(left[a:]) + "".join(right[:b])
            again = self.pieces(window)
            if b == len(right):
                return left[:a] + again
            borders, at = {}, sum(map(len, left[a:]))
            for k in range(b):
                if k and at <= len(window) - reach:
                    borders[at] = k
                at += len(right[k])
            at = 0
            for k, piece in enumerate(again):
                if at in borders and at >= sum(map(len, left[a:])) + REACH // 2:
                    return left[:a] + again[:k] + right[borders[at] :]
                at += len(piece)
            reach *= 2


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(key, ids array<int>) for every row of docs; tokenizer is the path of the vocabulary file."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    of_key = rows.schema[0].dataType.simpleString()
    schema = f"`{key}` {of_key}, ids array<int>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in _slices(batches):
            ids = [np.array(c.encode(s), dtype=np.int32) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], names=[key, "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaves of each text: as many as halving gives, the next power of two."""
        for batch in _slices(batches, 1):
            s = batch.column(2).to_pylist()[0]
            n = 1 << max(0, -(-len(s) // segment) - 1).bit_length()
            size = -(-len(s) // n)
            for k in range(n):
                leaf = pa.array([s[k * size : (k + 1) * size]], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k], pa.int32()), leaf], names=[key, "__row", "__at", "__text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in _slices(batches, 1):
            pieces = c.pieces(batch.column(3).to_pylist()[0])
            ids = [c[p] for p in pieces]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], batch.column(3), _lists([np.array([len(p) for p in pieces], dtype=np.int32)]), _lists([np.array([i for t in ids for i in t], dtype=np.int32)]), _lists([np.array([len(t) for t in ids], dtype=np.int32)])],
                names=[key, "__row", "__at", "__text", "__chars", "__ids", "__each"],
            )

    def joined(group):
        c = codec(tokenizer)
        copies = int((group["__at"] == 0).sum())  # of a repeated row
        group = group.drop_duplicates("__at").sort_values("__at")
        known: dict[str, tuple[int, ...]] = {}
        level: list[list[str]] = []
        for s, chars, ids, each in zip(group["__text"], group["__chars"], group["__ids"], group["__each"]):
            ends, to = np.cumsum(chars), np.cumsum(each)
            pieces = [s[e - n : e] for e, n in zip(ends, chars)]
            known.update((p, tuple(ids[e - n : e])) for p, e, n in zip(pieces, to, each))
            level.append(pieces)
        while len(level) > 1:
            level = [c.concatenate(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        out = group.iloc[[0] * copies][[key]].copy()
        out["ids"] = [np.array([i for p in (level[0] if level else []) for i in (known.get(p) or c[p])], dtype=np.int32)] * copies
        return out

    short = rows.where(F.length("__text") <= segment).mapInArrow(whole, schema)
    # leaves find together by their text's key and hash, which a task that runs again gives them again
    long = rows.where(F.length("__text") > segment).select(key, F.sha2("__text", 256).alias("__row"), "__text")
    parts = f"`{key}` {of_key}, __row string, __at int, __text string"
    parts = long.mapInArrow(cut, parts).repartition(key, "__row", "__at").mapInArrow(leaves, parts + ", __chars array<int>, __ids array<int>, __each array<int>")
    return short.unionByName(parts.groupBy(key, "__row").applyInPandas(joined, schema))


def decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded string) for rows of (key, ids); special tokens are kept, bytes that are no UTF-8 become U+FFFD."""
    rows = encoded.select(F.col(key), F.col("ids"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in _slices(batches):
            at, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            out = [c.decode(values[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=pa.string())], names=[key, "ids", "decoded"])

    return rows.mapInArrow(texts, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>, decoded string")


def public_path(name: str) -> str:
    """Place of a vocabulary file of the public tokenizers package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of encode and decode; a text is encoded and decoded in one task."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def digest(keys: pa.Array, ids: list[list[int]], c: Codec) -> pa.RecordBatch:
        hashes = [[sha256(x).hexdigest() for x in made] for made in ((",".join(map(str, i)).encode() for i in ids), (c.decode(i).encode() for i in ids))]
        return pa.RecordBatch.from_arrays([keys, pa.array([len(i) for i in ids], pa.int64()), *(pa.array(h, pa.string()) for h in hashes)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in _slices(batches):
            yield digest(batch.column(0), [c.encode(s) for s in batch.column(1).to_pylist()], c)

    def of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in _slices(batches, 1):
            yield digest(batch.column(0), batch.column(1).to_pylist(), c)

    long = encode(rows.where(F.length("__text") > segment), tokenizer, key, "__text", segment)
    return rows.where(F.length("__text") <= segment).mapInArrow(of_texts, schema).unionByName(long.mapInArrow(of_ids, schema))
