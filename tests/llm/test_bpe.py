import hashlib
import random

from tokenizers import Tokenizer

from weftline.llm import bpe

PATH = bpe.public_path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "'ll", "'l", "l", "don't", "<|endoftext|>", "<|", "1", "23", "!", " ", "\x85", "\x1c", "日本", "😀", " ", "　", "the ", "tion"]


def library():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s, add_special_tokens=False).ids, lambda i: t.decode(i, skip_special_tokens=False)


def test_codec_equals_library():
    encode, decode = library()
    rng, c = random.Random(3), bpe.codec(PATH)
    for _ in range(1500):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        assert c.encode(s) == encode(s), repr(s)
        assert c.decode(encode(s)) == decode(encode(s))
        left, right = s, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 90)))
        assert c.concatenate(c.pieces(left), c.pieces(right)) == c.pieces(left + right)


def test_long_pieces_by_halves():
    encode, _ = library()
    rng, c = random.Random(4), bpe.codec(PATH)
    for _ in range(60):
        s = "".join(rng.choice(["a", "b", "ab", "c", "the", "zq", "aaaa"]) for _ in range(rng.randint(300, 3000)))
        assert c.encode(s) == encode(s)


def test_operator_with_leaves(spark):
    encode, decode = library()
    rng = random.Random(5)
    texts = [None, "", " ", "x" * 5000, "aé" * 1500 + "<|endoftext|>" * 3, "".join(rng.choice(PARTS) for _ in range(3000)), "word " * 2000]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300))) for _ in range(20)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "null key", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    for segment in (100, 65536):
        out = bpe.decode(bpe.encode(df, PATH, segment=segment), PATH).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids), r.decoded) for r in out) == sorted((i if i is not None else -1, encode(t or ""), decode(encode(t or ""))) for i, t, _ in rows)
    digest = {r.doc_id: r for r in bpe.digests(df, PATH).collect()}
    assert digest[6].ids_sha256 == hashlib.sha256(",".join(map(str, encode(texts[6]))).encode()).hexdigest()
    assert digest[0].n_tokens == 0 and digest[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(df.limit(0), PATH).count() == 0
