"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Method. Numbers, units after numbers, and names (capitalised words) become typed placeholders, in documents and in
benchmark items alike. Windows of ``WINDOW`` template words, one from every word on both sides, are hash-joined. A hit gives an
alignment (document, item, shift). Each alignment is checked over the whole item: the share of template words that agree, and
the slots. Slots are consistent when the values of the item and those of the document map one to one, so a question with
other numbers and names still counts, while slots that are filled at random don't. Copies in capitals or in lower case have
other names, so windows are joined a second time over lower-cased words with numbers and units only as placeholders;
alignments from there compare words and values without their case. Windows with fewer than ``LITERALS`` words outside slots say
nothing and are not indexed; an item that has no other window, or fewer than ``WINDOW`` words, is searched by its exact
words (without case), in windows of ``WINDOW`` words or else as a whole. What is found for an item depends on no other item.

Scale. Documents are not shuffled: hashes of windows and alignments are joined to them by broadcast when their counted size is at
most ``BROADCAST_ROWS``, else by key. Items with one template and one pattern of equal values get the same verdict
everywhere, so they are searched once, as a class. Only documents with a hit are made into words a second time, once
each, whatever the number of their hits.

Defined cases: null texts count as empty; an item without words is in no document; an item is a distinct (id, text); rows with a
null key are never hits; a repeated document gives one row for each copy; repeated benchmark rows change nothing; extra columns
are not read; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import shared

WINDOW = 8
LITERALS = 3
#: Least share of an item's template words that must agree, in percent.
AGREE = 50
#: Most values, in percent of the distinct slot pairs, that may break the one-to-one mapping.
BROKEN = 20
BROADCAST_ROWS = 200_000
UNITS = "kilometers|kilograms|centimeters|meters|grams|liters|hours|minutes|seconds|dollars|euros|percent|years|days|miles|pounds|km|kg|cm|mm|mg|ml|hrs|min|sec|usd|eur|lb|ft|mph"
NUMBER_RE = r"[0-9]+(?:[.,:/][0-9]+)*%?"
UNIT_RE = rf"\x01( ?)(?:{UNITS})\b"
NAME_RE = r"\p{Lu}\p{L}*"


def words(text: Column) -> Column:
    """Words; a text without any gives one empty word, which no window can hold."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def clean(text: Column) -> Column:
    """A clean text without the placeholders' own characters; null is empty. Most texts have none and are not touched."""
    text = F.coalesce(text, F.lit(""))
    has = text.contains("\x01") | text.contains("\x02") | text.contains("\x03")
    return F.when(has, F.translate(text, "\x01\x02\x03", "")).otherwise(text)


def template(text: Column) -> Column:
    """A clean text with \\x01 for numbers, \\x02 for units and \\x03 for names; as many words as before."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, NUMBER_RE, "\x01"), UNIT_RE, "\x01$1\x02"), NAME_RE, "\x03")


def folded(text: Column) -> Column:
    """A clean text in lower case with \\x01 for numbers and \\x02 for units; as many words as before."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), NUMBER_RE, "\x01"), UNIT_RE, "\x01$1\x02")


def _is_slot(word: Column) -> Column:
    return word.rlike("[\x01-\x03]")


def _bounded(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows are few; df is a written table by then."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hash(kind: int, size: int, part: Column) -> Column:
    return F.xxhash64(F.lit(kind), F.lit(size), part)


def _hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def _classes(benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    """(class, item = least id, n_items, iw, it, if) of the items with one template and one pattern of values."""
    items = benchmark.select(F.col(item).alias("item"), clean(F.col(item_text)).alias("t")).where("item is not null").distinct()
    items = items.select("item", words(F.col("t")).alias("iw"), words(template(F.col("t"))).alias("it"), words(folded(F.col("t"))).alias("if"))
    items = items.where((F.size("iw") == F.size("it")) & (F.size("iw") == F.size("if")) & (F.get("iw", F.lit(0)) != ""))
    pattern = lambda ws: F.transform(ws, lambda w: F.array_position(ws, w))
    lower = F.transform("iw", lambda w: F.lower(w))
    # items without a literal window are searched by their words, so there the words make the class
    own = F.when(~F.coalesce(F.array_max(_telling("it")) | F.array_max(_telling("if")), F.lit(False)), lower)
    items = items.withColumns({"p": pattern(F.col("iw")), "q": pattern(lower), "own": own})
    same = items.groupBy("it", "if", "p", "q", "own").agg(F.min(F.struct("item", "iw")).alias("m"), F.count(F.lit(1)).alias("n_items"))
    made = same.select(F.col("m.item").alias("item"), "n_items", F.col("m.iw").alias("iw"), "it", "if", F.col("own").isNotNull().alias("exact"))
    return shared.cut(made.withColumn("class", F.xxhash64("it", "if", "iw")))


def _telling(of: str) -> Column:
    """Of each window of WINDOW words, whether enough of them are no slots; empty for shorter texts."""
    at = F.when(F.size(of) >= WINDOW, F.sequence(F.lit(0), F.size(of) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.size(F.filter(F.slice(of, i + 1, WINDOW), lambda w: ~_is_slot(w))) >= LITERALS)


def _index(classes: DataFrame) -> DataFrame:
    """(h, fold, class, offset) of all windows by which a class is searched."""
    parts = []
    for kind, of in enumerate(("it", "if")):
        told = classes.where("not exact").select("class", of, F.posexplode(_telling(of)).alias("offset", "ok")).where("ok")
        parts.append(told.select(_hash(kind, WINDOW, _hashes(F.slice(of, F.col("offset") + 1, WINDOW))).alias("h"), F.lit(kind == 1).alias("fold"), "class", "offset"))
    exact = classes.where("exact").select("class", F.transform("iw", lambda w: F.xxhash64(F.lower(w))).alias("w"), F.least(F.size("iw"), F.lit(WINDOW)).alias("k"))
    exact = exact.select("class", "k", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("offset"))
    parts.append(exact.select(F.xxhash64(F.lit(2), "k", F.slice("w", F.col("offset") + 1, F.col("k"))).alias("h"), F.lit(True).alias("fold"), "class", "offset"))
    return shared.cut(parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct())


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item = least id of a class, n_items of the class, matched, item_words, slots, broken) for each document and class of
    items with an alignment that passes; of the best shift of each."""
    classes = _classes(benchmark, item, item_text)
    index = _index(classes)
    lengths = [r.k for r in classes.where("exact").select(F.least(F.size("iw"), F.lit(WINDOW)).alias("k")).distinct().collect()]  # at most WINDOW
    rows = docs.select(F.col(key).alias("doc"), clean(F.col(text)).alias("t")).where("doc is not null")
    # no filter on the words: it would be pushed below and make them twice
    made = {"it": _hashes(words(template(F.col("t")))), "if": _hashes(words(folded(F.col("t"))))}
    made |= {"iw": _hashes(words(F.lower("t")))} if lengths else {}
    probe = rows.select("doc", *[v.alias(k) for k, v in made.items()])
    last = F.size("it") - min([WINDOW, *lengths])
    probe = probe.select("doc", *made, F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))).alias("i"))
    kinds = [(0, WINDOW, "it"), (1, WINDOW, "if"), *((2, k, "iw") for k in lengths)]
    probe = probe.select("doc", "i", F.explode(F.array(*[_hash(kind, n, F.slice(of, F.col("i") + 1, n)) for kind, n, of in kinds])).alias("h"))
    hits = probe.join(_bounded(index), "h").select("doc", "class", "fold", (F.col("i") - F.col("offset")).alias("shift")).distinct()
    hits = shared.cut(hits)
    found = shared.cut(hits.select("doc").distinct())
    whole = {"dw": words(F.col("t")), "dt": words(template(F.col("t"))), "df": words(folded(F.col("t")))}
    texts = shared.cut(rows.join(_bounded(found), "doc", "left_semi").distinct().select("doc", *[v.alias(k) for k, v in whole.items()]))
    near = texts.join(_bounded(hits), "doc").join(_bounded(classes), "class")
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("it"), F.size("dt") - F.col("shift")) - 1
    at = lambda j: j + F.col("shift")
    value = lambda w: F.when(F.col("fold"), F.lower(w)).otherwise(w)

    def pair(j: Column) -> Column:
        same = (F.get("it", j) == F.get("dt", at(j))) | (F.col("fold") & (F.get("if", j) == F.get("df", at(j))))
        return F.struct(F.get("it", j).alias("a"), same.alias("same"), value(F.get("iw", j)).alias("x"), value(F.get("dw", at(j))).alias("y"))

    pairs = F.filter(F.transform(F.sequence(first, last), pair), lambda p: p["same"])
    near = near.select("doc", "class", "item", "n_items", "shift", F.size("it").alias("item_words"), pairs.alias("same"))
    slots = F.array_distinct(F.transform(F.filter("same", lambda p: _is_slot(p["a"])), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    near = near.select("doc", "class", "item", "n_items", "shift", "item_words", F.size("same").alias("matched"), slots.alias("s"))
    broken = 2 * F.size("s") - F.size(F.array_distinct(F.col("s")["x"])) - F.size(F.array_distinct(F.col("s")["y"]))
    near = near.select("doc", "class", "item", "n_items", "shift", "matched", "item_words", F.size("s").alias("slots"), broken.alias("broken"))
    near = shared.cut(near).where((100 * F.col("matched") >= AGREE * F.col("item_words")) & (100 * F.col("broken") <= BROKEN * F.col("slots")))
    best = near.groupBy("doc", "class", "item", "n_items").agg(F.min(F.struct(-F.col("matched"), "broken", "slots", "item_words", "shift")).alias("b"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item), "n_items", (-F.col("b.col1")).alias("matched"), "b.item_words", "b.slots", "b.broken")


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **names: str) -> DataFrame:
    """(key, n_items, item_id = least leaked item, contaminated) for every row of docs."""
    item = names.get("item", "item_id")
    found = shared.cut(leaks(docs, benchmark, key, **names).groupBy(F.col(key).alias("__doc")).agg(F.sum("n_items").alias("n_items"), F.min(item).alias(item)))
    rows = docs.select(key)
    return rows.join(_bounded(found), F.col(key) == F.col("__doc"), "left").select(key, F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), item, F.col("n_items").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **names: str) -> DataFrame:
    """The rows of docs, all columns, in which no item leaks."""
    found = shared.cut(leaks(docs, benchmark, key, **names).select(F.col(key).alias("__doc")).distinct())
    return docs.join(_bounded(found), F.col(key) == F.col("__doc"), "left_anti")
