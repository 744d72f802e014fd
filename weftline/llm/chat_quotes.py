"""Chat formatting by quotation linking.

Method. Each line of a message has a quote level: the number of ``>`` that begin it (spaces between allowed). Consecutive
lines of one level make a passage. Passages are normalised (lower case, one space for white space, quote marks gone) and hashed; the
passages that a message wrote itself (all its own text, each paragraph and each line of it) form the index. Each
quoted passage is joined within its conversation to the first message that wrote it, if that is earlier; else each of its
lines of more than one word votes for the first earlier message that wrote it, and the passage links to the message with the most votes (of equal ones
the latest) if that is at least half of its lines. A message replies to the latest message that a level-1 quote of
it links to; deeper levels are linked as well and counted, as they name the message that the quoted one had quoted. A reply
belongs to the thread of what it replies to, and conversations are ordered by the turn of the thread's first message, then
by turn. What was quoted is taken out of the text, and nothing else: a passage that was found as a whole, and of one that its lines have linked the lines
that an earlier message wrote (a single word only if the linked message did), with the empty lines before them. Lines that begin with ``>`` but quote nothing stay as they are.

Scale. Parsing is a map, written once. The index keeps one row per (conversation, hash), the least turn, by partial aggregation, so
a text said a million times is one row; links are found by a join on both; threads are closed by pointer doubling, in as
many rounds as the logarithm of the longest chain. The result is ordered by range, so one giant conversation is spread.

Defined cases: a null text is an empty message; messages without linked quotes keep their text as it is; a quote without an
original links to nothing and stays; of repeated (conversation, turn) rows each is kept and all have the same links, those that
any of them has; rows with a null conversation or turn are kept, unlinked; conversations and turns may be of any type that has an order;
extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import shared

_MARK = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
_PARSED = "role string, text string, own array<string>, quotes array<struct<n:int,level:int,whole:string,lines:array<struct<h:string,few:boolean,a:int,b:int>>>>"


def _norm(lines: list[str]) -> str:
    return " ".join(" ".join(lines).lower().split())


def _hash(text: str) -> str:
    return blake2b(text.encode(), digest_size=16).hexdigest()


def parse(text: str) -> list[tuple[int, int, list[str]]]:
    """The passages in order: level, number of the first line, lines without marks."""
    passages: list[tuple[int, int, list[str]]] = []
    for i, line in enumerate(text.split("\n")):
        mark = _MARK.match(line)
        level = mark[1].count(">") if mark else 0
        if not passages or passages[-1][0] != level:
            passages.append((level, i, []))
        passages[-1][2].append(line[mark.end() :] if mark else line)
    return passages


def _lines(lines: list[str], at: int) -> list[dict]:
    """The lines of a passage that begins at line ``at`` of the text: hash, whether it is a single word, and the lines that go with it (the empty ones before it, or after the last)."""
    out: list[dict] = []
    for i, line in enumerate(lines, at):
        said = _norm([line])
        if said:
            out.append({"h": _hash(said), "few": " " not in said, "a": out[-1]["b"] + 1 if out else at, "b": i})
    if out:
        out[-1]["b"] = at + len(lines) - 1
    return out


def messages(chats: DataFrame) -> DataFrame:
    """Each message with the hashes of what it wrote and of what it quotes."""
    rows = chats.select("conv_id", "turn", F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    quote = pa.struct([("n", pa.int32()), ("level", pa.int32()), ("whole", pa.string()), ("lines", pa.list_(pa.struct([("h", pa.string()), ("few", pa.bool_()), ("a", pa.int32()), ("b", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, quoted = [], []
            for s in batch.column(3).to_pylist():
                passages = parse(s)
                text = "\n".join(line for level, _, lines in passages if not level for line in lines)
                parts = [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]
                own.append(sorted({_hash(n) for p in parts if (n := _norm([p]))}))
                found = [
                    {"n": n, "level": level, "whole": _hash(_norm(lines)), "lines": _lines(lines, at)}
                    for n, (level, at, lines) in enumerate(passages) if level and _norm(lines)
                ]
                quoted.append(found)
            made = [pa.array(own, pa.list_(pa.string())), pa.array(quoted, pa.list_(quote))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["conv_id", "turn", "role", "text", "own", "quotes"])

    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    return rows.mapInArrow(run, f"{key}, {_PARSED}")


def _originals(parsed: DataFrame) -> DataFrame:
    """(lc, lt, n, level, id, original, gone) of the passages that link, by conversation, turn and number of the passage; gone: the ranges (a, b) of lines to take out."""
    passage = ["conv_id", "turn", "n", "level", "id"]
    quotes = parsed.where("size(quotes) > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("quotes").alias("q")).distinct()
    index = parsed.where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.explode("own").alias("k"))
    index = index.groupBy("c", "k").agg(F.min("t").alias("first"))
    part = lambda whole, h, few, a, b: F.struct(F.lit(whole).alias("whole"), h.alias("h"), few.alias("few"), a.alias("a"), b.alias("b"))
    lines = F.transform("q.lines", lambda x: part(False, x["h"], x["few"], x["a"], x["b"]))
    ends = F.get("q.lines", F.lit(0))["a"], F.get("q.lines", F.size("q.lines") - 1)["b"]
    hashes = F.concat(F.array(part(True, F.col("q.whole"), F.lit(False), *ends)), lines)
    wanted = quotes.select("conv_id", "turn", "q.n", "q.level", F.col("q.whole").alias("id"), F.size("q.lines").alias("size"), F.inline(hashes))
    found = wanted.join(index, (F.col("conv_id") == F.col("c")) & (F.col("h") == F.col("k")) & (F.col("first") < F.col("turn")))
    found = shared.cut(found.select(*passage, "size", "whole", "few", "a", "b", "first"))
    votes = found.groupBy(*passage, "size", "first").agg(F.max("whole").alias("whole"), F.sum(F.when(F.col("whole") | F.col("few"), 0).otherwise(1)).alias("votes"))
    best = votes.where("whole or 2 * votes >= size").groupBy(*passage).agg(F.max(F.struct("whole", "votes", "first")).alias("b"))
    best = best.select(*passage, F.col("b.whole").alias("by_whole"), F.col("b.first").alias("original"))
    gone = best.join(found, passage).where(F.when(F.col("by_whole"), F.col("whole")).otherwise(~F.col("whole") & (~F.col("few") | (F.col("first") == F.col("original")))))
    gone = gone.groupBy(*passage, "original").agg(F.collect_set(F.struct("a", "b")).alias("gone"))  # the lines of one message at most
    return gone.select(F.col("conv_id").alias("lc"), F.col("turn").alias("lt"), "n", "level", "id", "original", "gone")


def link(chats: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, n_linked, reply_to, thread), in the order of the conversations."""
    parsed = shared.cut(messages(chats))
    each = shared.cut(_originals(parsed))
    links = each.groupBy("lc", "lt").agg(F.count(F.lit(1)).alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("original"))).alias("reply_to"), F.collect_list(F.struct("n", "id", "gone")).alias("gone"))
    links = shared.cut(links)
    roots = shared.cut(links.where("reply_to is not null").select("lc", "lt", F.col("reply_to").alias("root")))
    for _ in range(most_rounds):
        up = roots.select(F.col("lc").alias("uc"), F.col("lt").alias("ut"), F.col("root").alias("over"))
        after = roots.join(up, (F.col("lc") == F.col("uc")) & (F.col("root") == F.col("ut")), "left")
        if after.where("over is not null").isEmpty():
            break
        roots = shared.cut(after.select("lc", "lt", F.coalesce("over", "root").alias("root")))
    else:
        raise RuntimeError(f"threads did not settle in {most_rounds} rounds")
    known = links.join(roots.select(F.col("lc").alias("rc"), F.col("lt").alias("rt"), "root"), (F.col("lc") == F.col("rc")) & (F.col("lt") == F.col("rt")), "left")
    known = known.select("lc", "lt", "n_linked", "reply_to", "root", "gone")
    out = parsed.drop("own").join(known, (F.col("conv_id") == F.col("lc")) & (F.col("turn") == F.col("lt")), "left")
    # of the passages of this row; another row of the same turn may have others
    own = F.filter("gone", lambda g: F.exists("quotes", lambda q: (q["n"] == g["n"]) & (q["whole"] == g["id"])))
    out = out.withColumn("gone", F.when(F.col("gone").isNotNull(), F.flatten(F.transform(own, lambda g: g["gone"]))))
    left = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.exists("gone", lambda g: (g["a"] <= i) & (i <= g["b"])))
    text = F.when(F.size("gone") > 0, F.btrim(F.array_join(left, "\n"), F.lit("\n"))).otherwise(F.col("text"))
    out = out.select("conv_id", "turn", "role", text.alias("text"), F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"), "reply_to", F.coalesce("root", "turn").alias("thread"))
    return out.orderBy("conv_id", "thread", "turn", "role", F.xxhash64("text"))
