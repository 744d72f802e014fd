import random
import re

from weftline.llm import chat_quotes


def test_quotes_link_and_order(spark):
    rows = [
        (1, 0, "user", "Hello there\nSecond line\n\nA paragraph"), (1, 1, "assistant", "> hello   THERE\n> second line\nHi!"), (1, 2, "user", "> Hi!\n>> Hello there\n>> Second line\nok"),
        (1, 3, "user", "new topic"), (1, 4, "assistant", "> a paragraph\nlate reply"), (1, 5, "user", "> never said\nx"), (1, 6, "user", "> new topic\n> unknown\ny > z"), (2, 0, "user", "> Hi!\nother"), (2, 1, None, None), (2, 1, None, None), (None, 3, "user", "> q"),
    ]
    got = chat_quotes.link(spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, level int")).collect()
    assert [(r.conv_id, r.turn, r.n_quotes, r.n_linked, r.reply_to, r.thread, r.text) for r in got] == [
        (None, 3, 1, 0, None, 3, "> q"), (1, 0, 0, 0, None, 0, "Hello there\nSecond line\n\nA paragraph"), (1, 1, 1, 1, 0, 0, "Hi!"), (1, 2, 2, 2, 1, 0, "ok"), (1, 4, 1, 1, 0, 0, "late reply"), (1, 3, 0, 0, None, 3, "new topic"), (1, 6, 1, 1, 3, 3, "> unknown\ny > z"),
        (1, 5, 1, 0, None, 5, "> never said\nx"), (2, 0, 1, 0, None, 0, "> Hi!\nother"), (2, 1, 0, 0, None, 1, ""), (2, 1, 0, 0, None, 1, ""),
    ]


def test_long_chain_and_empty(spark):
    rows = [(7, 0, "user", "m0")] + [(7, i, "user", f"> m{i - 1}\nm{i}") for i in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat_quotes.link(df).collect()
    assert [(r.turn, r.thread, r.text) for r in got] == [(i, 0, f"m{i}") for i in range(40)]
    assert chat_quotes.link(df.limit(0)).count() == 0


def by_hand(rows):
    """{(conversation, turn, text): (text left, n_quotes, n_linked, reply_to, thread)}, message by message."""
    norm = lambda t: " ".join(t.lower().split())
    marked = [[(len(re.sub("[^>]", "", (m := re.match(r"(?:[ \t]{0,3}(?:>[ \t]?)+)?", line))[0])), line[m.end() :] if ">" in m[0] else line, line) for line in t.split("\n")] for _, _, t in rows]
    wrote = []
    for lines in marked:
        own = "\n".join(b for n, b, _ in lines if not n)
        wrote.append({norm(p) for p in [own, *re.split(r"\n[ \t]*\n", own), *own.split("\n")]} - {""})
    first = lambda c, turn, t: min((u for (d, u, _), w in zip(rows, wrote) if d == c and u < turn and t in w), default=None)
    out, reply = {}, {}
    for (c, turn, text), lines in zip(rows, marked):
        passages = []
        for n, body, line in lines:
            if not passages or passages[-1][0] != n:
                passages.append((n, [], []))
            passages[-1][1].append(body)
            passages[-1][2].append(line)
        left, quotes, linked, to = [], 0, 0, []
        for n, bodies, raw in passages:
            said = [norm(b) for b in bodies if norm(b)]
            gone = set()
            if n and said:
                quotes += 1
                at = first(c, turn, " ".join(said))
                if at is not None:
                    gone = set(range(len(raw)))
                else:
                    found = {i: u for i, b in enumerate(bodies) if norm(b) and (u := first(c, turn, norm(b))) is not None}
                    votes = [u for i, u in found.items() if " " in norm(bodies[i])]
                    best = max(votes, key=lambda u: (votes.count(u), u), default=None)
                    at = best if best is not None and 2 * votes.count(best) >= len(said) else None
                    if at is not None:  # line by line: those that were written, with the empty ones before
                        gone = {i for i, u in found.items() if " " in norm(bodies[i]) or u == at}
                        for i in range(len(bodies) - 2, -1, -1):
                            if not norm(bodies[i]) and i + 1 in gone:
                                gone.add(i)
                        for i in range(1, len(bodies)):
                            if i - 1 in gone and not any(norm(b) for b in bodies[i:]):
                                gone.add(i)
                if at is not None:
                    linked += 1
                    to += [at] if n == 1 else []
            left += [line for i, line in enumerate(raw) if i not in gone]
        out[c, turn, text] = ("\n".join(left).strip("\n") if linked else text, quotes, linked, max(to, default=None))
        reply[c, turn] = max(to, default=None)

    def root(c, turn):
        while reply.get((c, turn)) is not None:
            turn = reply[c, turn]
        return turn

    return {k: (*v, root(*k[:2])) for k, v in out.items()}


def test_equals_a_walk_by_hand(spark):
    rng = random.Random(5)
    rows = []
    for c in range(12):
        said = []
        for turn in range(25):
            lines = []
            for _ in range(rng.randint(1, 4)):
                x = rng.random()
                if said and x < 0.5:
                    quoted = rng.choice(said).split("\n")
                    level = rng.choice([1, 1, 2])
                    lines += [("> " * level if rng.random() < 0.7 else ">" * level + " ") + (q.upper() if rng.random() < 0.2 else q) for q in quoted[: rng.randint(1, 3)]]
                elif x < 0.6:
                    lines += [">>> print(1)", "1"]
                elif x < 0.7:
                    lines += rng.choice([["> nobody said so"], [">", "> nobody said so"], [">"]])
                else:
                    lines.append(" ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randint(1, 3))))
            rows.append((c, turn, "\n".join(lines)))
            said.append(rows[-1][2])
    got = chat_quotes.link(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string").repartition(5)).collect()
    want = by_hand(rows)
    assert len(got) == len(rows) and any(v[1] > v[2] > 0 for v in want.values())
    left = {(r.conv_id, r.turn): (r.text, r.n_quotes, r.n_linked, r.reply_to, r.thread) for r in got}
    assert left == {k[:2]: v for k, v in want.items()}


def test_only_what_was_quoted_goes(spark):
    rows = [
        (1, 0, "Hello there\nok\nA third line\nand more of it"), (1, 1, "> Hello there\n> never said by anyone, important\nyes"), (1, 2, ">>> print(1)\n>>> ok\nruns"), (1, 3, "> ok\nfine"),
        (1, 4, "> Hello there\n>\n> not this\n>\n> A third line\n> ok\n>\nend"),
    ]
    got = {r.turn: (r.text, r.n_linked, r.reply_to) for r in chat_quotes.link(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1] == ("> never said by anyone, important\nyes", 1, 0)
    assert got[2] == (">>> print(1)\n>>> ok\nruns", 0, None)
    assert got[3] == ("fine", 1, 0)
    assert got[4] == (">\n> not this\nend", 1, 0)


def test_what_is_no_quote_stays_and_long_texts(spark):
    code, long = "Run this:\n>>> print(1)\n1\nok", "word " * 300_000
    rows = [("a", "2020-01-01", "user", code), ("a", "2020-01-02", "user", f"{long}\n\nend"), ("a", "2020-01-03", "user", f"> {long}\nyes"), ("a", "2020-01-04", "user", "> Hi")]
    df = spark.createDataFrame(rows, "conv_id string, turn string, role string, text string").selectExpr("conv_id", "cast(turn as date) turn", "role", "text")
    got = {str(r.turn): (r.text, r.n_linked) for r in chat_quotes.link(df).collect()}
    assert got["2020-01-01"] == (code, 0) and got["2020-01-03"] == ("yes", 1) and got["2020-01-04"] == ("> Hi", 0)
