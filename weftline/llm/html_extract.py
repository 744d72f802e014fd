"""HTML extraction by a tree-structured graphical model.

Method. A page becomes a tree of its block elements, with its blocks of text as leaves. Every node has a hidden label: main text
or not. Node potentials come from tag, words of class and id, and for leaves from length, links and punctuation;
parent-child potentials from how labels follow each other on labelled pages, one table for leaves and one for
elements. Messages are passed from the leaves to the root and back (sum-product, exact on a tree), and a block of text
is kept when its marginal is above one half. Kept blocks are joined in page order.

Training. ``fit`` counts features and label pairs over labelled pages (html, main text) in Spark, with partial sums. The model
is a few thousand counts, bounded by ``MOST_FEATURES`` (the most frequent). ``labelled_pages`` makes labelled pages of many
layouts for a user without any; pages are parsed one row at a time and nothing else is gathered.

Defined cases: null or empty html gives an empty text; text outside of any element counts as a child of the root; unclosed
elements end where their parent ends; head, script, style and what is shown only in place of something else (template, video,
svg and the like) hold no text up to their closing tag; without one script and style take the rest, as in browsers, and of
the others only the tag is left out; formulas are part of their block; a ``<`` that begins no tag is text; once a quoted value is never
closed, quotes in tags count no more; character references are decoded once, after the tags are found; white space of any
kind within a block becomes one space; repeated rows give repeated results; extra columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FEATURES = 5_000
SMOOTHING = 1.0

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
#: What can end a tag, and what begins a quoted value, in which nothing does.
_MARK = re.compile(r""">|=\s*["']""")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
#: Elements that hold no text of the page, up to their closing tag; without one only the tag itself is left out.
_SILENT = frozenset("title textarea iframe noframes noscript template svg object canvas select annotation annotation-xml audio video".split())
#: Without a closing tag these take the rest of the page, as in browsers.
_CODE = frozenset(("script", "style"))
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img input "
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table".split())


class Source:
    """Finds the tags of a page from left to right; nothing is looked at more than a few times, whatever the page."""

    def __init__(self, text: str):
        self.text, self.next, self.broken = text, {}, False

    def find(self, what: str, at: int) -> int:
        """Where what comes next, -1 if it doesn't; a find is remembered until it is passed."""
        known = self.next.get(what)
        if known is None or 0 <= known < at:
            known = self.next[what] = self.text.find(what, at)
        return known

    def tag(self, begin: str, at: int) -> int:
        """Where a tag that begins so comes next, in any case; the length of the page if it doesn't."""
        known = self.next.get(begin, -1)
        if known < at:
            m = re.compile(re.escape(begin) + r"(?=[\s/>])", re.I).search(self.text, at)
            known = self.next[begin] = m.start() if m else len(self.text)
        return known

    def end(self, at: int) -> int:
        """Where the tag ends in which at lies. Once a quote is never closed, quotes count no more."""
        here = at
        while not self.broken:
            m = _MARK.search(self.text, here)
            if m and m[0] == ">":
                return m.start()
            close = self.find(m[0][-1], m.end()) if m else -1
            if close < 0:
                self.broken = True
            here = close + 1
        return self.find(">", at)

    def after(self, tag: str, at: int) -> int:
        """Where the page goes on after the content of a silent element that began before at."""
        if tag == "head":
            close, body = self.tag("</head", at), self.tag("<body", at)
            return at if min(close, body) == len(self.text) else body if body < close else self.end(close) + 1 or len(self.text)
        close = self.tag("</" + tag, at)
        if close == len(self.text):
            return close if tag in _CODE else at
        if tag not in _CODE and self.tag("<" + tag, at) < close:
            return at  # that is the other one's end
        return self.end(close) + 1 or len(self.text)


class Page:
    """``up``: parent of each node; ``features``: its features; ``text``: its block of text, None for elements."""

    def __init__(self, source: str):
        self.up, self.features, self.text = [-1], [("tag:root",)], [None]
        self.open: list[tuple[str, int]] = [("", 0)]
        self.count: Counter = Counter()
        #: Places in ``open`` of elements that end others of their kind, and of those within which they do.
        self.kinds: list[int] = []
        self.words: list[str] = []
        self.linked = self.in_link = 0
        scan, at, end = Source(source), 0, len(source)
        while at < end:
            begin = scan.find("<", at)
            self.say(source[at : begin if begin >= 0 else end])
            if begin < 0:
                break
            if source.startswith("<!--", begin):
                close = scan.find("-->", begin + 4)
                at = close + 3 if close >= 0 else end
                continue
            name = _NAME.match(source, begin + 1)
            close = scan.end(name.end()) if name else scan.find(">", begin) if source[begin + 1 : begin + 2] in ("!", "?") else -1
            if close < 0:
                self.say("<")
                at = begin + 1
                continue
            at = close + 1
            if name:
                at = self.tag(scan, name[1].lower(), name[0][0] == "/", source[name.end() : close], at)
        self.flush()

    def say(self, part: str) -> None:
        if part:
            self.words.append(part)
            self.linked += len(part) if self.in_link else 0

    def flush(self) -> None:
        """The words so far are a block."""
        if self.words:
            raw = "".join(self.words)
            self.words.clear()
            block = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if block:
                self.up.append(self.open[-1][1])
                self.text.append(block)
                self.features.append(_leaf(block, self.linked / max(1, len(raw)), self.open[-1][0]))
        self.linked = 0

    def pop(self) -> str:
        tag, _ = self.open.pop()
        self.count[tag] -= 1
        if self.kinds and self.kinds[-1] == len(self.open):
            self.kinds.pop()
        return tag

    def tag(self, scan: Source, tag: str, closing: bool, rest: str, at: int) -> int:
        """Take in a tag; where the page goes on."""
        if tag in _INLINE:
            if tag == "a":
                self.in_link = not closing
            elif tag == "br":
                self.words.append(" ")
            return at
        if tag in _SILENT or tag in _CODE or tag == "head":
            return at if closing or rest.endswith("/") else scan.after(tag, at)
        self.flush()
        if closing:
            if self.count[tag] > 0:
                while self.pop() != tag:
                    pass
                self.in_link = 0
            return at
        if tag in _VOID:
            return at
        if self.open[-1][0] == "p":
            self.pop()
        if tag in _CLOSES:
            for k in reversed(self.kinds):
                if self.open[k][0] in _SCOPE:
                    break
                if self.open[k][0] in _CLOSES[tag]:
                    while len(self.open) > k:
                        self.pop()
                    break
        self.up.append(self.open[-1][1])
        self.text.append(None)
        names = {t for g in _NAMES.findall(rest) for t in _TOKEN.findall("".join(g).lower())} if rest else ()
        self.features.append((f"tag:{tag}", *(f"name:{t}" for t in sorted(names))))
        if not rest.endswith("/"):
            if tag in _CLOSES or tag in _SCOPE:
                self.kinds.append(len(self.open))
            self.open.append((tag, len(self.up) - 1))
            self.count[tag] += 1
        return at


def _leaf(block: str, linked: float, parent: str) -> tuple[str, ...]:
    n = block.count(" ") + 1
    size = 0 if n <= 2 else 1 if n <= 5 else 2 if n <= 10 else 3 if n <= 20 else 4
    return (f"in:{parent}", f"size:{size}", f"link:{0 if linked == 0 else 1 if linked < 0.5 else 2}", f"end:{block[-1] in '.!?:'}")


@dataclass(frozen=True)
class Model:
    """Log odds of each feature, and the label of a child given that of its parent: step[leaf][parent][child]."""

    odds: dict[str, float]
    prior: float
    step: tuple


def marginals(page: Page, model: Model) -> list[float]:
    """Log odds of the label of every node, by one upward and one downward pass."""
    n, odds = len(page.up), model.odds
    total = [sum(odds.get(f, 0.0) for f in fs) for fs in page.features]
    total = [max(-30.0, min(30.0, x)) for x in total]
    total[0] += model.prior
    up = [0.0] * n
    for c in range(n - 1, 0, -1):
        (p00, p01), (p10, p11) = model.step[page.text[c] is not None]
        e = math.exp(max(-60.0, min(60.0, total[c])))
        up[c] = math.log((p10 + p11 * e) / (p00 + p01 * e))
        total[page.up[c]] += up[c]
    for c in range(1, n):
        (p00, p01), (p10, p11) = model.step[page.text[c] is not None]
        e = math.exp(max(-60.0, min(60.0, total[page.up[c]] - up[c])))
        total[c] += math.log((p01 + p11 * e) / (p00 + p10 * e))
    return total


def main_text(source: str, model: Model) -> str:
    page = Page(source)
    return "\n".join(t for t, x in zip(page.text, marginals(page, model)) if t is not None and x > 0)


def _labels(page: Page, text: str) -> list[int]:
    """1 for blocks that are lines of the main text, and for elements most of whose letters are."""
    lines = Counter(text.split("\n"))
    good, all_ = [0] * len(page.up), [0] * len(page.up)
    for c in range(len(page.up) - 1, -1, -1):
        if (block := page.text[c]) is not None:
            all_[c] = len(block)
            good[c] = len(block) if lines[block] > 0 else 0
        if c:
            good[page.up[c]] += good[c]
            all_[page.up[c]] += all_[c]
    return [int(2 * g > a) for g, a in zip(good, all_)]


def fit(labelled: DataFrame, html: str = "html", text: str = "text") -> Model:
    """Train on rows of (html, main text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for source, main in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(source or "")
                labels = _labels(page, main or "")
                seen[("root", labels[0])] += 1
                for c in range(len(page.up)):
                    seen.update((f, labels[c]) for f in page.features[c])
                    if c:
                        seen[(f"step:{int(page.text[c] is not None)}:{labels[page.up[c]]}", labels[c])] += 1
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["feature", "label", "n"])

    counts = labelled.select(html, text).mapInArrow(count, "feature string, label int, n bigint").groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("bad"))
    rows = {r.feature: (r.good + SMOOTHING, r.bad + SMOOTHING) for r in counts.orderBy((F.col("good") + F.col("bad")).desc(), "feature").limit(MOST_FEATURES).collect()}
    get = lambda f: rows.get(f, (SMOOTHING, SMOOTHING))
    kinds: dict[str, list[float]] = {}
    for f, (g, b) in rows.items():
        total = kinds.setdefault(f.partition(":")[0], [0.0, 0.0])
        total[0] += g
        total[1] += b
    odds = {f: math.log(g / kinds[k][0]) - math.log(b / kinds[k][1]) for f, (g, b) in rows.items() if (k := f.partition(":")[0]) not in ("root", "step")}
    step = tuple(tuple(tuple(get(f"step:{leaf}:{parent}")[0 if child else 1] / sum(get(f"step:{leaf}:{parent}")) for child in (0, 1)) for parent in (0, 1)) for leaf in (0, 1))
    return Model(odds, math.log(get("root")[0] / get("root")[1]), step)


def extract(pages: DataFrame, model: Model, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text) for every page."""
    rows = pages.select(F.col(key), F.coalesce(F.col(html), F.lit("")).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([main_text(s, model) for s in part.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, text string")


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, str]]:
    """(html, main text) of n made-up pages of many layouts, the same for the same seed."""
    return [_made(random.Random(f"{seed}/{k}")) for k in range(n)]


def _made(rng: random.Random) -> tuple[str, str]:
    syllables = "ba do ki lu me no ra si ta ve zu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    kept: list[str] = []

    def say(n: int, stop: bool = True) -> str:
        text = " ".join(word() for _ in range(n)).capitalize()
        return text + (rng.choice(".!?") if stop and rng.random() < 0.95 else "")

    def links(n: int) -> str:
        items = [f'<a href="/{word()}">{say(rng.randint(1, 3), False)}</a>' for _ in range(n)]
        return rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "<div>" + " ".join(items) + "</div>"])

    def prose(n: int) -> str:
        return "".join(rng.choice(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "{}"]).format(say(rng.choice([2, 5, 9, 14, 25]))) for _ in range(n))

    def named(names: str) -> str:
        return rng.choice([f'class="{rng.choice(names.split())}"', f'id="{rng.choice(names.split())}"', f'class="{rng.choice(names.split())} {word()}"'])

    def junk(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": rng.choice(["section", "div", "ol"])}.get(kind, "div")
        names = {"nav": "nav menu navbar breadcrumb breadcrumbs topnav navigation toc", "header": "header masthead top site-header banner", "footer": "footer site-footer bottom copyright legal", "sidebar": "sidebar side widget related rail", "form": "newsletter subscribe signup search login", "comments": "comments comment-list discussion responses replies disqus", "ad": "ad ads advert advertisement sponsored promo banner-ad", "notice": "notice cookie cookie-notice consent alert warning popup modal gdpr", "share": "share social sharing follow", "related": "related recommended more-stories trending popular"}[kind]
        if rng.random() < 0.25 and tag != "div":
            tag = "div"
        head = f"<{tag} {named(names)}>" if tag == "div" or rng.random() < 0.6 else f"<{tag}>"
        if kind in ("nav", "share", "related"):
            body = links(rng.randint(2, 8))
        elif kind == "footer":
            body = rng.choice(["&copy; " + say(4) + " &middot; " + say(rng.randint(2, 9)), links(4) + prose(1), "<p>&copy; 2024 " + say(3) + "</p>"])
        elif kind == "form":
            body = f"<label>{say(3, False)}</label><input name=x><p>{say(rng.randint(3, 15))}</p><button>{say(1, False)}</button>"
        elif kind == "comments":
            body = "".join(rng.choice(['<div class="comment"><b>{}</b><p>{}</p></div>', '<li class="comment"><p>{}</p>{}</li>', "<p>{}: {}</p>"]).format(say(1, False), say(rng.choice([3, 8, 20, 40]))) for _ in range(rng.randint(1, 5)))
        elif kind == "header":
            body = rng.choice(["<div>" + say(2, False) + "</div>", links(4), f"<p>{say(6)}</p>" + links(3), f"<h1>{say(2, False)}</h1>"])
        else:
            body = rng.choice([prose(rng.randint(1, 2)), say(rng.choice([3, 9, 15, 30])), say(8) + f'<a href="/x">{say(2, False)}</a>'])
        return head + body + f"</{tag}>"

    def keep(text: str) -> str:
        kept.append(" ".join(entities.unescape(text).split()))
        return text

    def block() -> str:
        x = rng.random()
        if x < 0.62:
            text = keep(say(rng.choice([1, 1, 2, 4, 9, 20, 40, 80, 150])))
            return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p class=x>{}</p>", "<p>{}<br></p>"]).format(text)
        if x < 0.74:
            return f"<h{(h := rng.choice('2234'))}>{keep(say(rng.randint(1, 8), False))}</h{h}>"
        if x < 0.82:
            return "<ul>" + "".join(f"<li>{keep(say(rng.randint(1, 20)))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if x < 0.87:
            return f"<blockquote><p>{keep(say(rng.randint(4, 30)))}</p></blockquote>"
        if x < 0.9:
            return f"<pre>{keep(say(rng.randint(3, 20)))}</pre>"
        if x < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{keep(say(rng.randint(1, 4), False))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
        if x < 0.95:
            return f"<figure><img src=x><figcaption>{keep(say(rng.randint(3, 12)))}</figcaption></figure>"
        return junk(rng.choice(["ad", "share", "related", "notice", "form"]))

    def article() -> str:
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        name = " " + named("content article post entry story main body post-content entry-content article-body text") if tag in ("div", "section") or rng.random() < 0.3 else ""
        title = f"<h1>{keep(say(rng.randint(2, 12), rng.random() < 0.5))}</h1>" if rng.random() < 0.85 else ""
        return f"<{tag}{name}>{title}" + "".join(block() for _ in range(rng.choice([0, 1, 3, 6, 12, 20]) or 1)) + f"</{tag}>"

    before = [junk(k) for k in ("header", "nav", "notice", "ad", "sidebar") if rng.random() < 0.5]
    after = [junk(k) for k in ("share", "related", "ad", "comments", "sidebar", "form", "footer", "notice", "nav") if rng.random() < 0.4]
    body = article()
    if rng.random() < 0.3:
        body = f"<main>{body}</main>"
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(["container", "wrapper", "page", "layout"])}">{body}{after.pop() if after and rng.random() < 0.5 else ""}</div>'
    title = say(5, False)
    page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>' + "".join(before) + "<!-- note -->" + body + "".join(after) + "</body></html>"
    return page, "\n".join(kept)


def default_model(spark: SparkSession, n: int = 1_500) -> Model:
    """A model of n made-up labelled pages."""
    made = spark.sparkContext.defaultParallelism
    rows = spark.range(0, n, 1, made).mapInArrow(_make_rows, "html string, text string")
    return fit(rows)


def _make_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [_made(random.Random(f"1/{k}")) for k in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in pages]), pa.array([t for _, t in pages])], names=["html", "text"])
