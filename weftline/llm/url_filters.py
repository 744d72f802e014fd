"""URL filters by rules and link-graph propagation; DataFrame functions only.

Method. The longest rule that fits a url decides it. Other urls are decided by their host: a personalised PageRank
spreads trust from trusted hosts along links, and a second one spreads distrust from blocked hosts against the links
(who links to a blocked host is suspect). A host is blocked when its distrust exceeds its trust and ``THRESHOLD``.
Seeds are the hosts of which at least ``SEED_SHARE`` of the pages are allowed (or blocked) by a rule, each with a weight of
one, so scores and the threshold are in shares of one seed, whatever the number of seeds. Of the weight,
``DAMPING ** ROUNDS`` is still under way when the rounds end. Edges are the distinct-host links of all pages, counted by pair of hosts before anything else moves.

Scale. One pass over the pages gives the host table and the edge table; the ``ROUNDS`` rounds work on those alone: join
the scores with the edges, sum by target (partial sums first). Pages get their host's verdict by broadcast if the
counted blocked hosts are at most ``BROADCAST_ROWS``, else by a join. A hot host's pages are pre-aggregated.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html has no
links; repeated rows give repeated results and count as pages; links to the own host don't count; extra columns are
not read; an empty table gives an empty table. ``rules`` are a short list, part of the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import shared

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
ROUNDS = 10
SEED_SHARE = 0.5
THRESHOLD = 1e-6
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK_RE = r"""[hH][rR][eE][fF]\s*=\s*["']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'\s<>]+)"""


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(rest, "^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def fits(host: Column, path: Column, rule: str) -> Column:
    name, _, start = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Personalised PageRank: seeds (host, weight), edges (a, b, share of a's links) to (host, score)."""
    start = seeds.select("host", (F.col("weight") * (1 - DAMPING)).alias("score"))
    score = seeds.select("host", F.col("weight").alias("score"))
    for n in range(ROUNDS):
        moved = score.join(edges, F.col("host") == F.col("a")).groupBy("b").agg((F.sum(F.col("score") * F.col("share")) * DAMPING).alias("score")).withColumnRenamed("b", "host")
        score = moved.unionByName(start).groupBy("host").agg(F.sum("score").alias("score"))
        if n % 3 == 2:
            score = shared.cut(score)
    return score


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict) for every page."""
    host, path = parts(F.col(url))
    rows = pages.select(F.col(key).alias("__key"), host.alias("host"), path.alias("path"), F.col(html).alias("__html"))
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, r in reversed(ordered):
        rule = F.when(fits(F.col("host"), F.col("path"), r), F.lit(r)).otherwise(rule)
        said = F.when(fits(F.col("host"), F.col("path"), r), F.lit(verdict)).otherwise(said)
    judged = rows.select("__key", "host", "path", rule.alias("rule"), said.alias("said"))
    by_host = judged.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("said") == "allow", 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("said") == "block", 1).otherwise(0)).alias("bad"))
    by_host = shared.cut(by_host.select("host", (F.col("good") >= F.col("n") * SEED_SHARE).alias("trusted"), (F.col("bad") >= F.col("n") * SEED_SHARE).alias("blocked")))
    links = rows.where("host <> ''").select(F.col("host").alias("a"), F.explode(F.regexp_extract_all("__html", F.lit(LINK_RE), F.lit(1))).alias("b"))
    links = links.select("a", F.translate("b", UPPER, LOWER).alias("b")).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    links = shared.cut(links)

    def seeds(flag: str) -> DataFrame:
        return by_host.where(flag).select("host", F.lit(1.0).alias("weight"))

    def shares(a: str, b: str) -> DataFrame:
        out = links.groupBy(a).agg(F.sum("n").alias("total")).withColumnRenamed(a, "k")
        return links.join(out, F.col(a) == F.col("k")).select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col("n") / F.col("total")).alias("share"))

    trust = propagate(seeds("trusted"), shares("a", "b")).withColumnRenamed("score", "trust")
    distrust = propagate(seeds("blocked"), shares("b", "a")).withColumnRenamed("score", "distrust")
    suspect = distrust.join(trust, "host", "left").where((F.col("distrust") > F.coalesce("trust", F.lit(0.0))) & (F.col("distrust") > THRESHOLD)).select(F.col("host").alias("__bad"))
    suspect = shared.cut(suspect)
    suspect = F.broadcast(suspect) if suspect.count() <= BROADCAST_ROWS else suspect
    verdict = F.coalesce("said", F.when(F.col("__bad").isNotNull(), "block").otherwise("allow"))
    return judged.join(suspect, F.col("host") == F.col("__bad"), "left").select(F.col("__key").alias(key), "host", "path", "rule", verdict.alias("verdict"))


def oracle() -> str:
    """The same in DuckDB SQL, with the rounds written out."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fit = lambda r: f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))"
    rule = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{r}'" for _, r in ordered) + " END"
    said = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{v}'" for v, r in ordered) + " END"
    link = LINK_RE.replace("'", "''")
    ctes = [
        "u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"p AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"j AS (SELECT page_id, host, path, {rule} AS rule, {said} AS said FROM p)",
        f"h AS (SELECT host, sum(CASE WHEN said = 'allow' THEN 1 ELSE 0 END) >= count(*) * {SEED_SHARE} AS trusted, sum(CASE WHEN said = 'block' THEN 1 ELSE 0 END) >= count(*) * {SEED_SHARE} AS blocked FROM j WHERE host <> '' GROUP BY host)",
        f"l0 AS (SELECT host AS a, unnest(regexp_extract_all(html, '{link}', 1)) AS b FROM p WHERE host <> '')",
        f"l AS (SELECT a, b, count(*) AS n FROM (SELECT a, translate(b, '{UPPER}', '{LOWER}') AS b FROM l0) WHERE a <> b GROUP BY a, b)",
        "e1 AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS share FROM l)",
        "e2 AS (SELECT b AS a, a AS b, n / sum(n) OVER (PARTITION BY b) AS share FROM l)",
    ]
    for s, flag in ((1, "trusted"), (2, "blocked")):
        ctes.append(f"s{s}_0 AS (SELECT host, 1.0::double AS score FROM h WHERE {flag})")
        for n in range(ROUNDS):
            ctes.append(f"s{s}_{n + 1} AS (SELECT host, sum(score) AS score FROM (SELECT b AS host, {DAMPING} * score * share AS score FROM s{s}_{n} JOIN e{s} ON host = a UNION ALL SELECT host, {1 - DAMPING} * score FROM s{s}_0) GROUP BY host)")
    ctes.append(f"bad AS (SELECT d.host AS bad FROM s2_{ROUNDS} d LEFT JOIN s1_{ROUNDS} t ON d.host = t.host WHERE d.score > coalesce(t.score, 0) AND d.score > {THRESHOLD})")
    return "WITH " + ", ".join(ctes) + " SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bad IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN bad ON host = bad"
