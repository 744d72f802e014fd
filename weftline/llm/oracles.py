"""DuckDB SQL of operators that SQL can express."""

from __future__ import annotations

from weftline.llm import decontaminate as d

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
s AS (SELECT doc_id, p AS i, string_agg(word, ' ') OVER q AS k, count(*) OVER q AS m FROM u WINDOW q AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s WHERE m = 20),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.p = u.p WHERE gone.p IS NULL GROUP BY u.doc_id)
SELECT w.doc_id, len(ws)::bigint AS n_words, coalesce(g.n, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id LEFT JOIN k ON w.doc_id = k.doc_id
"""

_CLEAN = "translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), '')"
_NUMBERS = rf"regexp_replace(regexp_replace({{}}, '{d.NUMBER_RE}', chr(1), 'g'), '\x01( ?)(?:{d.UNITS})\b', chr(1) || '\1' || chr(2), 'g')"
_TEMPLATE = rf"regexp_replace({_NUMBERS.format('t')}, '{d.NAME_RE}', chr(3), 'g')"
_FOLDED = _NUMBERS.format("lower(t)")
_THREE = f"{_WORDS.format('t')} AS w, {_WORDS.format(_TEMPLATE)} AS t0, {_WORDS.format(_FOLDED)} AS t1"
_KINDS = "[{'fold': false, 't': t0}, {'fold': true, 't': t1}]"

#: Items with words that are searched by templates; those without enough literals are covered by a test.
DECONTAMINATION = rf"""
WITH i0 AS (SELECT DISTINCT item_id, {_CLEAN} AS t FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT row_number() OVER () AS item, * FROM (SELECT item_id, {_THREE} FROM i0) WHERE len(w) > 0),
ix0 AS (SELECT item, k.fold AS fold, k.t AS t FROM (SELECT item, unnest({_KINDS}) AS k FROM items)),
ix1 AS (SELECT item, fold, t, unnest(range(0, len(t) - {d.WINDOW} + 1)) AS o FROM ix0 WHERE len(t) >= {d.WINDOW}),
ix AS (SELECT DISTINCT item, fold, o, array_to_string(list_slice(t, o + 1, o + {d.WINDOW}), ' ') AS k FROM ix1 WHERE len(list_filter(list_slice(t, o + 1, o + {d.WINDOW}), lambda w: NOT regexp_matches(w, '[\x01-\x03]'))) >= {d.LITERALS}),
d0 AS (SELECT doc_id, {_CLEAN} AS t FROM documents WHERE doc_id IS NOT NULL),
docs AS (SELECT doc_id, {_THREE} FROM d0),
pr0 AS (SELECT doc_id, k.fold AS fold, k.t AS t FROM (SELECT doc_id, unnest({_KINDS}) AS k FROM docs)),
pr AS (SELECT doc_id, fold, t, unnest(range(0, len(t) - {d.WINDOW} + 1)) AS p FROM pr0 WHERE len(t) >= {d.WINDOW}),
hits AS (SELECT DISTINCT doc_id, item, pr.fold AS fold, p - o AS shift FROM pr JOIN ix ON pr.fold = ix.fold AND array_to_string(list_slice(pr.t, p + 1, p + {d.WINDOW}), ' ') = k),
al AS (SELECT hits.doc_id, items.item, item_id, shift, fold, len(items.w) AS n, list_filter(list_transform(range(greatest(0, -shift), least(len(items.w), len(docs.w) - shift)), lambda j: {{'a': items.t0[j + 1], 'same': items.t0[j + 1] = docs.t0[j + shift + 1] OR (fold AND items.t1[j + 1] = docs.t1[j + shift + 1]), 'x': CASE WHEN fold THEN lower(items.w[j + 1]) ELSE items.w[j + 1] END, 'y': CASE WHEN fold THEN lower(docs.w[j + shift + 1]) ELSE docs.w[j + shift + 1] END}}), lambda q: q.same) AS same FROM hits JOIN docs USING (doc_id) JOIN items USING (item)),
sl AS (SELECT doc_id, item, item_id, n, len(same) AS matched, list_distinct(list_transform(list_filter(same, lambda q: regexp_matches(q.a, '[\x01-\x03]')), lambda q: {{'x': q.x, 'y': q.y}})) AS s FROM al),
ok AS (SELECT DISTINCT doc_id, item, item_id FROM sl WHERE 100 * matched >= {d.AGREE} * n AND 100 * (2 * len(s) - len(list_distinct(list_transform(s, lambda q: q.x))) - len(list_distinct(list_transform(s, lambda q: q.y)))) <= {d.BROKEN} * len(s)),
f AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS item_id FROM ok GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_items, 0)::bigint AS n_items, item_id, n_items IS NOT NULL AS contaminated FROM documents LEFT JOIN f ON documents.doc_id = f.doc_id
"""

_LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_LOWERED)

LEXICAL_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS ws FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ws))::bigint AS n_all FROM d WHERE len(ws) > 0),
t AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM tf, s GROUP BY term, n_docs),
x AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n::hugeint * n_docs) // n_all)::bigint)))::bigint AS score FROM q JOIN tf USING (term) JOIN w USING (term), s WHERE doc_id IS NOT NULL GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM o WHERE rank <= 10
"""

VECTOR_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id AS id, min(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL GROUP BY vec_id),
u AS (SELECT id, list_transform(e, lambda x: x::double) AS e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
g AS (SELECT a AS id, a AS c FROM l UNION SELECT l.b, g.c FROM g JOIN l ON l.a = g.id),
m AS (SELECT id, min(c) AS c FROM g GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT v.id AS vec_id, coalesce(n, 0)::bigint AS n_links, coalesce(c, v.id) AS component_id, v.id = coalesce(c, v.id) AS kept
FROM v LEFT JOIN m ON m.id = v.id LEFT JOIN n ON n.id = v.id
"""

_SHARE = "1 + (1000000000::hugeint * ({} + 1)) // ({} + v)"
_F = "(({0} - {1}) * ({0} - {1})) // {1}"

SOURCE_AUDIT = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWERED.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*)::hugeint AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*)::hugeint AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::hugeint AS own FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
a AS (SELECT lang, sum(total)::hugeint AS all_n, count(*)::hugeint AS v FROM k GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {_SHARE.format("coalesce(n, 0)", "own")} AS p, {_SHARE.format("total", "all_n")} AS q FROM g JOIN k USING (lang) JOIN a USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT x.lang, x.source, y.source AS item, sum({_F.format("x.p", "y.p")})::bigint AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
o AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, ({_F.format("p", "q")})::bigint FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 200
"""
