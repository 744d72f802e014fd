"""DuckDB SQL of the registered queries, written independently of the operators."""

from __future__ import annotations

from weftline.operators.durations import LEVELS, shares

HANDLER = "name IN ('httpd:enter_event_handler', 'httpd:exit_event_handler')"
_CALL = "'syscall_' || CASE WHEN k % 2 = 0 THEN 'entry' ELSE 'exit' END || "
TRACE = f"""e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
t AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, user_id % 8 AS tid, user_id % 2 AS pid, 'proc' || (user_id % 5) AS procname, k % 10 AS connection_state, CASE WHEN k % 7 = 0 THEN -1 ELSE k END AS ret, k, ts,
  CASE event_type WHEN 'signup' THEN 'httpd:enter_event_handler' WHEN 'purchase' THEN 'httpd:exit_event_handler' WHEN 'view' THEN {_CALL}'_read' WHEN 'click' THEN {_CALL}'_poll' ELSE {_CALL}'_futex' END AS name FROM e)"""
PAIRED = TRACE + """,
pa AS (SELECT *, contains(name, 'entry') AS is_entry, contains(name, 'exit') AND NOT contains(name, 'entry') AS is_exit, replace(replace(replace(name, 'syscall_', ''), 'entry_', ''), 'exit_', '') AS sysname FROM t),
pb AS (SELECT *, coalesce(sum(is_exit::int) OVER (PARTITION BY sysname, pid, tid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM pa),
pc AS (SELECT *, min(CASE WHEN is_entry THEN ts_ns END) OVER (PARTITION BY sysname, pid, tid, grp) AS open_ts, row_number() OVER (PARTITION BY sysname, pid, tid, grp ORDER BY seq) AS rn0 FROM pb),
pd AS (SELECT *, is_exit AND open_ts IS NOT NULL AS paired, CASE WHEN is_exit THEN coalesce(ts_ns - open_ts, 0) WHEN is_entry THEN 0 END AS latency, CASE WHEN is_entry AND rn0 > 1 THEN 1 WHEN is_exit AND open_ts IS NULL THEN 1 ELSE 0 END AS err FROM pc),
p AS (SELECT *, CASE WHEN paired THEN coalesce(avg(latency) OVER (PARTITION BY sysname, paired ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) WHEN is_entry OR is_exit THEN 0 END AS f_mean FROM pd)"""
REQUESTS = PAIRED + f""",
ra AS (SELECT *, name = 'httpd:enter_event_handler' AS enter, coalesce(sum((name = 'httpd:exit_event_handler')::int) OVER (PARTITION BY tid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM t WHERE {HANDLER}),
rb AS (SELECT *, max(CASE WHEN enter AND connection_state NOT IN (6, 7) THEN seq END) OVER (PARTITION BY tid, g) AS start_seq FROM ra),
r AS (SELECT seq AS request_id, tid AS request_tid, start_seq, seq AS end_seq FROM rb WHERE NOT enter AND start_seq IS NOT NULL)"""
ASSIGNED = REQUESTS + f""",
asg AS (SELECT p.*, request_id FROM p JOIN r ON p.seq > start_seq AND p.seq < end_seq WHERE NOT {HANDLER}),
nr AS (SELECT request_id, row_number() OVER (ORDER BY request_id) AS rn FROM (SELECT DISTINCT request_id FROM asg)),
x AS (SELECT asg.*, rn, CASE WHEN rn % 5 < 3 THEN 'train' WHEN rn % 5 = 3 THEN 'valid' ELSE 'test' END AS dataset, coalesce(ts_ns - lag(ts_ns) OVER (PARTITION BY request_id ORDER BY seq), 0) AS duration FROM asg JOIN nr USING (request_id))"""
VOCAB = ASSIGNED + """,
vc AS (SELECT row_number() OVER (ORDER BY f, word) + 4 AS idx, word FROM (SELECT sysname AS word, min({'rn': rn, 'seq': seq}) AS f FROM x WHERE dataset = 'train' GROUP BY 1)),
vp AS (SELECT row_number() OVER (ORDER BY f, word) + 4 AS idx, word FROM (SELECT procname AS word, min({'rn': rn, 'seq': seq}) AS f FROM x WHERE dataset = 'train' GROUP BY 1))"""
SPANS = ", sp AS (SELECT sysname, count(*) AS n, " + ", ".join(f"quantile_cont(latency, {shares(level)}) AS b{level}" for level in LEVELS) + " FROM p WHERE paired GROUP BY sysname)"


def tag(value: str, level: int) -> str:
    return f"CASE WHEN contains(name, 'exit') AND b{level} IS NOT NULL THEN len(list_filter(b{level}, lambda b: b < coalesce({value}, 0))) + 1 ELSE 0 END"


_TAGS = " || '-' || ".join(f"({tag('latency', level)})" for level in LEVELS)
SEQUENCES = VOCAB + SPANS + f""",
en AS (SELECT x.*, coalesce(vc.idx, 1) AS call, coalesce(vp.idx, 1) AS proc, {_TAGS} AS tags1, CASE WHEN contains(name, 'entry') THEN 1 WHEN contains(name, 'exit') THEN 2 ELSE 0 END AS dir, CASE WHEN contains(name, 'entry') THEN 0 WHEN coalesce(ret, 0) >= 0 THEN 1 ELSE 2 END AS rc
  FROM x LEFT JOIN vc ON sysname = vc.word LEFT JOIN vp ON procname = vp.word LEFT JOIN sp ON x.sysname = sp.sysname),
sq AS (SELECT dataset, request_id, rn, [2] || list(call ORDER BY seq) || [3] AS call, [2] || list(proc ORDER BY seq) || [3] AS proc, [0] || list(dir ORDER BY seq) || [0] AS entry, [0] || list(duration ORDER BY seq) || [0] AS duration, [0] || list(pid ORDER BY seq) || [0] AS pid, [0] || list(tid ORDER BY seq) || [0] AS tid,
  [0] || list(rc ORDER BY seq) || [0] AS ret, min(ts_ns) AS start_ts, ['0-0-0-0'] || list(tags1 ORDER BY seq) || ['0-0-0-0'] AS tags, sum(duration) / 1e6 AS duration_ms FROM en GROUP BY dataset, request_id, rn)"""
SYMBOLS = """s AS (SELECT lang AS "set", lang AS dataset, doc_id AS rn, CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'valid' ELSE 'test' END AS role, [2] || list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: CASE WHEN c = ' ' THEN 5 ELSE 6 + unicode(lower(c)) % 40 END) || [3] AS call FROM documents),
g AS (SELECT "set", dataset, rn, role, i, c[i] || ',' || c[i + 1] AS context, c[i + 2] AS word FROM (SELECT *, unnest(range(1, len(c) - 1)) AS i FROM (SELECT *, [2] || call[1 : len(call) - 1] AS c FROM s))),
tr AS (SELECT context, word, count(*) AS c, min({'rn': rn, 'i': i}) AS first FROM g WHERE role = 'train' AND dataset = 'en' GROUP BY ALL),
tn AS (SELECT context, sum(c) AS n FROM tr GROUP BY context),
cn AS (SELECT tr.*, n FROM tr JOIN tn USING (context))"""
PERPLEXITY = SYMBOLS + """, pp AS (SELECT "set", role, rn, round(exp(-avg(ln(coalesce(c / n, 1 / 46)))), 9) AS score FROM g LEFT JOIN cn USING (context, word) GROUP BY ALL)"""
LOGITS = """l AS (SELECT vec_id, vec_id // 10 AS batch, list_transform(embedding, lambda v: v::double) AS x, label AS target, label % 6 AS tag, 'd' || (vec_id % 3) AS dataset, 'c' || label AS cls, (vec_id % 63 + 1) AS input FROM embeddings),
lz AS (SELECT *, x[1:4] AS bits, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS z, list_position(x, list_max(x)) - 1 AS pred, len(list_filter(x[1:4], lambda v: 1 / (1 + exp(-v)) > 0.5)) + 1 AS tag_pred FROM l)"""
SCORES = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type NOT IN ('view', 'click') AS novel FROM events),
d AS (SELECT event_id AS id, CASE WHEN novel THEN event_type ELSE 'known' END AS "set", novel, CASE WHEN event_id % 2 = 0 THEN 'valid' ELSE 'test' END AS role, value + CASE WHEN novel THEN 10 ELSE 0 END AS event_score, (k + CASE WHEN novel THEN 20 ELSE 0 END)::double AS duration_score FROM e),
dr AS (SELECT *, row_number() OVER (PARTITION BY role, "set" ORDER BY id) AS rn, count(*) OVER (PARTITION BY role, "set") AS cnt FROM d),
dm AS (SELECT n.role, n."set", least(n.cnt, k.cnt) AS m FROM (SELECT DISTINCT role, "set", cnt FROM dr WHERE novel) n JOIN (SELECT DISTINCT role, cnt FROM dr WHERE NOT novel) k ON n.role = k.role),
bal AS (SELECT dm.role, dm."set", id, 0 AS label, event_score, duration_score FROM dr JOIN dm ON dr.role = dm.role AND NOT dr.novel AND rn <= m UNION ALL SELECT dm.role, dm."set", id, 1, event_score, duration_score FROM dr JOIN dm ON dr.role = dm.role AND dr."set" = dm."set" AND rn <= m)"""


def sweep(source: str, steps: int, prefix: str = "") -> str:
    """CTEs of the sweep over source ("set", label, score), every row against every threshold."""
    p = prefix
    return f"""{p}en AS (SELECT "set", min(score) AS lo, max(score) AS hi, (max(score) - min(score)) / {steps} AS step FROM {source} GROUP BY "set"),
{p}gr AS (SELECT "set", lo, step, unnest(range(0, CASE WHEN hi = lo THEN 1 ELSE {steps} END)) AS i FROM {p}en),
{p}sc AS (SELECT {p}gr."set", i, any_value(lo + i * step) AS threshold, count(*) FILTER (label = 1 AND score > lo + i * step) AS tp, count(*) FILTER (label = 0 AND score > lo + i * step) AS fp, count(*) FILTER (label = 1 AND score <= lo + i * step) AS fn, count(*) FILTER (label = 0 AND score <= lo + i * step) AS tn
  FROM {p}gr JOIN {source} s ON s."set" = {p}gr."set" GROUP BY {p}gr."set", i),
{p}sw AS (SELECT *, {RATES} FROM {p}sc),
{p}bt AS (SELECT "set", arg_min(threshold, {{'f': -f1, 'i': i}}) AS threshold, max(f1) AS f1 FROM {p}sw GROUP BY "set")"""


_PREC, _REC = "coalesce(tp / nullif(tp + fp, 0), 0)", "coalesce(tp / nullif(tp + fn, 0), 0)"
RATES = f"{_PREC} AS precision, {_REC} AS recall, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy, coalesce(2 * {_PREC} * {_REC} / nullif({_PREC} + {_REC}, 0), 0) AS f1"


def report(source: str, thresholds: str) -> str:
    """Rows of ("set", tp, fp, fn, tn, rates, auroc) of source under thresholds ("set", threshold)."""
    return f"""SELECT a."set", tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(auroc, 6) AS auroc FROM
 (SELECT *, {RATES} FROM (SELECT s."set", count(*) FILTER (label = 1 AND score > threshold) AS tp, count(*) FILTER (label = 0 AND score > threshold) AS fp, count(*) FILTER (label = 1 AND score <= threshold) AS fn, count(*) FILTER (label = 0 AND score <= threshold) AS tn FROM {source} s JOIN {thresholds} h ON s."set" = h."set" GROUP BY s."set")) a
 JOIN (SELECT "set", sum(CASE WHEN label = 1 THEN rk END) / (any_value(np) * any_value(nq)) - (any_value(np) + 1) / (2.0 * any_value(nq)) AS auroc FROM
  (SELECT "set", label, rank() OVER (PARTITION BY "set" ORDER BY score) + (count(*) OVER (PARTITION BY "set", score) - 1) / 2.0 AS rk, sum(label) OVER (PARTITION BY "set") AS np, sum(1 - label) OVER (PARTITION BY "set") AS nq FROM {source}) GROUP BY "set") b ON a."set" = b."set" """
