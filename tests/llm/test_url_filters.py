import duckdb

from weftline.llm import url_filters


def test_rules_and_parts(spark):
    rows = [
        (0, None), (1, ""), (2, "no scheme.org/x"), (3, "http://A.Example.ORG"), (4, "http://a.Example.org/"), (5, "https://example.org/es/1?x"), (6, "http://x.example.org/en/1234#t"),
        (7, "http://notexample.org/es/1"), (8, "http://a.com/fr/1"), (9, "http://a.com/de/"), (10, "http://a.com/de"), (11, "http://org/?q"), (12, "ftp://b.net?x/y"), (13, "http://u/http://v.org/"), (13, "http://u/http://v.org/"),
    ]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame([(i, u, None, "x") for i, u in rows], "page_id bigint, url string, html string, host string")).collect())
    assert got == [
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.org", "", None, "allow"), (4, "a.example.org", "/", "org/", "allow"), (5, "example.org", "/es/1", "example.org/es/", "block"),
        (6, "x.example.org", "/en/1234", "example.org/en/1", "block"), (7, "notexample.org", "/es/1", "org/", "allow"), (8, "a.com", "/fr/1", "com/fr/", "allow"), (9, "a.com", "/de/", "com/de/", "block"), (10, "a.com", "/de", None, "allow"),
        (11, "org", "/", "org/", "allow"), (12, "b.net", "", None, "allow"), (13, "u", "/http://v.org/", None, "allow"), (13, "u", "/http://v.org/", None, "allow"),
    ]


def test_propagation_equals_sql(spark, tmp_path):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/x">t</a><a href=/own>u</a>' for h in hosts)
    rows = [
        (0, "http://good.org/a", link("Friend.net", "good.org")), (1, "http://friend.net/a", link("other.net", "bad.com")), (2, "http://bad.com/de/1", link("good.org")), (3, "http://spam.net/", link("bad.com")), (4, "http://deep.net/", link("spam.net")),
        (5, "http://other.net/", ""), (6, "http://lone.net/", None), (7, None, link("bad.com")), (8, "http://spam.net/2", link("bad.com", "bad.com")),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df).collect())
    assert [v for *_, v in got] == ["allow", "allow", "block", "block", "block", "allow", "allow", "allow", "block"]
    pages = df.toPandas()  # noqa: F841
    assert got == sorted(duckdb.sql(url_filters.oracle()).fetchall())
    assert url_filters.judge(df.limit(0)).count() == 0


def test_a_hub_and_a_very_long_page(spark):
    """A hub that 3,000 hosts link to, a page of a million characters with links to all of them, and a blocked host that only the hub links to."""
    hosts = [f"h{i}.net" for i in range(3_000)]
    rows = [(i, f"http://{h}/", '<a href="http://hub.net/">x</a>') for i, h in enumerate(hosts)]
    rows += [(3_000, "http://hub.net/", "".join(f'<a href="http://{h}/">x</a>{"y" * 300}' for h in hosts)), (3_001, "http://liker.net/", '<a href="http://bad.com/">x</a>'), (3_002, "http://bad.com/de/1", "")]
    got = {r.page_id: r.verdict for r in url_filters.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows) and {i for i, v in got.items() if v == "block"} == {3_001, 3_002}
