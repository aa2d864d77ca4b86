"""URL verdicts against a direct reading of the rules."""

import re

from corvane.llm.urls import RULES, Rule, judge, op7_url_rules


def expected(url, rules=RULES, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), r.verdict), default=None)
    return host, path, best and best.text, best.verdict if best else default


def test_pages(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op7_url_rules(spark, sf_dir).collect():
        assert (r.host, r.path, r.rule, r.verdict) == expected(urls[r.page_id])


URLS = [
    None, "", "x", "http://", "http://com/", "http://com", "http://xcom/", "HTTP://WWW.Example.COM/en/?q#f", "http://example.com/en", "http://example.com/en/a?x=/fr/", "http://example.com:80/en/", "a://b://c.net/es/",
    "http://a.b.c.d.e.f.g.net/fr/" + "x/" * 3000, "http://net?/es/", "http://.com/", "http://com./", "http://É.com/É", "http://user@www.example.com/en/#", "http://" + "a." * 2000 + "net/es/", "http://c.net/es/\n?x", "http://com/", "http://com/",
]


def test_edges(spark):
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, digest int")
    got = {r[0]: tuple(r)[-4:] for r in judge(df).collect()}
    assert got == {i: expected(u) for i, u in enumerate(URLS)}
    assert judge(df.limit(0)).collect() == []
    assert {r.verdict for r in judge(df, ()).collect()} == {"allow"}


def test_other_rules(spark):
    rules = (Rule("block", "com", ""), Rule("allow", "example.com", "/e"), Rule("allow", "c.net", "/es"), Rule("block", "c.net", "/es"), Rule("allow", "com", "/"))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r[0]: tuple(r)[-4:] for r in judge(df, rules, default="block").collect()}
    assert got == {i: expected(u, rules, "block") for i, u in enumerate(URLS)}


def test_ties_of_equal_length(spark):
    rules = [Rule("allow", "a.com", "/x/"), Rule("block", "com", "/x/y/"), Rule("allow", "com", "/x/y/")]
    df = spark.createDataFrame([(1, "http://a.com/x/y/z"), (2, "http://a.com/x/"), (3, "http://b.com/x/y/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge(df, rules).collect()}
    assert len("a.com/x/") == 8 and len("com/x/y/") == 8
    assert got == {1: ("com/x/y/", "block"), 2: ("a.com/x/", "allow"), 3: ("com/x/y/", "block")}
