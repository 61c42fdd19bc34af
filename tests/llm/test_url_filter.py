import random
import re

import duckdb
import pytest

from ledgerloom.llm.url_filter import HOST_RULES, PATTERNS, RULES, compiled, host_rule, judge, pattern_rule, report, rule_table, sql

URLS = [None, "", "no scheme", "http://", "HTTP://A.Org", "http://a.org/", "http://org/x", "http://xorg/", "http://www.Example.org/es/1?q", "http://example.org/es",
        "https://m.example.org/en/12", "https://m.example.org/en/2#t", "http://a.com/fr/1", "http://a.com/FR/1", "http://a.com/de/", "http://com/de/x", "http://a.net/ads/1",
        "http://ads.a.net/", "http://loads.net/", "http://a.net/login/x?redirect=1", "http://a.com/fr/ads/", "http://é.org/ü", "x://a.org:80/", "a://b://c.org/", "http://a.net/#ads", "http://a.net/\nads\n"]


def test_equals_sql(spark):
    rows = [(k % 20, u, "h", "r") for k, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(3)
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [r[:2] for r in rows])
    want = sorted(con.execute(sql()).fetchall(), key=str)
    for limit in (20_000, 0):
        got = sorted((tuple(r) for r in report(df, broadcast_rules=limit).collect()), key=str)
        assert got == want
    assert {w[3] for w in want} == {None, *(t for _, t in HOST_RULES)}
    assert judge(df.where("false")).count() == 0


def test_rules_keep_only_whole_tokens():
    assert host_rule("block", "example.org/en/1").tokens == ("example", "org", "en")
    assert pattern_rule("^ads^*x^track^").tokens == ("ads", "track")
    assert all(pattern_rule(p).tokens for p in PATTERNS)


@pytest.mark.parametrize("url,hit", [("http://a/ads", True), ("http://a/adsx", False)])
def test_rule_without_tokens_is_always_a_candidate(spark, url, hit):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    assert report(df, host_rules=[], patterns=["ads^"]).first().verdict == ("block" if hit else "allow")


def test_rules_compile_alike(spark):
    odd = [*PATTERNS, "^a.b?c=(d)^*$x^", "/ads/*.gif", "|[^]", "é^ü"]
    got = {r["rule"]: r for r in compiled(rule_table(spark, HOST_RULES, odd)).collect()}
    for text in odd:
        assert (got[text]["regex"], tuple(got[text]["tokens"])) == (pattern_rule(text).regex, pattern_rule(text).tokens)
    for verdict, text in HOST_RULES:
        assert (got[text]["regex"], tuple(got[text]["tokens"])) == (host_rule(verdict, text).regex, host_rule(verdict, text).tokens)


def test_table_of_thousands_of_rules(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    rules = [("host", rng.choice(["allow", "block"]), f"{word()}.com/{rng.choice(['', word()])}") for _ in range(800)]
    rules += [("pattern", rng.choice(["allow", "block", "block"]), rng.choice(["^{}^", "/{}/*.gif", "^{}^*^{}^", ".{}."]).replace("{}", word())) for _ in range(2500)] + [("pattern", "block", None)]
    urls = [f"http://{word()}.{word()}.com/{word()}/{word()}.{rng.choice(['gif', 'html'])}?{word()}=1" for _ in range(600)] + ["http://a1.com/" + "x/" * 20000 + "b2/q.gif"]
    got = {r["url"]: (r["rule"], r["verdict"], r["pattern"]) for r in judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules=spark.createDataFrame(rules, RULES)).select("row.url", "rule", "verdict", "pattern").collect()}
    hosts, patterns = [(v, t) for k, v, t in rules if k == "host"], [(v, t, re.compile(pattern_rule(t).regex)) for k, v, t in rules if k == "pattern" and t]
    for u in set(urls):
        host, path = u[7:].split("/", 1)[0], "/" + u[7:].split("/", 1)[1].split("?")[0]
        fits = [(len(t), v, t) for v, t in hosts if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        hit = min(((v, t) for v, t, r in patterns if r.search(u.lower())), default=None)
        want = (max(fits)[2], max(fits)[1], None) if fits else (None, hit[0], hit[1]) if hit else (None, "allow", None)
        assert got[u] == want
    assert {v for _, v, _ in got.values()} == {"allow", "block"}
