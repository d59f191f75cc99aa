from netquarry.llm import url_reputation as ur

RULES = [ur.Rule("com", "/", "allow"), ur.Rule("example.com", "/en/", "block"), ur.Rule("www.example.com", "/en/", "allow"), ur.Rule("net", "/es/", "block")]
PAGES = "page_id long, url string, host string, rule string"


def _judge(spark, urls, outcomes, rules=RULES):
    pages = spark.createDataFrame([(i, u, "c", "c") for i, u in enumerate(urls)], PAGES)
    return {r.page_id: r for r in ur.judge(pages, spark.createDataFrame(outcomes, "_url string, outcome int"), rules).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://A.Example.COM/en/1?x#y", "https://www.example.com/en/2", "http://x.com", "http://x.com?q=/en/", "http://a.b.net/es/1",
        "http://notnet/es/1", None, "no scheme/en/", "", "http://", "a://b://c/d", "http://É.net/es", "x://com/#",
    ]
    got = _judge(spark, urls, [])
    parts = [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))]
    assert parts == [
        ("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/2", "www.example.com/en/"), ("x.com", "", None),
        ("x.com", "", None), ("a.b.net", "/es/1", "net/es/"), ("notnet", "/es/1", None), ("", "", None), ("", "", None), ("", "", None),
        ("", "", None), ("b:", "//c/d", None), ("É.net", "/es", None), ("com", "/", "com/"),
    ]
    assert [got[i].verdict for i in (0, 1, 4)] == ["block", "allow", "block"]
    assert all(abs(r.bad_rate - 0.5) < 1e-9 and r.verdict == "allow" for i, r in got.items() if r.rule is None)


def test_shrinking_to_parents(spark):
    bad = [(f"http://bad.one.org/{i}", 0) for i in range(40)]
    good = [(f"http://h{k}.two.org/{i}", 1) for k in range(5) for i in range(40)]
    urls = ["http://bad.one.org/x", "http://new.one.org/x", "http://h1.two.org/x", "http://new.two.org/x", "http://new.three.org/x"]
    got = _judge(spark, urls, [*bad, *good, ("http://h1.two.org/9", None)])
    rate = [got[i].bad_rate for i in range(5)]
    assert rate[0] > rate[1] > rate[4] > rate[3] and rate[0] > 0.8 and rate[2] < 0.1
    assert [got[i].verdict for i in range(5)][0::2] == ["block", "allow", "allow"]


def test_levels(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "a.b.org", "localhost", "x.y.org:8080", "user@z.org"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    rows = df.select(*[c.alias(n) for c, n in zip(ur.levels(df.h), ("d", "s"), strict=True)]).collect()
    assert [(r.d, r.s) for r in rows] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("b.org", "org"), ("localhost", "localhost"), ("y.org", "org"), ("z.org", "org")]


def test_empty_table(spark):
    assert _judge(spark, [], []) == {}
