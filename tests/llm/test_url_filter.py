import re
from itertools import combinations

from pyspark.sql import functions as F

from quern.llm import url_filter as U
from tests.llm import cases

URLS = [
    (1, "https://Example.COM/en/1?x=1#y"), (2, "http://a.example.com/en/77"), (3, "http://notexample.com/en/7"), (4, "https://x.net/de/8"), (5, "https://example.net/de/81"), (6, None), (7, "no scheme"), (8, "://"),
    (9, "a://b://c/d"), (10, "http://host?q=/en/"), (11, "http://com/en/"), (12, "http://x.org/es"), (13, "http://x.org/es/"), (13, "http://x.org/es/"), (None, "http://é.com/en/ü"), (14, "http://HOST.com\n/en/"), (15, ""),
]


def judge(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(h + p, kind) for kind, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, kind = max(fit, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, kind


def test_given_rules(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string")
    got = cases.same_with_clashes(lambda d: U.url_filter(d), df, "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([(i, h, p, r, k or "allow") for i, u in URLS for h, p, r, k in [judge(u)]], key=repr)


def test_mining_and_matching_against_brute_force(spark):
    sets = [({"a", "b"}, "block")] * 9 + [({"a", "c"}, "allow")] * 9 + [({"b", "c"}, "allow")] * 8 + [({"a", "b", "d"}, "block")] * 4 + [({"d"}, "allow"), ({"e"}, None)]
    df = spark.createDataFrame([(sorted(s), k) for s, k in sets], "tokens array<string>, label string")
    least, sure = 8 / (len(sets) - 1), 0.9
    want = {}
    items = sorted({x for s, _ in sets for x in s})
    for n in range(1, 5):
        for c in combinations(items, n):
            inside = [k for s, k in sets if k and set(c) <= s]
            for v in ("allow", "block"):
                if inside and inside.count(v) / (len(sets) - 1) >= least and inside.count(v) / len(inside) >= sure:
                    want[c, v] = inside.count(v) / len(inside)
    want = {(c, v) for (c, v), p in want.items() if not any(v2 == v and set(c2) < set(c) and p2 >= p for (c2, v2), p2 in want.items())}
    mined, known = U.mine(df, least, sure)
    assert {(tuple(r.tokens), r.verdict) for r in mined.collect()} == want and want
    met = {tuple(r.tokens): r.mined_verdict for r in U.match(df.select("tokens").distinct(), mined, known).collect()}
    assert met[("a", "b")] == "block" and met[("a", "c")] == "allow" and ("e",) not in met


def test_mined_rules_decide(spark):
    rows = [(i, f"https://good{i % 7}.site.example/news/{i}") for i in range(60)] + [(i, f"https://casino{i % 7}.site.example/bets/{i}") for i in range(60, 120)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.where("page_id % 2 = 0").select("page_id", F.when(F.col("page_id") < 60, "allow").otherwise("block").alias("label"))
    got = U.url_filter(pages, labels=labels).collect()
    assert all(r.verdict == ("allow" if r.page_id < 60 else "block") for r in got) and all(r.mined_rule for r in got)


def test_urls_of_forty_parts_in_bulk(spark):
    """Equal long urls are one item; a page with any of their parts meets the rule, and labels that contradict count as block."""
    deep = "https://deep.example/" + "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    rows = [(i, deep) for i in range(40)] + [(i, f"https://good.example/x/{i}") for i in range(40, 80)] + [(100, "https://elsewhere.example/" + "z/" * 8 + "partaa"), (101, deep)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.where("page_id < 80").select("page_id", F.when(F.col("page_id") < 40, "block").otherwise("allow").alias("label"))
    labels = labels.unionByName(spark.createDataFrame([(3, "allow"), (101, None)], "page_id long, label string"))
    tokens = U.tokens()
    some = U.with_parts(pages).select("page_id", tokens.alias("tokens")).join(labels.where("label is not null"), "page_id")
    mined, known = U.mine(some, 0.002, 0.9)
    assert mined.count() < 20 and known.count() > 40
    got = {r.page_id: r.verdict for r in U.url_filter(pages, labels=labels).collect()}
    assert all(got[i] == ("block" if i < 40 else "allow") for i in range(80)) and got[101] == "block"


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in U.url_filter(pages).join(pages.select("page_id", "url"), "page_id").collect():
        h, p, rule, kind = judge(r.url)
        assert (r.host, r.path, r.rule) == (h, p, rule) and (kind is None or r.verdict == kind)


def test_no_rows(spark):
    assert U.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
