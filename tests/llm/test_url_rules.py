import time
from itertools import combinations, product

from pyspark.sql import functions as F

from skein.llm import url_rules as U

from .conftest import got


def tokens(spark, url):
    return spark.createDataFrame([(url,)], "url string").select(U.url_tokens(F.col("url"))).first()[0]


def test_tokens(spark):
    assert sorted(tokens(spark, "HTTPS://www.Shop.example/a/b-c/12?id=7&Ref=b#x")) == sorted(["s:https", "h:www", "h:shop", "h:example", "p:a", "p:b", "p:c", "q:id", "q:ref", "q:b"])
    assert tokens(spark, "") == [] and tokens(spark, "Plain Words") == ["p:plain", "p:words"]


def brute(known, min_support, min_confidence, most, min_count, split):
    baskets = [(frozenset(split(u)), b) for u, b in known if u is not None]
    least = max(min_count, -(-int(round(len(baskets) * min_support * 1e9)) // 10**9))
    good = {}
    for n in range(1, most + 1):
        for s in {c for t, _ in baskets for c in combinations(sorted(t), n)}:
            hits = [b for t, b in baskets if t.issuperset(s)]
            if sum(hits) >= least and sum(hits) / len(hits) >= min_confidence:
                good[s] = (sum(hits) / len(hits), sum(hits))
    return {s: v for s, v in good.items() if not any(len(o) < len(s) and set(o) < set(s) and good[o][0] >= v[0] for o in good)}


def spelt(rules):
    """Rules with each choice among the tokens that theirs stand for."""
    return {tuple(sorted(c)): (round(r.confidence, 9), r.support) for r in rules.collect() for c in product(*r.members)}


def test_rules_and_matches_equal_brute_force(spark):
    urls = [f"http://h{i % 7}.example/{'ads' if i % 3 == 0 else 'news'}/x{i % 4}?k={i % 2}q" for i in range(160)]
    known = [(u, int("ads" in u and i % 10 > 0 or "h3" in u and "x1" in u)) for i, u in enumerate(urls)]
    split = lambda u: tokens_of[u]
    frame = spark.createDataFrame(known, "url string, bad int")
    tokens_of = {r.url: r.t for r in frame.select("url", U.url_tokens(F.col("url")).alias("t")).collect()}
    rules = U.mine(frame, 0.01, 0.6, 3, 3)
    want = brute(known, 0.01, 0.6, 3, 3, split)
    assert spelt(rules) == {s: (round(c, 9), n) for s, (c, n) in want.items()}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in U.matched(pages, rules).collect():
        hit = [c for s, (c, _) in want.items() if set(s) <= set(split(r.url))]
        assert (r.n_rules, r.confidence, r["drop"]) == (len(hit), round(max(hit, default=0), 6), bool(hit))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, 0, 1) for i in range(20)] + [(None, 1, None), (30, None, None)] + [(i, 1, 0) for i in range(100, 130)], "doc_id long, quality int, toxic int")
    rows = [(i, f"https://{'bad' if i < 20 else 'good'}.example/en/{i}") for i in [*range(20), *range(100, 130)]] + [(30, "https://good.example/en/30"), (40, None), (41, ""), (42, "not a url"), (43, "https://bad.example/en/5"), (43, "https://bad.example/en/5"), (None, "https://bad.example/" + "x/" * 50_000)]
    pages = spark.createDataFrame([(*r, "<p>", "x", "y") for r in rows], "page_id long, url string, html string, token string, rule string")
    out = U.url_filter(pages, labels)
    assert out.columns == ["page_id", "url", "n_rules", "confidence", "drop"]
    have = [(r.page_id, r["drop"]) for r in out.collect()]
    assert len(have) == len(rows)
    assert {d for i, d in have if i in (30, 40, 41, 42) or i is not None and i >= 100} == {False} and all(d for i, d in have if i is None or i < 20 or i == 43)
    assert {r["drop"] for r in U.url_filter(pages, labels.where("false")).collect()} == {False}
    assert got(U.url_filter(pages.where("false"), labels)) == []


def test_rules_of_any_number_of_tokens(spark):
    good = [f"x://{h}" for h in ("a.b.c", "a.b.d", "a.c.d", "b.c.d") for _ in range(8)]
    known = [(u, 0) for u in good] + [("x://a.b.c.d", 1)] * 6 + [("x://q.r", 1)] * 5
    frame = spark.createDataFrame(known, "url string, bad int")
    tokens_of = {r.url: r.t for r in frame.select("url", U.url_tokens(F.col("url")).alias("t")).collect()}
    rules = U.mine(frame, 0.002, 0.5, min_count=5)
    want = brute(known, 0.002, 0.5, 5, 5, tokens_of.get)
    assert spelt(rules) == {s: (round(c, 9), n) for s, (c, n) in want.items()}
    assert ("h:a", "h:b", "h:c", "h:d") in want and max(map(len, want)) == 4


def test_tokens_that_come_together(spark):
    """Equal occurrences, a token of all URLs and nested ones, against brute force."""
    known = [("x://all.h.a.b.c", 1)] * 6 + [("x://all.h.a.b.d", 0)] * 2 + [("x://all.e", 0)] * 9 + [("x://all.a.b.f.g", 1)] * 5
    frame = spark.createDataFrame(known, "url string, bad int")
    tokens_of = {r.url: r.t for r in frame.select("url", U.url_tokens(F.col("url")).alias("t")).collect()}
    for confidence in (0.5, 0.45, 0.9):
        rules = U.mine(frame, 0.002, confidence, min_count=5)
        want = brute(known, 0.002, confidence, 6, 5, tokens_of.get)
        assert spelt(rules) == {s: (round(c, 9), n) for s, (c, n) in want.items()}
        for r in U.matched(frame.selectExpr("1 as page_id", "url").distinct(), rules).collect():
            hit = [c for s, (c, _) in want.items() if set(s) <= set(tokens_of[r.url])]
            assert (r.n_rules, r.confidence, r["drop"]) == (len(hit), round(max(hit, default=0), 6), bool(hit))


def test_long_urls_that_repeat(spark):
    """All subsets of a long URL's tokens are frequent when it repeats; one of them is mined."""
    url = "http://h.example/" + "/".join(f"t{i}x" for i in range(60))
    known = [(url, 1)] * 100 + [(f"http://h.example/ok/p{i}z", 0) for i in range(300)]
    t = time.time()
    rules = U.mine(spark.createDataFrame(known, "url string, bad int"))
    r, = rules.collect()
    assert r.tokens == ["p:t0x"] and len(r.members[0]) == 60 and (r.confidence, r.support) == (1.0, 100) and time.time() - t < 60
    out = U.matched(spark.createDataFrame([(1, url), (2, "http://h.example/t7x/t9x")], "page_id long, url string"), rules).collect()
    assert sorted((x.page_id, x.n_rules) for x in out) == [(1, 60), (2, 2)]
