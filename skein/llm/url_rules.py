"""URL filters by association rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import cut

#: Share of the labelled URLs that a rule's tokens and the label must occur in together, and fewest of them.
MIN_SUPPORT = 0.002
MIN_COUNT = 5
#: Share of the URLs with a rule's tokens that are bad.
MIN_CONFIDENCE = 0.5
#: Most tokens of a rule; None: any number.
MOST_TOKENS = None
BAD = "\x00bad"


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: what its scheme, host labels, path and query are made of, marked with where they stand; numbers are left out."""
    low = F.lower(url)
    host = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rest = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    mark = lambda p, c, sep: F.transform(F.split(c, sep), lambda x: F.when((x != "") & ~x.rlike(r"^\d+$"), F.concat(F.lit(p), x)))
    return F.array_compact(F.array_distinct(F.concat(mark("s:", F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*)://", 1), "://"), mark("h:", host, r"\."), mark("p:", path, r"[^\p{L}\p{N}]+"), mark("q:", query, r"[^\p{L}\p{N}]+"))))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose URL's path names a labelled document, /language/doc_id: bad where it is toxic or of low quality."""
    verdict = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(((F.coalesce("toxic", F.lit(0)) > 0) | (F.coalesce("quality", F.lit(1)) < 1)).cast("int")).alias("bad"))
    return pages.select("url", F.expr(r"try_cast(regexp_extract(url, '://[^/]*/[a-z]+/([0-9]+)', 1) as long)").alias("__id")).join(verdict, "__id").select("url", "bad")


def _classes(tok: DataFrame, least: int) -> DataFrame:
    """(t, rep, n, n_bad) of the tokens (row, bad, t) that occur in ``least`` bad rows: rep is the least token that occurs in exactly the same rows."""
    per = tok.groupBy("t").agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    per = cut(per.where(F.col("n_bad") >= least))
    like = per.groupBy("n", "n_bad", "x", "y").agg(F.min("t").alias("rep"))
    per = per.join(like, ["n", "n_bad", "x", "y"]).select("t", "rep", "n", "n_bad")
    # equal hashes are no proof: the representative must be in each of the token's rows
    other = tok.join(per.where("t <> rep"), "t").select("row", "t", "rep")
    both = other.join(tok.select("row", F.col("t").alias("rep")), ["row", "rep"]).groupBy("t").agg(F.count("*").alias("both"))
    return cut(per.join(both, "t", "left").select("t", F.when(F.col("both") == F.col("n"), F.col("rep")).otherwise(F.col("t")).alias("rep"), "n", "n_bad"))


def mine(known: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, most_tokens: int | None = MOST_TOKENS, min_count: int = MIN_COUNT) -> DataFrame:
    """(tokens, members, confidence, support): rules of at most most_tokens tokens, sorted, that say that a URL is bad, from (url, bad).

    FP-growth finds the token sets that are frequent together with the label; those whose share of bad
    URLs is below min_confidence are pruned, and those that add tokens to a rule of no less confidence.
    support counts URLs with the tokens and the label.

    Tokens that are too rare together with the label are left out before. Tokens that occur in exactly the same URLs are mined as one, the least of them: a set
    with two of them adds nothing to that with one. members has, for each token of a rule, all that it stands for, and each choice among them is
    a rule. A token of all URLs is in no rule but its own. So the many tokens that come with one long URL cost no more than one.
    """
    spark = known.sparkSession
    rows = cut(known.where("url is not null").select(url_tokens(F.col("url")).alias("tokens"), (F.col("bad") > 0).cast("int").alias("bad")))
    n = rows.count()
    least = max(min_count, -(-int(round(n * min_support * 1e9)) // 10**9))
    kind = "tokens array<string>, members array<array<string>>, confidence double, support long"
    if n < least or not n:
        return spark.createDataFrame([], kind)
    tok = rows.select(F.monotonically_increasing_id().alias("row"), "bad", "tokens").select("row", "bad", F.explode("tokens").alias("t"))
    classes = _classes(tok, least)
    single = classes.where(F.col("n") == n).groupBy("rep").agg((F.max("n_bad") / F.max("n")).alias("confidence"), F.max("n_bad").alias("support"))
    single = single.where(F.col("confidence") >= min_confidence).select(F.array("rep").alias("tokens"), "confidence", "support")
    told = tok.join(classes.where((F.col("rep") == F.col("t")) & (F.col("n") < n)).select("t"), "t", "left_semi")
    baskets = cut(told.groupBy("row", "bad").agg(F.collect_list("t").alias("items")).select(F.concat("items", F.when(F.col("bad") > 0, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")))
    found = _mined(baskets, least, min_confidence, most_tokens).union(single)
    # what each token stands for
    members = classes.groupBy("rep").agg(F.sort_array(F.collect_list("t")).alias("m"))
    rule = found.select(F.col("tokens").alias("__rule"), "confidence", "support", F.posexplode("tokens").alias("place", "rep")).join(members, "rep")
    rule = rule.groupBy("__rule", "confidence", "support").agg(F.sort_array(F.collect_list(F.struct("place", "m"))).alias("x"))
    return cut(rule.select(F.col("__rule").alias("tokens"), F.col("x.m").alias("members"), "confidence", "support"))


def _mined(baskets: DataFrame, least: int, min_confidence: float, most_tokens: int | None) -> DataFrame:
    """(tokens, confidence, support) of the rules over baskets of representatives."""
    spark = baskets.sparkSession
    out = spark.createDataFrame([], "tokens array<string>, confidence double, support long")
    n = baskets.count()
    if not n:
        return out
    # half a URL less, so that rounding loses no set; exact counts decide below
    fitted = FPGrowth(itemsCol="items", minSupport=max(least - 0.5, 0.5) / n, minConfidence=0.0).fit(baskets)
    sets = fitted.freqItemsets.select(F.sort_array("items").alias("items"), "freq")
    both = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("support"))
    rules = both.join(sets.where(~F.array_contains("items", BAD)).select(F.col("items").alias("tokens"), F.col("freq").alias("all")), "tokens")
    rules = rules.where(F.col("support") >= least).select("tokens", (F.col("support") / F.col("all")).alias("confidence"), "support")
    if most_tokens is not None:
        rules = rules.where(F.size("tokens") <= most_tokens)
    rules = cut(rules)
    # by size: the subsets of a frequent set are all there, and those of one token less know the best rule in them
    best = None
    for n in range(1, (rules.agg(F.max(F.size("tokens"))).first()[0] or 0) + 1):
        level = rules.where(F.size("tokens") == n)
        if best is None:
            level = level.withColumn("below", F.lit(-1.0))
        else:
            less = level.select("tokens", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("sub"))
            less = less.join(best.withColumnRenamed("tokens", "sub"), "sub").groupBy("tokens").agg(F.max("best").alias("below"))
            level = level.join(less, "tokens")
        level = cut(level)
        best = level.select("tokens", F.greatest("below", F.when(F.col("confidence") >= min_confidence, F.col("confidence"))).alias("best"))
        out = out.union(level.where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("below"))).select("tokens", "confidence", "support"))
    return out


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages' (page_id, url) with n_rules, confidence and drop: how many rules match, the greatest confidence, and whether any does.

    The rules' tokens, and those that they stand for, are an inverted index: a URL's tokens look up rules, and those of which a token was found in each place match,
    as many times as there are choices of the found ones. Spark broadcasts the index if its size allows it, else it is shuffled.
    """
    index = rules.select(F.col("tokens").alias("rule"), "confidence", F.posexplode("members").alias("place", "m")).select("rule", "place", F.size("rule").alias("need"), "confidence", F.explode("m").alias("token"))
    urls = pages.select("url").where("url is not null").distinct()
    hits = urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token")).join(index, "token")
    hits = hits.groupBy("url", "rule", "place").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("confidence").alias("confidence"))
    hits = hits.groupBy("url", "rule").agg(F.count("*").alias("places"), F.first("need").alias("need"), F.product("n").alias("n"), F.first("confidence").alias("confidence")).where("places = need")
    hits = hits.groupBy("url").agg(F.sum("n").alias("n_rules"), F.max("confidence").alias("confidence"))
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").join(hits, "url", "left")
    return out.select("page_id", "url", F.least(F.coalesce("n_rules", F.lit(0.0)), F.lit(float(1 << 53))).cast("long").alias("n_rules"), F.round(F.coalesce("confidence", F.lit(0.0)), 6).alias("confidence"), F.col("n_rules").isNotNull().alias("drop"))


def url_filter(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, most_tokens: int | None = MOST_TOKENS, min_count: int = MIN_COUNT) -> DataFrame:
    """A row for each page: (page_id, url, n_rules, confidence, drop), by rules mined from the labels of all pages that have one.

    Without labelled pages there are no rules and all pages stay. A NULL, empty or malformed URL has few or no tokens and matches
    no rule that needs others; repeated rows are judged each. URLs may be of any length and repeat. Other columns are not looked at.
    """
    rules = mine(labelled(pages, labels), min_support, min_confidence, most_tokens, min_count)
    return matched(pages, rules)


ORACLE = r"""
WITH u AS (SELECT DISTINCT url, lower(url) AS low FROM pages WHERE url IS NOT NULL),
parts AS (
  SELECT url, regexp_extract(low, '^([a-z][a-z0-9+.-]*)://', 1) AS scheme,
    regexp_extract(low, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS host,
    regexp_extract(regexp_replace(low, '^[a-z][a-z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1) AS path,
    regexp_extract(regexp_replace(low, '^[a-z][a-z0-9+.-]*://[^/?#]*', ''), '\?([^#]*)', 1) AS query FROM u),
raw AS (
  SELECT url, 's:' AS m, scheme AS x FROM parts UNION ALL
  SELECT url, 'h:', unnest(string_split(host, '.')) FROM parts UNION ALL
  SELECT url, 'p:', unnest(regexp_split_to_array(path, '[^\p{L}\p{N}]+')) FROM parts UNION ALL
  SELECT url, 'q:', unnest(regexp_split_to_array(query, '[^\p{L}\p{N}]+')) FROM parts),
tok AS (SELECT DISTINCT url, m || x AS t FROM raw WHERE x <> '' AND NOT regexp_full_match(x, '\d+')),
verdict AS (SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) > 0 OR coalesce(quality, 1) < 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
known AS (
  SELECT row_number() OVER () AS b, url, bad
  FROM (SELECT url, try_cast(regexp_extract(url, '://[^/]*/[a-z]+/([0-9]+)', 1) AS BIGINT) AS doc_id FROM pages) JOIN verdict USING (doc_id) WHERE url IS NOT NULL),
least_count AS (SELECT greatest(5, ceil(count(*) * 0.002)) AS n FROM known),
i AS (SELECT b, bad, t FROM known JOIN tok USING (url)),
sets AS (
  SELECT [t] AS tokens, count(*) AS n, sum(bad) AS bad FROM i GROUP BY t UNION ALL
  SELECT [x.t, y.t], count(*), sum(x.bad) FROM i x JOIN i y ON x.b = y.b AND x.t < y.t GROUP BY x.t, y.t UNION ALL
  SELECT [x.t, y.t, z.t], count(*), sum(x.bad) FROM i x JOIN i y ON x.b = y.b AND x.t < y.t JOIN i z ON y.b = z.b AND y.t < z.t GROUP BY x.t, y.t, z.t),
good AS (SELECT tokens, bad / sets.n AS confidence FROM sets, least_count WHERE bad >= least_count.n AND bad / sets.n >= 0.5),
rules AS (
  SELECT row_number() OVER () AS rule, tokens, confidence FROM good g
  WHERE NOT EXISTS (SELECT 1 FROM good s WHERE len(s.tokens) < len(g.tokens) AND list_has_all(g.tokens, s.tokens) AND s.confidence >= g.confidence)),
idx AS (SELECT rule, confidence, len(tokens) AS need, unnest(tokens) AS t FROM rules),
hits AS (SELECT url, rule, any_value(confidence) AS confidence FROM tok JOIN idx USING (t) GROUP BY url, rule HAVING count(*) = any_value(need)),
per AS (SELECT url, count(*) AS n_rules, max(confidence) AS confidence FROM hits GROUP BY url)
SELECT page_id, pages.url, coalesce(n_rules, 0) AS n_rules, round(coalesce(confidence, 0), 6) AS confidence, n_rules IS NOT NULL AS drop
FROM pages LEFT JOIN per ON pages.url = per.url
"""
