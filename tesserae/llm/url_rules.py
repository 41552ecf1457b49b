"""URL filters: explicit host and path rules first, then association rules mined from labelled URLs.

Spark FP-growth (JVM) mines combinations of URL tokens with the label of their page; rules whose consequent is the
label are pruned by support and confidence, then by minimality; they may have any number of tokens. Matching uses an inverted index: a rule stands under
the one of its tokens that fewest rules share, pages' tokens are joined with the index, and a hit needs all tokens of the rule. DataFrame functions
and the JVM's FP-growth only.

Labels: a page is bad if labels.toxic of the doc_id equal to its page_id is 1, good if it is 0; pages without
a label are not learned from.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A mined rule holds for at least this share of labelled pages, and this many; and for this share of those that match it.
MIN_SUPPORT = 0.005
MIN_COUNT = 5
MIN_CONFIDENCE = 0.8
BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    has = F.coalesce(at > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host labels, path segments with digits as #, query keys, scheme; none without a host."""
    at = F.instr(url, "://")
    scheme = F.concat(F.lit("s:"), F.translate(F.substr(url, F.lit(1), at - 1), _UPPER, _LOWER))
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    question = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(question, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^([^=]*)", 1)))
    all_ = F.filter(F.concat(F.array(scheme), labels, parts, keys), lambda x: F.length(x) > 2)
    return F.when(host != "", F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule (like net/) that fits, else null. rules is a short literal list."""
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def classes(labelled: DataFrame, least: int) -> DataFrame:
    """(token, class) of the tokens that at least so many bad rows hold, which all tokens of a rule must be.

    Tokens that stand in the same labelled rows are one class, named by its least token: alone they would be in every
    combination with each other, and the number of combinations doubles with each. Rows are told by two sums of hashes.
    """
    one = labelled.withColumn("row", F.monotonically_increasing_id()).select("bad", "row", F.explode("tokens").alias("token"))
    rows = [F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("s2")]
    of = one.groupBy("token").agg(F.count_if("bad").alias("n_bad"), *rows).where(F.col("n_bad") >= least)
    # at most the tokens of a URL divided by MIN_SUPPORT of them
    of = written(of.select("token", "n", "s1", "s2"), "tokens")
    names = of.groupBy("n", "s1", "s2").agg(F.min("token").alias("class"))
    return written(of.join(names, ["n", "s1", "s2"]).select("token", "class"), "classes")


def in_classes(df: DataFrame, of: DataFrame, *keys: str) -> DataFrame:
    """(keys, tokens): the distinct classes of each row's tokens, for rows that have any."""
    one = df.select(*keys, F.explode("tokens").alias("token")).join(of, "token")
    return one.groupBy(*keys).agg(F.collect_set("class").alias("tokens"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (tokens sorted, support, confidence) of token classes from (tokens, bad), and the classes (token, class).

    No labelled row or no bad row: no rule."""
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "tokens array<string>, support long, confidence double")
    n, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    least = max(min_count, math.ceil(min_support * n))
    if not n or bad < least:
        return none, spark.createDataFrame([], "token string, class string")
    of = classes(labelled, least)
    rows = in_classes(labelled.withColumn("row", F.monotonically_increasing_id()), of, "row", "bad")
    items = rows.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    items = written(items, "items")
    held = items.count()
    if not held:
        return none, of
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / held, minConfidence=1.0).fit(items).freqItemsets
    sets = written(sets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    with_label = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("support"))
    seen = sets.select(F.col("items").alias("tokens"), F.col("freq").alias("seen"))
    rules = with_label.join(seen, "tokens").select("tokens", "support", (F.col("support") / F.col("seen")).alias("confidence"))
    return rules.where(F.col("confidence") >= min_confidence), of


def _indexed(rules: DataFrame) -> DataFrame:
    """(token, need): each rule's tokens under the one of them that fewest rules share."""
    of = rules.select("tokens", F.explode("tokens").alias("token"))
    spread = of.groupBy("token").agg(F.count("*").alias("n"))
    return of.join(spread, "token").groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token")).select("token", F.col("tokens").alias("need"))


def minimal(rules: DataFrame) -> DataFrame:
    """Rules none of whose proper subsets is a rule: what they match is matched anyway."""
    met = rules.select("tokens", F.explode("tokens").alias("token")).join(_indexed(rules), "token")
    within = (F.size("need") < F.size("tokens")) & (F.size(F.array_except("need", "tokens")) == 0)
    return rules.join(met.where(within).select("tokens").distinct(), "tokens", "left_anti")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct keys of urls (key, tokens) that a rule (tokens) matches, by an inverted index with each rule under one token."""
    hit = urls.select("key", "tokens", F.explode("tokens").alias("token")).join(_indexed(rules), "token")
    return hit.where(F.size(F.array_except("need", "tokens")) == 0).select("key").distinct()


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of pages.

    verdict: the fitting rule's, else block if a mined rule matches, else allow. Null URLs and URLs without ://
    have an empty host and path, no rule and no token, so they are allowed. A page with several labels is bad if
    any is. Repeated rows each come back; other columns are not read; no labels or no bad label: no mined rule.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).alias("bad"))
    toks = tokens(F.col("url"), F.col("host"), F.col("path"))
    labelled = urls.join(known, F.col("page_id") == F.col("doc_id")).where("host <> ''").select(toks.alias("tokens"), "bad")
    rules, of = mine(labelled)
    rules = written(minimal(rules), "rules")
    of = of.join(rules.select(F.explode("tokens").alias("class")).distinct(), "class", "left_semi").select("token", "class")
    # copies of a URL have the same tokens: each distinct one is matched once
    distinct_urls = urls.where("host <> ''").groupBy("url", "host", "path").agg(F.lit(1).alias("one")).select(F.col("url").alias("key"), toks.alias("tokens"))
    hit = matches(in_classes(distinct_urls, of, "key"), rules).select("key", F.lit(True).alias("hit"))
    rule = rule_of(F.col("host"), F.col("path"))
    out = urls.join(hit, F.col("url") == F.col("key"), "left").withColumn("rule", rule)
    said = F.lit(None).cast("string")
    for h, p, v in RULES:
        said = F.when(F.col("rule") == h + p, v).otherwise(said)
    return out.select("page_id", "host", "path", "rule", F.coalesce(said, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


_FITS = " ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (h, p, _) in sorted(enumerate(RULES), key=lambda x: -len(x[1][0]) - len(x[1][1]))
)
#: The same by enumeration of all combinations of up to three tokens.
ORACLE = f"""
WITH u AS (
    SELECT page_id, url, CASE WHEN has THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
           CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM (SELECT page_id, url, coalesce(strpos(url, '://') > 0, false) AS has, substr(url, strpos(url, '://') + 3) AS rest FROM pages)
), t AS (
    SELECT page_id, CASE WHEN host <> '' THEN list_distinct(list_filter(
        [concat('s:', translate(substr(url, 1, strpos(url, '://') - 1), '{_UPPER}', '{_LOWER}'))]
        || list_transform(string_split(host, '.'), lambda x: concat('h:', x))
        || list_transform(string_split(path, '/'), lambda x: concat('p:', regexp_replace(x, '[0-9]+', '#', 'g')))
        || list_transform(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: concat('q:', regexp_extract(x, '^([^=]*)', 1))),
        lambda x: length(x) > 2)) ELSE [] END AS toks
    FROM u
), one AS (SELECT page_id, unnest(toks) AS x FROM t),
sets AS (
    SELECT page_id, [x] AS s FROM one
    UNION ALL SELECT a.page_id, [a.x, b.x] FROM one a JOIN one b ON a.page_id = b.page_id AND a.x < b.x
    UNION ALL SELECT a.page_id, [a.x, b.x, c.x] FROM one a JOIN one b ON a.page_id = b.page_id AND a.x < b.x JOIN one c ON a.page_id = c.page_id AND b.x < c.x
), known AS (
    SELECT doc_id, max(toxic) = 1 AS bad FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
), lab AS (SELECT page_id, bad FROM u JOIN known ON page_id = doc_id WHERE host <> ''),
rules AS (
    SELECT s FROM sets JOIN lab USING (page_id) GROUP BY s
    HAVING count(*) FILTER (WHERE bad) >= greatest({MIN_COUNT}, ceil({MIN_SUPPORT} * (SELECT count(*) FROM lab)))
       AND count(*) FILTER (WHERE bad) / count(*) >= {MIN_CONFIDENCE}
), hit AS (SELECT DISTINCT page_id FROM sets JOIN rules USING (s)),
r AS (SELECT *, CASE {_FITS.format(*(h + p for h, p, _ in RULES))} END AS rule FROM u)
SELECT r.page_id, host, path, rule,
       CASE rule {' '.join(f"WHEN '{h + p}' THEN '{v}'" for h, p, v in RULES)} ELSE CASE WHEN hit.page_id IS NOT NULL THEN 'block' ELSE 'allow' END END AS verdict
FROM r LEFT JOIN hit USING (page_id)
"""
