"""URL filters: given rules by host and path, and mined association rules for what they leave open.

A URL's tokens (scheme, host labels, path segments with digits folded, query keys, fragment) of labelled
pages, with the label among them, go to Spark's FP-growth. Rules `tokens -> block` of enough support and
confidence make an inverted index from token to rule; a URL fits a rule when it has all its tokens, which a
join on tokens and a count tell. The index is joined to the distinct token sets only, so a host with a third
of all pages costs as much as any.

Tokens that always occur together on labelled pages, such as the keys of a tracking query, are one item to
FP-growth, whose patterns would double with each of them otherwise. Of such tokens each alone makes the same
rules, so a rule asks for any one of an item's tokens: what is blocked is what the unmerged rules would block.

Built-in functions and spark.ml only, no Python on executors. Cases: null URLs, and those without `://`,
have empty host and path, fit no given rule, and are allowed unless mined rules on their tokens say else;
pages without a usable label teach nothing; with nothing to learn from all open pages are allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm._common import table, written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Least share, and least number, of labelled pages that hold a rule; least share of them that are to be blocked. The share is a floor for the cost of mining on very many pages.
SUPPORT, LEAST_PAGES, CONFIDENCE = 0.0005, 10, 0.6
BLOCK_ITEM = "label:block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(F.coalesce(raw, F.lit("")), UPPER, LOWER), "path": F.coalesce(path, F.lit(""))})


def rule_for(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) columns of the longest of the rules that fits host and path; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = lambda host, path: ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in reversed(ordered):
        name, verdict = F.when(fits(host, path), host + path).otherwise(name), F.when(fits(host, path), v).otherwise(verdict)
    return name, verdict


def tokens(url: str = "url") -> Column:
    """The sorted distinct tokens of a URL with host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    named = lambda kind, parts: F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.concat(F.lit(kind), t))
    fold = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda t: F.regexp_extract(t, "^[^=]*", 0))
    scheme = F.when(F.locate("://", u) > 0, F.substring_index(u, "://", 1)).otherwise("")
    fragment = F.regexp_extract(u, "#(.*)$", 1)
    return F.sort_array(F.array_distinct(F.concat(named("scheme:", F.array(scheme)), named("host:", F.split("host", r"\.")), named("path:", F.split(fold(F.col("path")), "[/.]")), named("key:", keys), named("fragment:", F.array(fold(fragment))))))


def merged_tokens(baskets: DataFrame) -> DataFrame:
    """(token, item) of the tokens of baskets (row, tokens): item is the least of the tokens that are on the same rows, told by their number and two sums of hashes."""
    marks = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    where = baskets.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *marks)
    least = where.groupBy("n", "s1", "s2").agg(F.min("token").alias("item"))
    return where.join(least, ["n", "s1", "s2"]).select("token", "item")


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_PAGES) -> DataFrame | None:
    """(rule_id, need, item, token): the inverted index of the rules that end in a block, with how many items each needs, from labelled (tokens, block); None where there are none."""
    baskets = written(labelled.select("tokens", "block").withColumn("row", F.monotonically_increasing_id()), "baskets")
    n = baskets.count()
    if not n:
        return None
    items = written(merged_tokens(baskets), "url-items")
    bought = baskets.select("row", "block", F.explode("tokens").alias("token")).join(items.filter("token = item"), "token")
    bought = bought.groupBy("row", "block").agg(F.collect_set("item").alias("items"))
    bought = written(bought.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(BLOCK_ITEM)))).otherwise(F.col("items")).alias("items")), "url-baskets")
    if bought.isEmpty():
        return None
    share = min(1.0, max(support, least / n))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(bought)
    rules = model.associationRules.filter((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BLOCK_ITEM))
    rules = written(rules.select(F.sort_array("antecedent").alias("antecedent")).withColumn("rule_id", F.xxhash64("antecedent")), "mined-rules")
    if rules.isEmpty():
        return None
    index = rules.select("rule_id", F.size("antecedent").alias("need"), F.explode("antecedent").alias("item")).join(items, "item")
    return written(index.select("rule_id", "need", "item", "token"), "rule-index")


def blocked_sets(sets: DataFrame, index: DataFrame) -> DataFrame:
    """The distinct signatures of sets (signature, tokens) that hold a token of every item of some rule, by an inverted index (rule_id, need, item, token)."""
    distinct = sets.select("signature", "tokens").dropDuplicates(["signature"])
    met = distinct.select("signature", F.explode("tokens").alias("token")).join(index, "token").select("signature", "rule_id", "need", "item").distinct()
    return met.groupBy("signature", "rule_id", "need").agg(F.count(F.lit(1)).alias("has")).filter("has = need").select("signature").distinct()


def judged(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of pages (page_id, url), with rules mined from labelled (url, block)."""
    keyed = lambda df: with_host_path(df).withColumn("tokens", tokens())
    name, verdict = rule_for(rules)
    out = with_host_path(pages.select("page_id", "url")).withColumns({"tokens": tokens(), "rule": name, "given": verdict}).withColumn("signature", F.concat_ws("\n", "tokens"))
    found = mined_rules(keyed(labelled))
    if found is None:
        open_verdict = F.lit("allow")
    else:
        bad = written(blocked_sets(out.filter(F.col("given").isNull()), found), "blocked-sets").withColumn("bad", F.lit(True))
        out, open_verdict = out.join(bad, "signature", "left"), F.when(F.col("bad"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", open_verdict).alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, block) of pages whose path names a labelled document by number: block where its quality is 0 or it is toxic."""
    fact = reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in (F.col("quality") == 0, F.col("toxic") == 1)))
    known = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    known = written(known.groupBy("doc_id").agg(F.max(fact).alias("block")), "page-labels")
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]+)', 1) AS bigint)")
    return with_host_path(pages.select("url")).select("url", number.alias("doc_id")).join(known.hint("merge"), "doc_id").select("url", "block")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, judged by the four given rules and by rules mined from labelled pages."""
    pages = table(spark, sf_dir, "pages")
    return judged(pages, labelled_pages(pages, table(spark, sf_dir, "labels")))


QUERIES = {"op10_url_rules": op10_url_rules}
ORACLES: dict[str, str] = {}
