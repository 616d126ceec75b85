"""URL filters by association rules (DataFrame functions and Spark's FP-growth only).

URLs whose host and path fit a hand-written rule carry its verdict; they, and those of a
table of labels where there is one, are the labelled transactions. Spark's FP-growth mines the
combinations of URL tokens (host labels, last label, path segments, query keys, scheme) that
go with ``block``; rules below the support or the confidence are pruned, and no others. A URL
without a hand-written rule is blocked when a mined rule's tokens are all among its own.

FP-growth lists every subset of tokens that often come together, so what cannot change a
verdict is left out before:

* A token with too few blocked transactions is in no rule.
* Tokens with the same transactions are one class. A set of tokens is a rule just when the set
  of their classes is one, so rules are mined over classes, and a URL has a class when it has
  any of its tokens. Forty query keys of one template are one item, not 2^40 sets.
* A class that is a rule by itself blocks whatever holds it. Larger rules with it say no more
  and are not mined; the other classes are counted over all transactions as before.

Matching uses an inverted index: each mined rule is filed under the rarest of its classes;
a distinct URL meets only the rules filed under a class it has, and the others are
then compared. The index is broadcast only when its counted size is small, else joined.
URLs are judged once each and joined back to their rows.

Defined results: null, and a URL without ``://``, have an empty host and path, no rule, and
the method's verdict ``allow``; the longest fitting rule wins; repeated rows are each
judged alike; without labelled URLs nothing is mined; an empty table gives an empty
result; further columns are ignored. A label that is neither block nor allow, or null,
teaches nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import ascii_lower, cut, looked_up, sized

MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.9
BROADCAST_RULES = 20_000
BLOCK_ITEM, ALLOW_ITEM = "verdict:block", "verdict:allow"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_rule(verdict: str, pattern: str) -> UrlRule:
    """A rule from ``host/path``."""
    host, slash, path = pattern.partition("/")
    return UrlRule(verdict, host, slash + path)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def fits(rule: UrlRule, host: Column, path: Column) -> Column:
    own = (host == rule.host) | host.endswith(f".{rule.host}")
    return own & path.startswith(rule.path) if rule.path else own


def ruled(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        hit = fits(r, host, path)
        name = F.when(hit, r.name) if name is None else name.when(hit, r.name)
        verdict = F.when(hit, r.verdict) if verdict is None else verdict.when(hit, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def marked(kind: str, words: Column) -> Column:
    return F.transform(words, lambda x: F.concat(F.lit(kind), x))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; digits read as one sign."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(F.regexp_replace(ascii_lower(path), "[0-9]+", "#"), "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    scheme = F.array(F.concat(F.lit("scheme:"), ascii_lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1))))
    last = F.when(F.size(labels) > 0, F.array(F.concat(F.lit("tld:"), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>"))
    named = [marked("host:", labels), marked("path:", segments), marked("query:", keys)]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(scheme, last, *named)))


def token_classes(labelled: DataFrame, least: int) -> DataFrame:
    """token, class (the smallest token with the same transactions), freq, blocked: of tokens with so many blocked transactions at least."""
    one = labelled.select(F.explode("items").alias("token"), (F.col("verdict") == "block").cast("long").alias("blocked"), F.xxhash64("items", "verdict").alias("t"))
    per = one.groupBy("token").agg(F.count("*").alias("freq"), F.sum("blocked").alias("blocked"), F.sum(F.col("t").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "t")).alias("x"))
    # the counts and sums of the transactions' hashes name a set of transactions
    often = cut(per.filter(F.col("blocked") >= least))
    same = ["freq", "blocked", "s", "x"]
    return often.join(often.groupBy(*same).agg(F.min("token").alias("class")), same).select("token", "class", "freq", "blocked")


def mined(labelled: DataFrame, min_support: float, min_confidence: float) -> tuple[DataFrame, DataFrame] | None:
    """Rules (antecedent, confidence, support, anchor) for block over classes of tokens, and the classes, from rows with ``items`` and ``verdict``."""
    labelled = cut(labelled)
    every = labelled.count()
    if not every:
        return None
    least = math.ceil(min_support * every - 1e-9)
    classes = cut(token_classes(labelled, least))
    own = classes.filter("token = class").select("class", "freq", "blocked")
    strong = own.filter(F.col("blocked") / F.col("freq") >= min_confidence)
    single = strong.select(F.array("class").alias("antecedent"), (F.col("blocked") / F.col("freq")).alias("confidence"), (F.col("blocked") / F.lit(every)).alias("support"), F.col("class").alias("anchor"))
    weak = sized(own.join(strong.select("class"), "class", "left_anti").select(F.col("class").alias("item")))
    numbered = labelled.select("items", F.when(F.col("verdict") == "block", BLOCK_ITEM).otherwise(ALLOW_ITEM).alias("label"), F.monotonically_increasing_id().alias("row"))
    held = numbered.select("row", "label", F.explode("items").alias("item")).join(weak, "item")
    bags = cut(held.groupBy("row").agg(F.concat(F.collect_list("item"), F.array(F.first("label"))).alias("items")))
    n = bags.count()
    if n < least:
        return cut(single), classes.select("token", "class")
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(bags)
    rules = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BLOCK_ITEM))) & ~F.array_contains("antecedent", ALLOW_ITEM))
    kept = rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", (F.col("support") * F.lit(n / every)).alias("support"))
    rarest = kept.select("antecedent", F.explode("antecedent").alias("class")).join(own, "class").groupBy("antecedent").agg(F.min(F.struct("freq", "class"))["class"].alias("anchor"))
    return cut(kept.join(rarest, "antecedent").unionByName(single)), classes.select("token", "class")


def judge(pages: DataFrame, rules: list[UrlRule], min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for every row.

    labels, where given, has further URLs with their verdict (url, verdict: block or allow).
    """
    host, path = split_url(F.col("url"))
    parts = lambda df: df.withColumn("host", host).withColumn("path", path)
    rows = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    name, verdict = ruled(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", name).withColumn("given", verdict)
    bag = tokens(F.col("url"), F.col("host"), F.col("path"))
    labelled = rows.filter(F.col("given").isNotNull()).select(bag.alias("items"), F.col("given").alias("verdict"))
    if labels is not None:
        labelled = labelled.unionByName(parts(labels.select("url", "verdict")).filter(F.col("verdict").isin("block", "allow")).select(bag.alias("items"), "verdict"))
    found = mined(labelled, min_support, min_confidence)
    if found is None:
        out = rows.withColumn("best", F.lit(None).cast("struct<confidence:double,support:double,antecedent:array<string>>"))
    else:
        index, classes = found
        index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
        open_ = cut(rows.filter(F.col("rule").isNull() & (F.col("host") != "")).groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.count("*").alias("n")))
        named = open_.select("url", F.explode(bag).alias("token")).join(sized(classes), "token").select("url", "class").distinct()
        had = named.groupBy("url").agg(F.collect_set("class").alias("classes"))
        met = had.withColumn("class", F.explode("classes")).join(index, F.col("class") == F.col("anchor")).filter(F.size(F.array_except("antecedent", "classes")) == 0)
        hit = met.groupBy("url").agg(F.max(F.struct("confidence", "support", "antecedent")).alias("best"))
        judged = cut(hit.join(open_.select("url", "n"), "url").select(F.col("url").alias("judged"), "n", "best"))
        out = looked_up(rows.withColumn("judged", F.col("url")), judged, "judged", rows.count())
    by_rule = F.col("rule").isNotNull()
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(by_rule, F.col("given")).when(F.col("best").isNotNull(), "block").otherwise("allow").alias("verdict"),
        F.when(~by_rule, F.array_join("best.antecedent", " ")).alias("mined_rule"),
        F.when(~by_rule, F.col("best.confidence")).alias("confidence"),
    )
