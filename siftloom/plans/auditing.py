"""Queries that audit manifests, scores and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftloom.functions import parsing
from siftloom.operators import audit
from siftloom.plans import adapters as a
from siftloom.plans.registry import query

EXPECTED = "expected AS (SELECT doc_id AS key FROM documents WHERE doc_id % 7 <> 0), actual AS (SELECT doc_id AS key FROM labels UNION SELECT -doc_id FROM labels WHERE doc_id % 50 = 1)"


def both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    expected = a.table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("key"))
    labels = a.table(spark, sf_dir, "labels")
    actual = labels.select(F.col("doc_id").alias("key")).unionByName(labels.filter("doc_id % 50 = 1").select((-F.col("doc_id")).alias("key"))).distinct()
    return expected, actual


@query(f"""
    WITH {EXPECTED} SELECT coalesce(e.key, x.key) AS key, CASE WHEN x.key IS NULL THEN 'missing' ELSE 'unexpected' END AS state
    FROM expected e FULL JOIN actual x ON e.key = x.key WHERE e.key IS NULL OR x.key IS NULL
""")
def key_reconciliation_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.reconcile(*both_sides(spark, sf_dir), "key")


@query(f"""
    WITH {EXPECTED}, j AS (SELECT e.key AS e, x.key AS x FROM expected e FULL JOIN actual x ON e.key = x.key)
    SELECT CAST(count(e) AS BIGINT) AS expected, CAST(count(*) FILTER (e IS NOT NULL AND x IS NOT NULL) AS BIGINT) AS found, CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS missing,
           CAST(count(*) FILTER (e IS NULL) AS BIGINT) AS unexpected, CAST(count(*) FILTER (e IS NOT NULL AND x IS NOT NULL) AS DOUBLE) / count(e) AS share FROM j
""")
def key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(*both_sides(spark, sf_dir), "key")


@query("""
    WITH t AS (SELECT doc_id, source, lang, md5(text) AS sig, row_number() OVER (PARTITION BY source, lang, sha256(text) ORDER BY doc_id) AS k FROM documents),
    c AS (SELECT source, lang, sig, count(*) AS n FROM t WHERE doc_id % 9 <> 0 GROUP BY 1, 2, 3)
    SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS matches FROM t LEFT JOIN c ON c.source = t.source AND c.lang = t.lang AND c.sig = t.sig
""")
def csv_signature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = a.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("sig"))
    return audit.exact_match(d, d.filter("doc_id % 9 <> 0"), ["source", "lang", "sig"], "doc_id")


PASSAGE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@query(f"""
    WITH t AS (SELECT doc_id, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: md5(trim(x))))) AS k FROM documents),
    b AS (SELECT item_id, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: md5(trim(x))))) AS k FROM benchmark)
    SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS shared FROM t JOIN b ON t.k = b.k GROUP BY 1, 2
""")
def disjointness_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and benchmark texts that share a line."""
    keys = F.transform(F.split("text", "\n"), lambda x: F.md5(F.trim(x)))
    return audit.overlap(a.table(spark, sf_dir, "documents"), a.table(spark, sf_dir, "benchmark"), "doc_id", keys, "item_id", keys)


@query("SELECT sha256(text) AS digest, CAST(count(*) AS BIGINT) AS n, array_to_string(list(doc_id ORDER BY doc_id), ',') AS keys FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.duplicate_content(a.table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("digest", "n", F.array_join("keys", ",").alias("keys"))


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicates(a.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
    WITH m AS (SELECT page_id, url, page_id % 13 = 0 AS labeled FROM pages),
    r AS (SELECT 'unlabeled' AS rule, page_id FROM m WHERE labeled UNION ALL SELECT 'image_missing', page_id FROM m WHERE url IS NULL OR url = ''
          UNION ALL SELECT 'scheme', page_id FROM m WHERE NOT starts_with(url, 'https://') UNION ALL SELECT 'path_safety', page_id FROM m WHERE contains(url, '?')),
    d AS (SELECT 'duplicate_host' AS rule, string_split(url, '/')[3] AS key FROM pages GROUP BY 2 HAVING count(*) > 20)
    SELECT rule, CAST(page_id AS VARCHAR) AS key FROM r UNION ALL SELECT rule, key FROM d
""")
def manifest_audit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, url = a.table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url")
    rules = [("unlabeled", F.col("page_id") % 13 == 0), ("image_missing", url.isNull() | (url == "")), ("scheme", ~url.startswith("https://")), ("path_safety", F.contains(url, F.lit("?")))]
    hosts = audit.duplicates(p.select(F.split("url", "/")[2].alias("key")), ["key"]).filter("n > 20").select(F.lit("duplicate_host").alias("rule"), "key")
    return audit.violations(p, "page_id", rules).unionByName(hosts)


@query("""
    WITH s AS (SELECT doc_id, lang, source, CAST(doc_id * 7 % 109 AS DOUBLE) / 1e1 AS s, CAST(doc_id * 13 % 101 AS DOUBLE) / 1e1 AS q FROM documents),
    o AS (SELECT *, lag(struct_pack(a := lang, b := source)) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM s)
    SELECT 'semantics_range' AS rule, CAST(doc_id AS VARCHAR) AS key FROM s WHERE s NOT BETWEEN 0 AND 10
    UNION ALL SELECT 'quality_range', CAST(doc_id AS VARCHAR) FROM s WHERE q NOT BETWEEN 0 AND 10
    UNION ALL SELECT 'sort_order', CAST(doc_id AS VARCHAR) FROM o WHERE before.a > lang
""")
def score_csv_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = a.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("doc_id") * 7 % 109 / 10.0).alias("s"), (F.col("doc_id") * 13 % 101 / 10.0).alias("q"))
    rows = audit.violations(d, "doc_id", [("semantics_range", ~F.col("s").between(0, 10)), ("quality_range", ~F.col("q").between(0, 10))])
    late = audit.unsorted(d, ["lang"], "doc_id", ["source"]).select(F.lit("sort_order").alias("rule"), F.col("doc_id").cast("string").alias("key"))
    return rows.unionByName(late)


@query("SELECT doc_id, sha256(text) AS digest, regexp_full_match(sha256(text), '[0-9a-f]{64}') AND doc_id % 5 <> 0 AS well_formed, left(sha1(text), 8) AS short FROM documents")
def digest_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("doc_id") % 5 == 0, F.upper(F.concat(F.lit("X"), F.sha2("text", 256)))).otherwise(F.sha2("text", 256))
    return a.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), parsing.sha256_shaped(digest).alias("well_formed"), F.left(F.sha1("text"), F.lit(8)).alias("short"))


@query("""
    SELECT source AS root, CAST(count(*) AS BIGINT) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, sha256(string_agg(doc_id || ' ' || sha256(text), chr(10) ORDER BY doc_id)) AS tree FROM documents GROUP BY 1
""")
def tree_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and one digest over the ordered digests of each root."""
    rows = a.table(spark, sf_dir, "documents").select(F.col("source").alias("root"), F.struct("doc_id", F.sha2("text", 256).alias("sha")).alias("f"), F.octet_length("text").alias("b"))
    out = rows.groupBy("root").agg(F.count("*").alias("files"), F.sum("b").cast("long").alias("bytes"), F.sort_array(F.collect_list("f")).alias("f"))
    lines = F.transform("f", lambda x: F.concat_ws(" ", x["doc_id"].cast("string"), x["sha"]))
    return out.select("root", "files", "bytes", F.sha2(F.array_join(lines, "\n"), 256).alias("tree"))


@query("""
    SELECT page_id AS key, 'left' AS side FROM (SELECT page_id FROM pages WHERE page_id % 3 <> 0 EXCEPT ALL SELECT page_id FROM pages WHERE page_id % 5 <> 0)
    UNION ALL SELECT page_id, 'right' FROM (SELECT page_id FROM pages WHERE page_id % 5 <> 0 EXCEPT ALL SELECT page_id FROM pages WHERE page_id % 3 <> 0)
""")
def set_difference_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"))
    return audit.set_difference(p.filter("key % 3 <> 0"), p.filter("key % 5 <> 0"))


@query("""
    WITH k AS (SELECT conv_id, max(turn) AS last, count(*) AS n FROM conversations GROUP BY 1)
    SELECT conv_id, CAST(last AS BIGINT) AS step, CASE WHEN last >= 4 THEN 'complete' ELSE 'steps_below_requested' END AS receipt FROM k
""")
def completion_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = a.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("step"))
    return k.select("conv_id", F.col("step").cast("long").alias("step"), F.when(F.col("step") >= 4, "complete").otherwise("steps_below_requested").alias("receipt"))


@query("""
    WITH c AS (SELECT user_id, 'checkpoint-' || event_id % 1000 AS path, event_id % 1000 AS step, event_id FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC, event_id DESC) AS k FROM c)
    SELECT user_id, path, CAST(k AS BIGINT) AS place FROM o WHERE k <= 2
""")
def latest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two checkpoints of each run by the number in their name."""
    e = a.table(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.lit("checkpoint-"), (F.col("event_id") % 1000).cast("string")).alias("path"))
    step = F.regexp_extract("path", r"checkpoint-(\d+)$", 1).try_cast("long")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(step), F.desc("event_id"))).cast("long")
    return e.withColumn("place", place).filter("place <= 2").select("user_id", "path", "place")
