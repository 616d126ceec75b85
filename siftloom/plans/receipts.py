"""Queries over receipts of evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.operators import receipts
from siftloom.plans import adapters as a
from siftloom.plans.registry import query


@query("""
    WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS requested, CASE l_partkey % 23 WHEN 0 THEN '' WHEN 1 THEN 'other' ELSE CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber END AS returned,
             CASE l_suppkey % 17 WHEN 0 THEN 'judge-2' WHEN 1 THEN 'judge-10' WHEN 2 THEN 'judge' ELSE 'judge-1-2026' END AS model, l_suppkey % 40 AS created, l_suppkey % 40 - (CASE WHEN l_partkey % 19 = 0 THEN -1 ELSE 2 END) AS since,
             CAST(l_quantity AS BIGINT) - (CASE WHEN l_partkey % 29 = 0 THEN 100 ELSE 0 END) AS prompt, CASE WHEN l_partkey % 31 <> 0 THEN l_suppkey % 50 END AS completion, CAST(l_quantity AS BIGINT) + l_suppkey % 50 + (CASE WHEN l_partkey % 37 = 0 THEN 1 ELSE 0 END) AS total FROM lineitem)
    SELECT CASE WHEN returned = '' THEN 'response_id_missing' WHEN requested <> returned THEN 'request_id_mismatch' WHEN NOT (model = 'judge-1' OR starts_with(model, 'judge-1-')) THEN 'model_mismatch' WHEN created < since THEN 'created_before_request'
                WHEN completion IS NULL THEN 'usage_missing' WHEN prompt < 0 THEN 'usage_negative' WHEN prompt + completion <> total THEN 'usage_arithmetic' END AS reason, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1
""")
def provider_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    own = F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"))
    p, q = c("l_partkey"), c("l_suppkey")
    returned = F.when(p % 23 == 0, "").when(p % 23 == 1, "other").otherwise(own)
    model = F.when(q % 17 == 0, "judge-2").when(q % 17 == 1, "judge-10").when(q % 17 == 2, "judge").otherwise("judge-1-2026")
    prompt = c("l_quantity").cast("long") - F.when(p % 29 == 0, 100).otherwise(0)
    completion, total = F.when(p % 31 != 0, q % 50), c("l_quantity").cast("long") + q % 50 + F.when(p % 37 == 0, 1).otherwise(0)
    reason = receipts.transaction_reason(own, returned, model, "judge-1", q % 40, q % 40 - F.when(p % 19 == 0, -1).otherwise(2), prompt, completion, total)
    return a.table(spark, sf_dir, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""
    WITH claimed AS (SELECT 'out/' || lang || '/' || doc_id || '.png' AS path, octet_length(encode(text)) AS size, sha256(text) AS digest FROM documents),
    found AS (SELECT 'out/' || lang || '/' || doc_id || (CASE WHEN doc_id % 25 = 0 THEN '.bak' ELSE '.png' END) AS path, CASE doc_id % 9 WHEN 0 THEN text || 'x' WHEN 1 THEN reverse(text) ELSE text END AS content FROM documents),
    f AS (SELECT path, octet_length(encode(content)) AS size, sha256(content) AS digest FROM found),
    j AS (SELECT coalesce(c.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN c.path IS NULL THEN 'unexpected' WHEN c.size <> f.size THEN 'size' WHEN c.digest <> f.digest THEN 'digest' END AS reason FROM claimed c FULL JOIN f ON f.path = c.path)
    SELECT path, reason FROM j WHERE reason IS NOT NULL
""")
def output_manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("doc_id"), F.col("text")
    d = a.table(spark, sf_dir, "documents")
    name = F.concat_ws("/", F.lit("out"), F.col("lang"), i.cast("string"))
    claimed = receipts.manifest(d.select(receipts.export_path(F.lit("out"), F.col("lang"), i.cast("string")).alias("p"), "text"), "p", "text")
    content = F.when(i % 9 == 0, F.concat(text, F.lit("x"))).when(i % 9 == 1, F.reverse(text)).otherwise(text)
    found = receipts.manifest(d.select(F.concat(name, F.when(i % 25 == 0, ".bak").otherwise(".png")).alias("p"), content.alias("content")), "p", "content")
    return receipts.manifest_violations(claimed, found)


FILES = """e AS (SELECT lang, source, lang || '/' || source || '/' || doc_id || '.png' AS path, doc_id FROM documents),
    f AS (SELECT path || (CASE WHEN source = 'src3' OR source = 'src5' AND doc_id % 2 = 0 THEN '.part' ELSE '' END) AS path FROM e)"""


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    expected = a.table(spark, sf_dir, "documents").select("lang", "source", "doc_id", receipts.export_path(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("path"))
    torn = (F.col("source") == "src3") | ((F.col("source") == "src5") & (F.col("doc_id") % 2 == 0))
    return expected, expected.select(F.concat("path", F.when(torn, ".part").otherwise("")).alias("path"))


@query(f"WITH {FILES} SELECT path, CASE WHEN path IN (SELECT path FROM e) THEN 'missing' ELSE 'unexpected' END AS state FROM (SELECT path FROM e EXCEPT SELECT path FROM f UNION ALL (SELECT path FROM f EXCEPT SELECT path FROM e))")
def result_file_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.file_set(*files(spark, sf_dir))


@query(f"""
    WITH {FILES}, g AS (SELECT lang, source, count(*) AS expected, count(f.path) AS found FROM e LEFT JOIN f ON f.path = e.path GROUP BY 1, 2)
    SELECT lang, source, CAST(expected AS BIGINT) AS expected, CAST(found AS BIGINT) AS found, CASE WHEN found = expected THEN 'complete' WHEN found = 0 THEN 'absent' ELSE 'partial' END AS state FROM g
""")
def cached_result_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.cached(*files(spark, sf_dir), ["lang", "source"])


@query("""
    WITH b AS (SELECT o_orderkey, o_custkey % 7 = 0 AS m, o_custkey % 11 = 0 AS x, o_custkey % 13 = 0 AS r, o_custkey % 5 = 0 AS w FROM orders),
    roles AS (SELECT unnest(['scores', 'summary', 'log']) AS role),
    art AS (SELECT o_orderkey, role, sha256(role || o_orderkey || (CASE WHEN w AND role = 'log' THEN 'changed' ELSE '' END)) AS digest FROM b, roles WHERE NOT (m AND role = 'summary')
            UNION ALL SELECT o_orderkey, 'scores', sha256('scores' || o_orderkey) FROM b WHERE r UNION ALL SELECT o_orderkey, 'extra', 'none' FROM b WHERE x)
    SELECT o_orderkey AS receipt, role, CASE WHEN m AND role = 'summary' THEN 'role_missing' WHEN r AND role = 'scores' THEN 'role_repeated' WHEN w AND role = 'log' THEN 'digest' END AS reason FROM b, roles
    WHERE m AND role = 'summary' OR r AND role = 'scores' OR w AND role = 'log'
    UNION ALL SELECT o_orderkey, role, 'role_unexpected' FROM art WHERE role = 'extra'
""")
def score_bundle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt"), F.col("o_custkey").alias("k"))
    roles = ["scores", "summary", "log"]
    digest = lambda role, more="": F.sha2(F.concat(F.lit(role), F.col("receipt").cast("string"), more if not isinstance(more, str) else F.lit(more)), 256)
    claims = o.select("receipt", F.create_map(*(x for r in roles for x in (F.lit(r), digest(r)))).alias("claims"))
    torn = F.when(F.col("k") % 5 == 0, "changed").otherwise("")
    parts = [
        o.select("receipt", F.lit("scores").alias("role"), digest("scores").alias("digest")),
        o.filter("k % 13 = 0").select("receipt", F.lit("scores").alias("role"), digest("scores").alias("digest")),
        o.filter("k % 7 <> 0").select("receipt", F.lit("summary").alias("role"), digest("summary").alias("digest")),
        o.select("receipt", F.lit("log").alias("role"), digest("log", torn).alias("digest")),
        o.filter("k % 11 = 0").select("receipt", F.lit("extra").alias("role"), F.lit("none").alias("digest")),
    ]
    artifacts = parts[0]
    for p in parts[1:]:
        artifacts = artifacts.unionByName(p)
    return receipts.bundle_violations(claims, artifacts, roles)


@query("""
    WITH n AS (SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS lang2, CASE WHEN doc_id % 6 <> 0 THEN source END AS source2, CASE WHEN doc_id % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS chars2 FROM documents)
    SELECT doc_id, lang || '::' || source || '::' || doc_id AS identity, concat_ws(',', CASE WHEN lang IS DISTINCT FROM lang2 THEN 'language' END, CASE WHEN source IS DISTINCT FROM source2 THEN 'source' END, CASE WHEN n_chars IS DISTINCT FROM chars2 THEN 'chars' END) AS differing,
           'a b ' || lang AS told FROM n
""")
def provenance_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    now = {"language": F.col("lang"), "source": F.col("source"), "chars": F.col("n_chars")}
    then = {"language": F.when(i % 4 == 0, "xx").otherwise(F.col("lang")), "source": F.when(i % 6 != 0, F.col("source")), "chars": F.when(i % 10 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    told = receipts.collapsed(F.concat(F.lit(" a \t b\n "), "lang", F.lit("  ")))
    return a.table(spark, sf_dir, "documents").select("doc_id", receipts.identity(F.col("lang"), F.col("source"), i.cast("string")).alias("identity"), F.array_join(receipts.differing(now, then), ",").alias("differing"), told.alias("told"))


@query("""
    WITH b AS (SELECT doc_id // 5 AS batch, doc_id FROM documents), g AS (SELECT batch, max(CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END) = 1 AS failed FROM b GROUP BY 1)
    SELECT b.batch, doc_id AS item, NOT failed AS batched, CASE WHEN failed AND doc_id % 11 = 0 THEN 'bad_item' END AS error FROM b JOIN g USING (batch)
""")
def failed_batches_one_by_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 5).cast("long").alias("batch")).agg(F.collect_list("doc_id").alias("items"))
    return receipts.with_singles(rows, "items", F.exists("items", lambda i: i % 11 == 0), F.when(F.col("item") % 11 == 0, "bad_item")).select("batch", "item", "batched", "error")
