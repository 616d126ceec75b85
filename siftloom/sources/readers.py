"""Readers: manifests, logs, judge scores, reports, directories, fixed-schema files.

Every reader attaches a stable ordinal where order matters, so that later steps never
depend on the order in which Spark happens to read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
MANIFEST = T.StructType([T.StructField("key", T.StringType()), T.StructField("image", T.StringType()), T.StructField("caption", T.StringType()), T.StructField("metadata", T.VariantType())])
SCORE_CSV = "key string, edited_image string, instruction string, sementics_score double, quality_score double, intersection_exist boolean, instruction_language string"
C4_ROWS = 531


def records(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Source records by the kind of source; another kind is an error."""
    if kind == "directory":
        return directory(spark, path, **options)
    if kind == "jsonl":
        return manifest(spark, path, **options)
    raise ValueError(f"no such source: {kind}")


def directory(spark: SparkSession, path: str, metadata: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Images below a folder: key (relative path without suffix, / as __), image, metadata, in the order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    files = files.filter(suffix.isin(*IMAGE_SUFFIXES))
    root = path.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", rf"^(?:[a-z]+:/+)?/?{root.lstrip('/')}/", ""), r"\.[^./]+$", "")
    rows = files.select(F.regexp_replace(relative, "/", "__").alias("key"), F.col("path").alias("image"), "length")
    if metadata is not None:
        rows = rows.join(metadata, "key", "left")
    rows = rows.orderBy("image")
    return rows.limit(limit) if limit is not None else rows


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and number: path, line (from 1), value.

    A file is read whole by one task; use it for manifests and reports, not for corpora.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split("value", r"\r\n|\n")).alias("pos", "value"))
    last = F.max("pos").over(Window.partitionBy("path"))
    lines = lines.withColumn("_last", last).filter(~((F.col("pos") == F.col("_last")) & (F.col("value") == ""))).drop("_last")
    return lines.select("path", (F.col("pos") + 1).cast("long").alias("line"), "value")


def manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A JSON Lines manifest: key (as text), image, caption, metadata; blank lines are skipped, an image is required."""
    lines = text_lines(spark, path).filter(F.trim("value") != "")
    row = F.from_json("value", MANIFEST)
    rows = lines.withColumn("r", row).select("path", "line", F.col("r.key").alias("key"), F.col("r.image").alias("image"), F.col("r.caption").alias("caption"), F.col("r.metadata").alias("metadata"))
    rows = rows.withColumn("image", F.when(F.col("image").isNotNull() & (F.col("image") != ""), F.col("image")).otherwise(F.raise_error(F.format_string("line %d has no image", "line"))))
    rows = rows.orderBy("path", "line")
    return (rows.limit(limit) if limit is not None else rows).drop("path")


def sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metadata by key; of a key's rows the last wins."""
    lines = text_lines(spark, path).filter(F.trim("value") != "")
    rows = lines.select("line", F.from_json("value", schema).alias("r")).select("line", "r.*")
    rest = [c for c in rows.columns if c not in ("key", "line")]
    last = rows.groupBy("key").agg(F.max_by(F.struct(*rest), "line").alias("_r"))
    return last.select("key", *(F.col(f"_r.{c}").alias(c) for c in rest))


def append_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an append log with their line; a torn last line is left out, a malformed earlier one raises with its number."""
    from siftloom.operators.logs import torn_tail

    lines = text_lines(spark, path).filter(F.trim("value") != "")
    parsed = lines.withColumn("bad", F.try_parse_json("value").isNull())
    faults = torn_tail(parsed.select("path", "line", "bad"))
    first = faults.orderBy("path", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['path']}: line {first[0]['line']} is not JSON")
    return parsed.filter("NOT bad").select("line", F.from_json("value", schema).alias("r")).select("line", "r.*")


def keyed_specs(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON object of key -> record as rows; repeated keys raise."""
    text = spark.read.text(path, wholetext=True)
    strict = F.parse_json("value")  # rejects repeated keys and NaN
    rows = text.withColumn("_strict", strict).filter("_strict IS NOT NULL")
    return rows.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("identity", "r")).select("identity", "r.*")


def score_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE_CSV).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    return None


def latest_file(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The path last modified of those that match, one row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compound_manifest(spark: SparkSession, path: str, rows: int = C4_ROWS) -> tuple[DataFrame, DataFrame]:
    """A fixed-schema manifest and its violations (rule, line).

    Rows are {idx, key, image, compound[8], sequence}: exactly these keys, idx = line - 1,
    key its four digits, image key.png, eight instructions that are not blank.
    """
    lines = text_lines(spark, path)
    schema = "idx int, key string, image string, compound array<string>, sequence array<string>"
    parsed = lines.withColumn("v", F.try_parse_json("value")).withColumn("r", F.from_json("value", schema)).withColumn("names", F.json_object_keys("value"))
    c = F.col
    want = F.array(*map(F.lit, sorted(("idx", "key", "image", "compound", "sequence"))))
    rules = [
        ("blank_line", F.trim("value") == ""),
        ("not_json", c("v").isNull()),
        ("keys", ~F.array_sort("names").eqNullSafe(want)),
        ("idx", ~c("r.idx").eqNullSafe((c("line") - 1).cast("int"))),
        ("key", ~c("r.key").eqNullSafe(F.format_string("%04d", (c("line") - 1).cast("int")))),
        ("image", ~c("r.image").eqNullSafe(F.concat("r.key", F.lit(".png")))),
        ("compound", (F.size("r.compound") != 8) | F.exists("r.compound", lambda x: x.isNull() | (F.trim(x) == ""))),
    ]
    broken = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(True)), name) for name, cond in rules)))
    faults = parsed.select(F.explode(broken).alias("rule"), "line")
    count = parsed.agg(F.count("*").alias("line")).filter(c("line") != rows).select(F.lit("row_count").alias("rule"), "line")
    return parsed.select("line", "r.*"), faults.unionByName(count)


def pruned(spark: SparkSession, path: str, narrow: list[str], choose, index: str, wide: list[str]) -> DataFrame:
    """Late materialisation: a choice over narrow columns, then the wide ones of the chosen rows only."""
    chosen = choose(spark.read.parquet(path).select(index, *narrow)).select(index)
    return spark.read.parquet(path).select(index, *narrow, *wide).join(chosen, index, "left_semi")
