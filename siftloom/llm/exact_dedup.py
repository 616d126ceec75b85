"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text (A-Z lower-cased, null read as empty) is cut where its content says so: at
the first sentence end or line end after ``MIN_CHARS`` characters, at ``MAX_CHARS``
at the latest. Its recipe is the ordered list of its chunk identifiers.

1. Every row gets its provisional recipe, the 64-bit hashes of its chunks. Only
   this list (8 bytes a chunk) is shuffled. Equal texts have equal provisional
   recipes, so a recipe that occurs once needs no further look.
2. The chunks of the remaining rows are deduplicated by hash and by text, with a
   map-side combine, so a chunk crosses the network once per task at most. A hash
   with one text is verified; of a hash with several texts, each text gets an
   ordinal of its own.
3. Rows are equal when their ordered lists of verified identifiers (hash, ordinal)
   are equal. Of equal rows the one with the largest id stays. A group with a large share of
   all rows is brought to its rows, which stay where they are.

Defined results: a null text equals the empty one; a repeated row (same id, same
text) is a member of its group like any other and is kept with its twin when its id
is the largest; a null id sorts below all others; an empty table gives an empty
result; further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import ascii_lower, cut, looked_up, sized

MIN_CHARS, MAX_CHARS = 256, 4096


def chunks_of(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """The chunks of a text in order; together they are the whole text."""
    pattern = rf"(?s).{{{min_chars},{max_chars - 1}}}?[.!?\n]|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, recipe (chunk hashes in order), text_sha256 of the normalised text."""
    return normalised(docs, id_col, text_col).select(
        "doc_id",
        F.transform(chunks_of(F.col("norm")), lambda c: chunk_hash(c)).alias("recipe"),
        F.sha2(F.col("norm"), 256).alias("text_sha256"),
    )


def list_digest(*columns: str) -> Column:
    """A short name of an identifier list, for joins of rows with the groups that equal lists make."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def ambiguous_chunks(rows: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """(chunk_hash, chunk_sha, ordinal) of every hash that stands for more than one chunk text."""
    chunk = rows.select(F.explode(chunks_of(F.col("norm"))).alias("chunk")).select(chunk_hash(F.col("chunk")).alias("chunk_hash"), "chunk")
    distinct = chunk.distinct()
    several = distinct.groupBy("chunk_hash").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.sha2("chunk", 256))).alias("texts"))
    return several.filter("n > 1").select("chunk_hash", F.posexplode("texts").alias("ordinal", "chunk_sha"))


def with_ordinals(rows: DataFrame, made: DataFrame, ambiguous: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """The recipes with the ordinals of their ambiguous chunks, as a list beside the hashes."""
    placed = rows.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.posexplode(chunks_of(F.col("norm"))).alias("pos", "chunk"))
    placed = placed.select("doc_id", "text_sha256", "pos", chunk_hash(F.col("chunk")).alias("chunk_hash"), F.sha2("chunk", 256).alias("chunk_sha"))
    lists = (
        placed.join(ambiguous, ["chunk_hash", "chunk_sha"])
        .groupBy("text_sha256")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "ordinal"))).alias("ordinals"))
    )
    return made.join(lists, "text_sha256", "left").withColumn("ordinals", F.coalesce("ordinals", F.array().cast("array<struct<pos:int,ordinal:int>>")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    made = cut(recipes(docs, id_col, text_col, chunk_hash).withColumn("key", list_digest("recipe")))
    total = made.count()
    repeated = cut(made.groupBy("recipe").agg(F.count("*").alias("n")).filter("n > 1").select(list_digest("recipe").alias("key"), "n"))
    ids = sized(looked_up(made.select("doc_id", "key"), repeated, "key", total).filter(F.col("n").isNotNull()).select(F.col("doc_id").alias("again")).distinct())
    rows = normalised(docs, id_col, text_col)
    rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("again")), "left_semi")
    ambiguous = cut(ambiguous_chunks(rows, chunk_hash))
    identity = ["recipe"]
    if not ambiguous.isEmpty():
        identity = ["recipe", "ordinals"]
        made = cut(with_ordinals(rows, made, ambiguous, chunk_hash).withColumn("key", list_digest(*identity)))
    groups = made.groupBy(*identity).agg(F.max("doc_id").alias("largest"), F.count("*").alias("n")).filter("n > 1")
    groups = cut(groups.select(list_digest(*identity).alias("key"), "largest", "n"))
    keep = F.coalesce("largest", "doc_id")
    return looked_up(made.select("doc_id", "key", "text_sha256"), groups, "key", total).select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal rows, all columns; repeated rows are reduced to one as well."""
    several = exact_groups(docs, id_col, text_col).filter("group_size > 1")
    known = several.groupBy(F.col("doc_id").alias("__known_id"), F.col("text_sha256").alias("__known_sha")).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("twins"))
    known = cut(known)
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    same = F.col(id_col).eqNullSafe(F.col("__known_id")) & (sha == F.col("__known_sha"))
    stay = docs.join(sized(known.filter("NOT kept OR twins > 1").select("__known_id", "__known_sha")), same, "left_anti")
    twins = docs.join(sized(known.filter("kept AND twins > 1").select("__known_id", "__known_sha")), same).dropDuplicates(["__known_id", "__known_sha"])
    return stay.unionByName(twins.select(*docs.columns))
