"""Line dedup: repeated runs of lines by a suffix array over line identifiers (DataFrame functions only).

The corpus is one sequence of lines, documents in order of their id. Every run of lines of one
document that has ``MIN_WORDS`` words or more and occurs before is deleted; its first copy
stays. A maximal repeated run is covered by its shortest runs of MIN_WORDS words: those
that start at each of its lines, and the one that ends with its last line. So only the
shortest runs from each place and up to each place are looked for.

1. A line's identifier is the rank of its 128-bit hash among the hashes that occur more
   than once. A line that occurs once ends every repeated run, so only the other lines
   (the active ones) go on.
2. Prefix doubling: from ranks of the 2^q lines at each place, a place's pair (rank here,
   rank 2^q lines on) is ranked anew, for all pairs that occur more than once: sorted
   globally, ranks keep the order of the sequences, so they are the suffix array's
   order to depth 2^(q+1). A place without a partner drops out. Each round ends in a
   reliable checkpoint.
3. Each place needs the depths r of its shortest runs of MIN_WORDS words. Suffixes that share
   their first r lines, an interval of the suffix array with a longest common prefix of
   at least r, have equal (r, rank at depth 2^q, rank at depth 2^q of the place r - 2^q
   on), 2^q <= r < 2^(q+1). In each interval the earliest place is the first copy; the
   runs at the others are marked.
4. Marked runs that overlap or touch merge into spans; their lines are deleted.

Shuffles carry hashes, ranks and places, never lines; groups are pre-aggregated before
they are shuffled, and the rank of a very common line is brought to its places, which stay
where they are. The spans are brought to the texts while they are few, counted; beyond that
the texts move once.

Defined results: a null text is one empty line; a line without words counts as one word;
rows alike in id and text are one document, each returned with the same result; rows
alike in id only are documents of their own, ordered by a hash of their text; a null id
sorts first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.llm.common import BROADCAST_ROWS, cut, looked_up

MIN_WORDS = 50
PLACE = ["doc", "mark", "line"]
#: Stands for a null id, so that it sorts first and joins.
NO_ID = -(1 << 63)
SPANS = "array<struct<start:int,stop:int>>"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, mark and text: the id, a hash of the text, and the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def lines_of(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def places(rows: DataFrame) -> DataFrame:
    """A row for each line: its place (doc, mark, line), hashes and words."""
    lines = rows.select("doc", "mark", F.posexplode(lines_of("text")).alias("line", "content"))
    words = F.regexp_count("content", F.lit(r"[^\x20\x09-\x0D]+"))
    return lines.select(*PLACE, F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(1), "content").alias("h2"), F.greatest(words, F.lit(1)).alias("words"))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, how often (n), and a rank in their order."""
    several = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return several.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id())


def active_places(lines: DataFrame, min_words: int) -> DataFrame:
    """Places whose line is repeated: rank of the line, and the depths of the runs to look for from there.

    These are the shortest run of min_words words that starts at the place, and those that are
    the shortest ones up to some later place. Words are summed over the active lines. A
    run never crosses a line that is not active, so where that matters the ranks of its
    parts are missing. depths is empty where the document ends before.
    """
    same = ["h1", "h2"]
    found = looked_up(lines, cut(ranked(lines, same)), same, lines.count()).filter("n IS NOT NULL").repartition("doc", "mark")
    one = found.groupBy(*PLACE).agg(F.first("words").alias("words"), F.first("rank").alias("rank"))
    doc = Window.partitionBy("doc", "mark")
    start = F.coalesce(F.sum("words").over(doc.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = one.withColumn("start", start).withColumn("total", F.sum("words").over(doc))
    within = F.count("*").over(doc.orderBy("start").rangeBetween(0, min_words - 1))
    depth = F.when(F.col("total") - F.col("start") >= min_words, within).cast("int")
    one = one.select(*PLACE, "rank", (F.col("start") + F.col("words")).alias("end"), F.array_compact(F.array(depth)).alias("depths"))
    back = F.count("*").over(doc.orderBy("end").rangeBetween(1 - min_words, 0)).cast("int")
    ending = one.withColumn("back", back).filter(F.col("end") >= min_words).select("doc", "mark", (F.col("line") - F.col("back") + 1).alias("line"), "back")
    return one.join(ending.groupBy(*PLACE).agg(F.collect_set("back").alias("ending")), PLACE, "left").select(*PLACE, "rank", F.array_union("depths", F.coalesce("ending", F.array().cast("array<int>"))).alias("depths"))


def later_copies(suffixes: DataFrame) -> DataFrame:
    """Of the suffixes that share (depth, rank, rank2), all but the earliest, with the place of that one."""
    interval = ["depth", "rank", "rank2"]
    first = suffixes.groupBy(*interval).agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return suffixes.join(first, interval).filter(F.struct(*PLACE) > F.col("first")).select(*PLACE, "depth", "first")


def repeated_runs(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Places (doc, mark, line) and depth of the runs that occur before, with the first copy's place."""
    level = cut(active_places(cut(places(rows)), min_words))
    asked = lambda: level.withColumn("depth", F.explode("depths")).drop("depths")
    found = later_copies(asked().filter("depth = 1").withColumn("rank2", F.col("rank")))
    q = 0
    while not asked().filter(F.col("depth") >= 2 << q).isEmpty():
        on = Window.partitionBy("doc", "mark").orderBy("line").rangeBetween(1 << q, 1 << q)
        pairs = level.withColumnRenamed("rank", "rank1").withColumn("rank2", F.max("rank1").over(on)).filter(F.col("rank2").isNotNull())
        level = cut(pairs.join(ranked(pairs, ["rank1", "rank2"]).drop("n"), ["rank1", "rank2"]).select(*PLACE, "rank", "depths"))
        q += 1
        here = asked().filter((F.col("depth") >= 1 << q) & (F.col("depth") < 2 << q)).withColumn("at", F.col("line") + F.col("depth") - (1 << q))
        ends = level.select("doc", "mark", F.col("line").alias("at"), F.col("rank").alias("rank2"))
        found = found.unionByName(later_copies(here.join(ends, ["doc", "mark", "at"]).drop("at")))
    return found


def deleted_spans(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, mark and the spans of lines to delete, of the documents that have any.

    A run that starts after all before it have ended opens a span; so a document's runs are
    merged in one pass over them.
    """
    runs = repeated_runs(rows, min_words).select("doc", "mark", F.col("line").alias("start"), (F.col("line") + F.col("depth")).alias("stop"))
    before = Window.partitionBy("doc", "mark").orderBy("start", "stop")
    opens = F.coalesce(F.col("start") > F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    placed = runs.withColumn("opens", opens.cast("int")).withColumn("span", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = placed.groupBy("doc", "mark", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.groupBy("doc", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def broadcastable(spans: DataFrame) -> DataFrame:
    """The spans, broadcast if there are few, counted; else joined as they are, which moves the texts once."""
    held = cut(spans)
    n = held.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0]
    return F.broadcast(held) if n <= BROADCAST_ROWS else held


def lines_kept(lines: Column, spans: Column) -> Column:
    """The lines between the spans."""
    size = F.size(lines)
    bounds = F.concat(spans, F.array(F.struct(size.alias("start"), size.alias("stop"))))
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["stop"]))
    return F.flatten(F.zip_with(ends, bounds, lambda end, x: F.slice(lines, end + 1, x["start"] - end)))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, the deleted spans of lines, n_deleted, and the text that stays."""
    rows = keyed(docs, id_col, text_col)
    spans = broadcastable(deleted_spans(rows, min_words).withColumnsRenamed({"doc": "doc2", "mark": "mark2"}))
    out = rows.join(spans, (F.col("doc") == F.col("doc2")) & (F.col("mark") == F.col("mark2")), "left").withColumn("lines", lines_of("text"))
    kept = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(lines_kept(F.col("lines"), F.col("spans")), "\n"))
    spans = F.coalesce("spans", F.array().cast(SPANS))
    return out.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        spans.alias("spans"),
        F.aggregate(spans, F.lit(0), lambda a, s: a + s["stop"] - s["start"]).cast("long").alias("n_deleted"),
        kept.alias("text"),
    )
