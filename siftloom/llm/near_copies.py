"""Exact search for pairs of texts by the Jaccard similarity of their sets of word shingles.

The part of ``simhash.similar_groups`` that finds what fingerprints miss. Texts are linked when
the sets of their shingles (of fewer words, the whole sequence) have a similarity of x/y.

* All shingles have one order: rare ones by their hash first, then the common ones by
  their count. Linked sets with n and m shingles share at least x/(x + y) (n + m) of them, and
  have their first shared shingle among the first n - ceil(x/y n) + 1 of each. So every
  linked pair meets at a shingle of both prefixes, and no more are shared than follow there in
  the shorter rest. Pairs that cannot reach the similarity by that bound are dropped there.
* Which shingles are common is counted on an eighth of the texts. That moves the order
  only, and any order gives the same links.
* The candidates given, and the texts that meet, each with one text a shingle, the one with the
  fewest rarer shingles, are compared first; a large group of copies is mostly one component
  after that. Then all pairs of different components that meet and were not compared are
  compared: at each shingle those outside of its largest component with all others. A pair in
  one component needs no look.
* A candidate is verified by the sizes of the sets and of their intersection.

Sets are compared by 64-bit hashes of shingles; texts with one set are one node. Words are
as in ``simhash``. Null and wordless texts have one set, the empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import cut, sized, text_batches, tidy
from siftloom.llm.components import components
from siftloom.llm.decontaminate import HASHES

SHINGLE, SIMILARITY = 5, (4, 5)
#: Texts of which one is counted for the order, the copies there that make a shingle common, and the most common ones.
EACH, OFTEN, MOST_COMMON = 8, 2, 200_000
BUCKET_TEXTS = 2000
POSTING = np.dtype([("h", "<i8"), ("node", "<i8"), ("pos", "<i4")])


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, as unsigned longs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter((HASHES[w] for w in words), np.uint64, len(words))
    size = min(shingle, len(h))
    if not size:
        return h
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).astype(np.int64))


def sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node and its shingles, for each row of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                own = [shingle_set(t, shingle) for t in batch.column(0).slice(k, 100).to_pylist()]
                yield pa.record_batch([pa.array([node_of(x) for x in own], pa.int64()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["node", "own"])

    return text_batches(texts.select("text")).mapInArrow(run, "node long, own array<long>")


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, sorted, and their counts in one of EACH texts."""
    some = sets(texts.filter(F.pmod(F.xxhash64("text"), F.lit(EACH)) == 0), shingle).select(F.explode("own").alias("h"))
    most = some.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = most["h"].to_numpy(), most["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(own: np.ndarray, known: np.ndarray, counts: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """The first shingles of a set in the order of all."""
    x, y = similarity
    signed, many = own.view(np.int64), np.zeros(len(own), np.int64)
    if len(known) and len(own):
        at = np.minimum(np.searchsorted(known, signed), len(known) - 1)
        many = np.where(known[at] == signed, counts[at], 0)
    return signed[np.lexsort((signed, many))][: len(own) + x * len(own) // -y + 1]


def meets(texts: DataFrame, rows: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """h, node, n, pos: the shingles that prefixes of several nodes share.

    Prefixes are shuffled packed, those of a batch of texts with one bucket of hashes in one
    row; a bucket has the postings of about BUCKET_TEXTS texts.
    """
    known, counts = common_shingles(texts, shingle)
    buckets = rows.count() // BUCKET_TEXTS + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for t in batch.column(0).to_pylist():
                own = shingle_set(t, shingle)
                first = prefix(own, known, counts, similarity)
                part = np.empty(len(first), POSTING)
                part["h"], part["node"], part["pos"] = first, node_of(own), np.arange(len(first))
                parts.append(part)
            posts = np.concatenate(parts) if parts else np.empty(0, POSTING)
            bucket = posts["h"].astype(np.uint64) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            posts, bucket = posts[order], bucket[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
            blobs = [x.tobytes() for x in np.split(posts, at[1:])] if len(at) else []
            yield pa.record_batch([pa.array(bucket[at].astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "posts"])

    def shared(group: pa.Table) -> pa.Table:
        posts = np.unique(np.frombuffer(b"".join(group["posts"].to_pylist()), POSTING))
        same = posts["h"][1:] == posts["h"][:-1]
        posts = posts[np.r_[False, same] | np.r_[same, False]]
        return pa.table({"h": np.ascontiguousarray(posts["h"]), "node": np.ascontiguousarray(posts["node"]), "pos": np.ascontiguousarray(posts["pos"])})

    packed = text_batches(texts.select("text")).mapInArrow(pack, "bucket long, posts binary")
    met = packed.groupBy("bucket").applyInArrow(shared, "h long, node long, pos int")
    return cut(met.join(rows.select("node", "n").distinct(), "node").select("h", "node", "n", "pos"))


def reach(x: str, y: str, similarity: tuple[int, int]) -> Column:
    """Whether two nodes that share no shingle before this one can reach the similarity."""
    p, q = similarity
    return F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos")) * (p + q) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * p


def pairs_of(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that reach the similarity; the sets are made anew of the texts that are in a pair."""
    p, q = similarity
    wanted = sized(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct())
    own = cut(sets(texts, shingle).join(wanted, F.col("node") == F.col("wanted"), "left_semi").dropDuplicates(["node"]))
    left, right = own.select(F.col("node").alias("a"), F.col("own").alias("x")), own.select(F.col("node").alias("b"), F.col("own").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    return cut(both.filter(F.size(F.array_intersect("x", "y")) * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b"))


def links(texts: DataFrame, rows: DataFrame, candidates: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Links (a, b) between nodes, enough for their components; every link is verified.

    texts has the column text; rows has node and n (shingles) of each; candidates are pairs
    (a, b) of nodes to look at besides.
    """
    spark = texts.sparkSession
    met = meets(texts, rows, shingle, similarity)
    tidy(spark)
    middle = met.groupBy("h").agg(F.min_by(F.struct("node", "n", "pos"), F.struct("pos", "node")).alias("m")).select("h", "m.*")
    near = (F.col("x.h") == F.col("y.h")) & reach("x", "y", similarity)
    first = pairs_of(met.alias("x").join(middle.alias("y"), near & (F.col("x.node") != F.col("y.node"))))
    first = cut(first.unionByName(candidates).distinct())
    del candidates
    tidy(spark)
    found = verified(first, texts, shingle, similarity)
    tidy(spark)

    roots = components(found)
    named = met.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("h", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
    parts = named.groupBy("h", "root").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("h").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.count("*").alias("parts"), F.sum("size").alias("all")).filter("parts > 1 AND all > 2").drop("parts", "all")
    open_ = cut(named.join(mixed, "h"))
    apart = near & (F.col("x.root") != F.col("y.root"))
    rest = cut(pairs_of(open_.filter("root <> largest").alias("x").join(open_.alias("y"), apart)).join(first, ["a", "b"], "left_anti"))
    del named, parts, mixed, open_
    tidy(spark)
    return found if rest.isEmpty() else found.unionByName(verified(rest, texts, shingle, similarity))
