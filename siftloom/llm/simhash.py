"""SimHash near-dedup with Golay-code fuzzy keys.

Fingerprint: 64 bits from 64-bit hashes of a text's word shingles; a bit is 1 if it is set
in over half of them. Two rules for a link, each with groups as the components of its links:

* ``near_groups``: fingerprints of three-word shingles (XXH64, seed 42, repeats included)
  that differ in at most ``RADIUS`` = 2 bits.
* ``similar_groups``: sets of five-word shingles with a Jaccard similarity of 0.8 or more.
  Fingerprints of those sets within 2 bits are candidates, verified by their sets. At 0.8 two
  fingerprints differ in ten bits of 64 on average, which no few Golay keys reach, so pairs
  that the fingerprints miss are found by an exact search over rare shingles (``near_copies``),
  which starts from the groups known by then. No link is lost.

Search among the distinct fingerprints (copies share one, so a hot group is one row):

* A fingerprint is cut into three segments of 23, 23 and 18 bits (the last one padded
  with zeros). Of at most 2 errors over three segments, one segment has none.
* The binary Golay code (23, 12) is perfect: every 23-bit word is within 3 errors of
  exactly one codeword. The keys of a word are the 12-bit indices of the codewords of
  the words within one error of it. Two words that differ in at most 2 bits have a word
  within one error of both, so they share a key. A word within 2 errors of its codeword
  has one key, another one a few.
* Join keys: an error-free segment's bits with each Golay key of a second segment
  (first with second, second with first, third with first). Every pair within 2 errors
  shares at least one join key.
* Fingerprints that meet under a join key are verified by their distance. A bucket up
  to ``BUCKET`` fingerprints compares its pairs and keeps only links; those of a larger
  bucket take an exact way that is linear in their number: two fingerprints differ in at
  most 2 bits just when a word within one error of both exists, so each links to the 65
  words within one error of it, and what meets at such a word within 2 errors is linked
  to the smallest that meets there.

Components of the links name each document's group by its smallest id. ``keep_one`` decides
rows by id and text, so a text under a repeated id is a document of its own.

Defined results: a null or wordless text has fingerprint 0 and is linked like any other;
fewer words than a shingle's are one shingle; a null id does not name a component unless all
ids of the component are null, and such a row stays only in a group without ids; repeated
rows are each returned by the groups, and one of them at most is kept; an empty table gives
an empty result; further columns are ignored, or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm import near_copies
from siftloom.llm.common import cut, looked_up, one_of_each, text_batches, text_mark, tidy
from siftloom.llm.components import components

SEED, SHINGLE, RADIUS = 42, 3, 2
BUCKET = 256
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011
#: (segment taken as it is, segment whose Golay keys are taken); segments start at these bits.
PAIRINGS = ((0, 1), (1, 0), (2, 0))
SEGMENTS = ((41, 23), (18, 23), (0, 18))  # (lowest bit, width)


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - SHINGLE + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].astype(">u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_mark(F.col(text_col)).alias("mark"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark and fp, the fingerprint as a signed long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(made)], names=["doc_id", "mark", "fp"])

    return text_batches(read(docs, id_col, text_col)).mapInArrow(run, "doc_id long, mark long, fp long")


def remainder(word: int) -> int:
    """Syndrome of a 23-bit word: its remainder by the generator polynomial."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def codeword_index() -> np.ndarray:
    """For each 23-bit word the index (its upper 12 bits) of the codeword within 3 errors."""
    singles = [1 << i for i in range(23)]
    errors = np.zeros(1 << 11, np.int64)
    flips = [0, *singles]
    flips += [a ^ b for i, a in enumerate(singles) for b in singles[:i]]
    flips += [a ^ b ^ c for i, a in enumerate(singles) for j, b in enumerate(singles[:i]) for c in singles[:j]]
    for e in flips:  # 1 + 23 + 253 + 1771 = 2^11 patterns, each with a syndrome of its own
        errors[remainder(e)] = e
    out = np.empty(1 << 23, np.int16)
    for start in range(0, 1 << 23, 1 << 18):
        words = np.arange(start, start + (1 << 18), dtype=np.int64)
        syndrome = np.zeros(len(words), np.int64)
        for i in range(23):
            syndrome ^= np.where(words >> i & 1, remainder(1 << i), 0)
        out[start : start + len(words)] = (words ^ errors[syndrome]) >> 11
    return out


def golay_keys(words: np.ndarray) -> np.ndarray:
    """A row of 24 indices for each word: of itself and of its 23 neighbours (with repeats)."""
    index = codeword_index()
    near = words[:, None] ^ np.array([0, *(1 << i for i in range(23))], np.int64)[None, :]
    return index[near]


def join_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: the distinct join keys of each fingerprint."""
    u = fps.view(np.uint64)
    segment = [((u >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    golay = {k: golay_keys(segment[k]).astype(np.int64) for k in {b for _, b in PAIRINGS}}
    rows, keys = [], []
    for k, (whole, fuzzy) in enumerate(PAIRINGS):
        key = (k << 36) | (segment[whole][:, None] << 12) | golay[fuzzy]
        key = np.sort(key, axis=1)
        first = np.ones(key.shape, bool)
        first[:, 1:] = key[:, 1:] != key[:, :-1]
        r, c = np.nonzero(first)
        rows.append(r)
        keys.append(key[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(distinct: DataFrame) -> DataFrame:
    """fp and key, for each join key of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for k in range(0, len(fps), 4096):
                rows, keys = join_keys(fps[k : k + 4096])
                yield pa.record_batch([pa.array(fps[k : k + 4096][rows]), pa.array(keys)], names=["fp", "key"])

    return distinct.select("fp").mapInArrow(run, "fp long, key long")


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough for their components; every link is verified."""
    keys = cut(keyed(distinct))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(keys.join(sizes, "key"))
    some = met.filter(F.col("n") <= bucket)
    left, right = some.select("key", F.col("fp").alias("a")), some.select("key", F.col("fp").alias("b"))
    small = left.join(right, "key").filter((F.col("a") < F.col("b")) & (apart(F.col("a"), F.col("b")) <= RADIUS)).select("a", "b")
    crowded = met.filter(F.col("n") > bucket).select("fp").distinct()
    around = [F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64))]
    hubs = crowded.select("fp", F.explode(F.transform(F.array(*around), lambda x: x.bitwiseXOR(F.col("fp")))).alias("hub"))
    lowest = hubs.groupBy("hub").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    large = hubs.join(lowest, "hub").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return small.unionByName(large).distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark, fp and root, a fingerprint that names the group, for every row."""
    marked = cut(fingerprints(docs, id_col, text_col))
    roots = components(links(marked.select("fp").distinct()))
    sizes = marked.groupBy("fp").agg(F.count("*").alias("n"))
    named = sizes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    return cut(looked_up(marked, cut(named), "fp", marked.count()).drop("n"))


def named_by_smallest(rows: DataFrame) -> DataFrame:
    """Adds component_id, the smallest id under the row's root."""
    smallest = cut(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
    return looked_up(rows, smallest, "root", rows.count())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row."""
    return named_by_smallest(grouped(docs, id_col, text_col)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def nodes(texts: DataFrame, shingle: int) -> DataFrame:
    """doc_id, mark, node (a hash of the set of shingles), n (shingles) and fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                own = near_copies.shingle_set(text, shingle)
                made.append((near_copies.node_of(own), len(own), majority(own)))
            node, n, fp = (np.array([m[k] for m in made], t) for k, t in enumerate((np.int64, np.int32, np.uint64)))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(node), pa.array(n), pa.array(fp.view(np.int64))], names=["doc_id", "mark", "node", "n", "fp"])

    return text_batches(texts).mapInArrow(run, "doc_id long, mark long, node long, n int, fp long")


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are linked, enough for the components of these links."""
    distinct = cut(rows.select("node", "fp").distinct())
    low = cut(distinct.groupBy("fp").agg(F.min("node").alias("low"), F.count("*").alias("n")))
    same = looked_up(distinct, low, "fp", distinct.count()).filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    of = lambda side: low.select(F.col("fp").alias(side), F.col("low").alias(f"{side}_low"))
    near = links(low).join(of("a"), "a").join(of("b"), "b").select(F.col("a_low").alias("a"), F.col("b_low").alias("b"))
    both = same.unionByName(near)
    return cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def similar(docs: DataFrame, shingle: int, similarity: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark and root, a node that names the group, for every row."""
    texts = read(docs, id_col, text_col)
    rows = cut(nodes(texts, shingle))
    guesses = candidates(rows)
    tidy(texts.sparkSession)
    roots = components(near_copies.links(texts, rows, guesses, shingle, similarity))
    tidy(texts.sparkSession)
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"))
    named = sizes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    return cut(looked_up(rows.select("doc_id", "mark", "node"), cut(named), "node", rows.count()).select("doc_id", "mark", "root"))


def similar_groups(docs: DataFrame, shingle: int = near_copies.SHINGLE, similarity: tuple[int, int] = near_copies.SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id for every row, by the similarity (as a fraction) of sets of shingles."""
    return named_by_smallest(similar(docs, shingle, similarity, id_col, text_col)).select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = near_copies.SHINGLE, similarity: tuple[int, int] | None = near_copies.SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that have the smallest id of their group, all columns; without a similarity, by ``near_groups``."""
    rows = similar(docs, shingle, similarity, id_col, text_col) if similarity else grouped(docs, id_col, text_col)
    return one_of_each(docs, rows, id_col, text_col)
