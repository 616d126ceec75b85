"""Benchmark decontamination by size-partitioned MinHash containment search.

Sets are the five-word shingles of a text (of fewer words, the whole sequence). An item
leaks into a document when the document holds at least ``threshold`` of its shingles.

Items are partitioned by their number of shingles (powers of two). The MinHash sketch of
an item keeps its k shingles with the smallest hashes; k depends on the partition: with
an upper size u, k = floor((1 - threshold) u) + 1. A document that contains the item may
lack at most k - 1 of its shingles, so one of the k must be in the document: the search
has no false negatives, however long the document. A document is read once; its shingle
hashes are looked up in the sorted sketch. A candidate is verified by exact containment
of the shingles' words.

Sketches and texts of the items are sent to the executors in blocks of at most
``BLOCK_BYTES`` of text; the documents are searched once for each block, and a block is
released before the next one is sent (``leaks``, whose parts run together, holds all of them).
An item's shingles are made when a document holds one of its sketch, and kept for
the last ``MOST_ITEMS`` such items. So a growing benchmark costs passes, not memory. No document
is shuffled, so neither copies nor frequent passages make a large task.

Words are runs of letters, digits and other non-ASCII characters, A-Z lower-cased.

Defined results: a null or wordless item matches nothing, a null or wordless document
holds nothing; items alike in text are each found; a repeated row, of documents or
items, is found each time; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import cut, text_batches

N, THRESHOLD = 5, 0.8
BLOCK_BYTES, MOST_ITEMS = 8_000_000, 2000
MOST_WORDS = 100_000
#: Bytes of a word as they are, A-Z in lower case, all others as a space.
TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127) else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


class WordHashes(dict):
    """word -> 64-bit hash, cleared when it has MOST_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


HASHES = WordHashes()


def shingle_hashes(words: list[bytes], n: int = N) -> np.ndarray:
    """A hash for each shingle, by place."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    m = max(1, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(min(n, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    return out ^ (out >> np.uint64(29))


def shingles(words: list[bytes], n: int = N) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def sketch_size(size: int, threshold: float) -> int:
    """k of the partition that a set of this size belongs to."""
    upper = 1 << max(0, size - 1).bit_length()
    return int((1 - threshold) * upper + 1e-9) + 1


class Block:
    """Sketches of some items, sorted for lookup, and their texts for the exact check."""

    def __init__(self, items: list[tuple[int, str]], n: int = N, threshold: float = THRESHOLD):
        self.n, self.threshold, self.items = n, threshold, []
        keys, owners, lengths = [], [], set()
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            hashes = np.unique(shingle_hashes(words, n))
            sketch = hashes[: sketch_size(len(hashes), threshold)]
            keys.append(sketch)
            owners.append(np.full(len(sketch), len(self.items), np.int64))
            self.items.append((item_id, b" ".join(words)))
            lengths.add(min(n, len(words)))
        keys, owners = np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.lengths = sorted(lengths - {n})
        self.made: dict[int, frozenset] = {}
        self.low = np.zeros(1 << 16, bool)  # a cheap first look: the keys' low bits
        self.low[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def wanted(self, k: int) -> frozenset:
        """The shingles of an item; remembered."""
        if k not in self.made:
            if len(self.made) >= MOST_ITEMS:
                self.made.clear()
            self.made[k] = frozenset(shingles(self.items[k][1].split(b" "), self.n))
        return self.made[k]

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, shingles found, shingles) of the items that the text holds."""
        words = words_of(text)
        if not words or not len(self.keys):
            return []
        found: set[int] = set()
        for n in (self.n, *self.lengths):  # an item of fewer words is one shorter shingle
            if n > len(words):
                continue
            h = shingle_hashes(words, n)
            h = h[self.low[(h & np.uint64(0xFFFF)).astype(np.int64)]]
            if len(h):
                a, b = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
                for x, y in set(zip(a[b > a].tolist(), b[b > a].tolist(), strict=True)):
                    found.update(self.owners[x:y].tolist())
        if not found:
            return []
        has = {n: set(shingles(words, n)) for n in (self.n, *self.lengths) if n <= len(words)}
        if len(words) < self.n:
            has.setdefault(len(words), set()).update(shingles(words, self.n))
        out = []
        for k in sorted(found):
            item_id, want = self.items[k][0], self.wanted(k)
            hit = len(want & has.get(len(next(iter(want))), set()))
            if hit >= self.threshold * len(want) - 1e-9:
                out.append((item_id, hit, len(want)))
        return out


def blocks_of(items: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> Iterator[Block]:
    """Blocks of items in order of their id; the driver holds one block's items at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in items.select(id_col, text_col).filter(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= BLOCK_BYTES:
            yield Block(held, n, threshold)
            held, size = [], 0
    if held:
        yield Block(held, n, threshold)


def leaks(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, n_found, n_shingles, containment."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_found long, n_shingles long, containment double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = []
    for block in blocks_of(items, item_id, item_text, n, threshold):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64()] * 4 + [pa.float64()]
            names = ["doc_id", "item_id", "n_found", "n_shingles", "containment"]
            for batch in batches:
                out = [(d, i, hit, size, hit / size) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, hit, size in sent.value.search(text)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        parts.append(text_batches(rows).mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item; all their columns. One pass a block, no join.

    Between two blocks the rows that stay are written to the shared folder, and the block is released.
    """
    sent = None
    for block in blocks_of(items, "item_id", "text", n, threshold):
        if sent is not None:
            docs = cut(docs)
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(block)
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.search(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = text_batches(docs).mapInArrow(run, docs.schema)
    return docs
