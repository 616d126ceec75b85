"""Mixing sources to target weights by the cube method.

Every source has a target of words. A document of a source whose target is f times
its size is wanted f times: floor(f) copies are certain, one more has the inclusion
probability f - floor(f). Which documents get the further copy is a balanced sample:
the flight phase moves the vector of probabilities through the null space of the
constraints (words and documents of a source), so both totals stay as they are while
one probability after the other reaches 0 or 1. At most two stay fractional for the
two constraints; the landing phase decides these few, and makes up for their rounding by one
exchange of like documents.

The flight runs in blocks of ``BLOCK`` documents of one source, so a hot source is
many tasks. What a block leaves (two documents at most) goes to blocks of the next
level, until one block holds a source's rest; it lands there. Blocks and directions
come from hashes of the ids, so reruns agree.

Targets are shares of all sizes by weight. A source's target stops at ``MAX_COPIES``
times its size; what exceeds it is shared again by weight among the others until none
is above.

Defined results: a null or empty text has size 0 and is taken 0 times its size; a null
source sorts last and is a source like any other; rows alike in id are each rows of
their own: rows alike in id, text and source are counted, numbered and dealt to blocks in
lots of ``LOT`` at most, so reruns agree on them too; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftloom.llm.common import cut, sized
from siftloom.operators.ordinal import numbered

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
BLOCK, LOT = 2000, 500
EPS = 1e-9


def targets(per: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """source_no, source, source_size, source_rows and target from (source, words, n), one row a source.

    Sources are numbered in the order of their code points, null last; the weights repeat.
    Each round caps the sources whose share is above ``cap`` times their size and shares
    the rest again; only sums come to the driver.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    plan = numbered(per, [F.col("source").asc_nulls_last()], "source_no").withColumn("w", w)
    plan = cut(plan.select("source_no", "source", F.col("words").alias("source_size"), F.col("n").alias("source_rows"), "w", F.lit(None).cast("double").alias("target")))
    total = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        free = F.col("target").isNull()
        share, held = plan.agg(F.sum(F.when(free, F.col("w"))), F.coalesce(F.sum("target"), F.lit(0.0))).first()
        if share is None:
            return plan.drop("w")
        own = F.lit(float(total) - held) * F.col("w") / F.lit(share)
        most = F.col("source_size") * float(cap)
        if plan.filter(free & (own > most)).isEmpty():
            plan = plan.withColumn("target", F.when(free, own).otherwise(F.col("target")))
        else:
            plan = plan.withColumn("target", F.when(free & (own > most), most).otherwise(F.col("target")))
        plan = cut(plan)


def uniform(key: str) -> float:
    """A number in [0, 1) from a key, the same on every run; those of different keys are unrelated."""
    return int.from_bytes(blake2b(key.encode(), digest_size=7).digest(), "big") / 2**56


def direction(a: np.ndarray) -> np.ndarray:
    """A vector of the null space of a 2 x 3 matrix: the cross product of its rows, or a null vector of the first."""
    u = np.cross(a[0], a[1])
    if np.abs(u).max() > EPS * max(1.0, np.abs(a).max()):
        return u / np.abs(u).max()
    return np.array([1.0, -1.0, 0.0])


def flight(probs: np.ndarray, sizes: np.ndarray, key: str) -> np.ndarray:
    """Moves the probabilities, in order, until at most two are strictly between 0 and 1.

    Three documents move at a time; a settled one makes room for the next.
    """
    p = probs.astype(float).copy()
    scale = max(1.0, float(sizes.max())) if len(sizes) else 1.0
    size = sizes / scale
    active: list[int] = []
    step = 0
    for i in range(len(p)):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = round(p[i])
            continue
        active.append(i)
        while len(active) == 3:
            u = direction(np.array([[1.0, 1.0, 1.0], size[active]]))
            x = p[active]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > EPS, (1 - x) / u, np.where(u < -EPS, -x / u, np.inf)).min()
                down = np.where(u > EPS, x / u, np.where(u < -EPS, (x - 1) / u, np.inf)).min()
            step += 1
            move = up if uniform(f"{key}/{step}") * (up + down) < down else -down
            x = x + move * u
            x[x < EPS], x[x > 1 - EPS] = 0.0, 1.0
            p[active] = x
            active = [k for k in active if 0 < p[k] < 1]
    return p


def landing(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Decides the few fractional entries: of all roundings, the one whose words come nearest to the expected ones.

    What is then missing or too much is made up by the best exchange of one document that
    is in for one that is out, which leaves the number of documents as it is.
    """
    out = p.copy()
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    want = float((p[open_] * sizes[open_]).sum())
    best: tuple | None = None
    for bits in range(1 << len(open_)):
        take = [(bits >> k) & 1 for k in range(len(open_))]
        off = sum(t * sizes[i] for t, i in zip(take, open_, strict=True)) - want
        if best is None or (abs(off), bits) < (abs(best[0]), best[1]):
            best = (off, bits, take)
    for t, i in zip(best[2], open_, strict=True):
        out[i] = float(t)
    inside, outside = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
    if not len(inside) or not len(outside):
        return out
    outside = outside[np.argsort(sizes[outside], kind="stable")]
    at = np.searchsorted(sizes[outside], sizes[inside] - best[0])
    near = np.stack([np.clip(at - 1, 0, len(outside) - 1), np.clip(at, 0, len(outside) - 1)])
    left = np.abs(best[0] + sizes[outside][near] - sizes[inside])
    side, k = np.unravel_index(left.argmin(), left.shape)
    if left[side, k] < abs(best[0]):
        out[inside[k]], out[outside[near[side, k]]] = 0.0, 1.0
    return out


STATE = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("tie", T.LongType()), ("size", T.LongType()), ("source_no", T.LongType()), ("base", T.IntegerType()), ("p", T.DoubleType()))]
)


def lots(measured: DataFrame) -> DataFrame:
    """Rows alike as one with their number ``times``; more than LOT of them as several rows, each with a tie of its own."""
    alike = measured.groupBy(*measured.columns).agg(F.count("*").alias("all"))
    lot = alike.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / LOT))))
    tie = F.when(F.col("lot") > 0, F.xxhash64("tie", "lot")).otherwise(F.col("tie"))
    return lot.withColumn("times", F.least(F.lit(LOT), F.col("all") - F.col("lot") * LOT).cast("int")).withColumn("tie", tie).drop("all", "lot")


def each(rows: DataFrame) -> DataFrame:
    """A row for each of the rows alike."""
    return rows.withColumn("of", F.explode(F.sequence(F.lit(1), "times"))).drop("of", "times")


def fly(rows: DataFrame, level: int, seed: str) -> DataFrame:
    """One level of flights; rows has ``block``, ``lands`` and ``times`` beside the state. A source that lands is in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, lands = None, False
        names = [f.name for f in STATE]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]

        def done() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[2], r[1], r[0] is None, r[0] or 0))  # documents of like size meet
            sizes = np.array([r[2] for r in held], dtype=float)
            p = flight(np.array([r[5] for r in held]), sizes, f"{seed}/{level}/{at}")
            p = landing(p, sizes) if lands else p
            cols = [*list(zip(*held, strict=True))[:5], p.tolist()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*names, "block", "lands")]
            for *row, block, last in zip(*cols, strict=True):
                if (row[3], block) != at:
                    if held:
                        yield done()
                        held.clear()
                    at, lands = (row[3], block), last
                held.append(tuple(row))
        if held:
            yield done()

    dealt = each(rows.repartition("source_no", "block")).sortWithinPartitions("source_no", "block")
    return dealt.mapInArrow(run, STATE)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_COPIES, seed: str = "mix", block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every document."""
    if block < 8:
        raise ValueError("a block holds eight documents at least")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    measured = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("size"), "source", F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("tie")))
    plan = targets(measured.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")), weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    alike = lots(measured)
    rows = alike.join(sized(plan), alike["source"].eqNullSafe(plan["source"])).select("doc_id", "tie", "size", "times", "source_no", "source_rows", ratio.alias("f"))
    rows = rows.withColumn("base", F.least(F.floor(F.col("f") + EPS), F.lit(cap)).cast("int")).withColumn("p", F.greatest(F.col("f") - F.col("base"), F.lit(0.0)))
    rows = cut(rows.withColumn("p", F.when((F.col("p") < EPS) | (F.col("size") == 0), 0.0).otherwise(F.col("p"))))
    state = [f.name for f in STATE]
    settled = [each(rows.filter("p = 0").select(*state, "times"))]
    facts = sized(plan.select("source_no", "source_size", "target", "source_rows"))
    open_ = rows.filter("p > 0").select(*state, "times")
    level, most, left = 0, plan.agg(F.coalesce(F.max("source_rows"), F.lit(0))).first()[0], F.col("source_rows")
    while most:
        blocks = F.ceil(left / block).cast("long")
        placed = open_.join(facts, "source_no")
        placed = placed.select(*state, "times", F.pmod(F.xxhash64("tie", F.lit(level)), blocks).alias("block"), (blocks <= 1).alias("lands"))
        flown = cut(fly(placed, level, seed))
        settled.append(flown.filter("p = 0 or p = 1"))
        if most <= block:
            break
        open_ = flown.filter("p > 0 and p < 1").withColumn("times", F.lit(1))
        level, left, most = level + 1, 2 * F.ceil(left / block), 2 * -(-most // block)
    done = settled[0]
    for part in settled[1:]:
        done = done.unionByName(part)
    copies = (F.col("base") + F.col("p").cast("int")).cast("long")
    return done.join(facts, "source_no").select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))
