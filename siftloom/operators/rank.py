"""Rankings within groups; every order ends in candidate_index, so ties keep their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.operators.ordinal import held, numbered


def group(*order: Column) -> Window:
    w = Window.partitionBy("group_id")
    return w.orderBy(*order) if order else w


def best_of_n(df: DataFrame, top_m: int = 1) -> DataFrame:
    """rnk among the feasible by reward (0 if not), accepted for the first top_m, status."""
    place = F.row_number().over(group(F.desc("feasible"), F.desc("reward"), F.asc("candidate_index")))
    out = df.withColumn("rnk", F.when(F.col("feasible"), place).otherwise(0).cast("long"))
    accepted = F.col("feasible") & (F.col("rnk") <= top_m)
    return out.withColumn("accepted", accepted).withColumn("status", F.when(accepted, "accepted").otherwise("rejected"))


def minmax(x: Column) -> Column:
    """x brought to [0, 1] within its group; 0.5 in a constant group."""
    low, high = F.min(x).over(group()), F.max(x).over(group())
    return F.when(high - low < 1e-6, 0.5).otherwise((x - low) / F.greatest(high - low, F.lit(1e-6)))


def hard_gated(df: DataFrame, base: Column, instruction: Column, preservation: Column, spread: Column, floors: tuple[float, float], weights: tuple[float, float], top_m: int, min_quality: float, max_spread: float) -> DataFrame:
    """Two gates, min-max of the base score over all rows, rank of the feasible, acceptance cut by quality and disagreement after the rank."""
    out = df.withColumn("base_score", base).withColumn("instruction_score", instruction).withColumn("preservation_score", preservation).withColumn("spread", spread)
    out = out.withColumn("relative", minmax(F.col("base_score")))
    out = out.withColumn("feasible", (F.col("instruction_score") >= floors[0]) & (F.col("preservation_score") >= floors[1]))
    out = out.withColumn("quality", (weights[0] * F.col("base_score") + weights[1] * F.col("relative")) / sum(weights))
    place = F.row_number().over(group(F.desc("feasible"), F.desc("quality"), F.asc("candidate_index")))
    out = out.withColumn("rnk", F.when(F.col("feasible"), place).otherwise(0).cast("long"))
    return out.withColumn("accepted", F.col("feasible") & (F.col("rnk") <= top_m) & (F.col("quality") >= min_quality) & (F.col("spread") <= max_spread))


def generic(df: DataFrame, score: Column, top_m: int = 1) -> DataFrame:
    """No gates: 0.7 of the score and 0.3 of its place within the group's range."""
    out = df.withColumn("score", score)
    out = out.withColumn("total", 0.70 * F.col("score") + 0.30 * minmax(F.col("score")))
    out = out.withColumn("rnk", F.row_number().over(group(F.desc("total"), F.asc("candidate_index"))).cast("long"))
    return out.withColumn("accepted", F.col("rnk") <= top_m)


def shortlist(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each group for a judge: feasible, raw reward, reward, all descending."""
    place = F.row_number().over(group(F.desc("feasible"), F.desc("raw_reward"), F.desc("reward"), F.asc("candidate_index")))
    return df.withColumn("place", place.cast("long")).filter(F.col("place") <= most)


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def family_balance(df: DataFrame, key: str, order: list[Column], most: int | None = None, fraction: float | None = None) -> DataFrame:
    """Adds kept: the first rows of each key, at most ``most`` and at most a fraction of all rows.

    The count of all rows comes from an aggregate of one row, not from a window over
    everything; for it the rows are held in a checkpoint.
    """
    if fraction is not None:
        df = held(df)
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    limit = F.lit(most).cast("long") if most is not None else F.lit(None).cast("long")
    if fraction is not None:
        total = df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(fraction))).cast("long").alias("_share"))
        ranked = ranked.join(F.broadcast(total))
        limit = F.least(limit, F.col("_share"))
    kept = F.col("place") <= limit if most is not None or fraction is not None else F.lit(True)
    return ranked.withColumn("kept", kept).drop("_share")


def stratified(df: DataFrame, strata: list[str], key: str, seed: int, k: int) -> DataFrame:
    """Adds digest, place and selected: the first k of each stratum by the SHA-256 of seed, stratum and key."""
    digest = F.sha2(F.concat_ws("\0", F.lit(str(seed)), *strata, key), 256)
    out = df.withColumn("digest", digest)
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy("digest", key)).cast("long"))
    return out.withColumn("selected", F.col("place") <= k)


def deficits(df: DataFrame, strata: list[str], k: int) -> DataFrame:
    return df.groupBy(*strata).agg(F.count("*").alias("found")).filter(F.col("found") < k).withColumn("need", F.lit(k).cast("long"))


def apportion(labels: DataFrame, count: int) -> DataFrame:
    """Largest remainder quotas of a small table (pos, label, weight); without weight an even split, the rest to the first."""
    # a table of labels is small by nature: one row a label
    total = labels.agg(F.sum("weight").alias("_total"), F.count("*").alias("_n"))
    wide = labels.join(F.broadcast(total))
    raw = F.when(F.col("_total") > 0, F.col("weight") * count / F.col("_total")).otherwise(F.lit(float(count)) / F.col("_n"))
    base = wide.withColumn("_raw", raw).withColumn("_floor", F.floor("_raw").cast("long"))
    base = base.withColumn("_frac", F.when(F.col("_total") > 0, F.col("_raw") - F.col("_floor")).otherwise(0.0))
    used = base.agg((F.lit(count) - F.sum("_floor")).cast("long").alias("_left"))
    order = Window.orderBy(F.desc("_frac"), F.desc("weight"), F.asc("pos"))
    out = base.join(F.broadcast(used)).withColumn("_place", F.row_number().over(order))
    return out.select("pos", "label", "weight", (F.col("_floor") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("quota"))


def shard(df: DataFrame, ordinal: str, total: int, start: int, count: int) -> DataFrame:
    """``count`` rows from ``start`` on, going on at the beginning after the last."""
    return df.withColumn("slot", F.pmod(F.col(ordinal) - start, F.lit(total)).cast("long")).filter(F.col("slot") < count)


def cursor_sample(rows: DataFrame, label: str, key: str, quotas: DataFrame, round_: int, seed: int, count: int, interleave: bool = False) -> DataFrame:
    """A round's ``count`` rows: place, label, key and whether the row fills up.

    quotas has pos (the labels' order), label and quota. Each label's rows are in hash order and a
    cursor goes on round by round, starting over after the last. Interleaved, the labels
    take turns, and a row that a small label would give again counts once; else its
    repeats stay. What is then missing is filled up from the rows that were not
    taken, in another hash order.
    """
    digest = lambda salt: F.sha2(F.concat_ws("\0", F.lit(salt), F.col(label), F.col(key).cast("string")), 256)
    order = Window.partitionBy(label).orderBy(digest(f"{seed}:{round_}"), key)
    placed = held(rows.select(label, key).withColumn("_k", F.row_number().over(order) - 1))
    sizes = placed.groupBy(label).agg(F.count("*").alias("_size"))
    plan = quotas.filter("quota > 0").select("pos", F.col("label").alias(label), "quota").join(sizes, label)
    start = (round_ - 1) * F.col("quota")
    wanted = plan.select(label, "pos", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("_turn"), start.alias("_start"))
    wanted = wanted.withColumn("_k", F.pmod(F.col("_start") + F.col("_turn"), F.col("_size")).cast("int"))
    taken = wanted.join(placed, [label, "_k"])
    if interleave:
        taken = taken.filter(F.col("_turn") < F.col("_size"))
    sequence = [F.asc("_turn"), F.asc("pos")] if interleave else [F.asc("pos"), F.asc("_turn")]
    first = held(numbered(taken.select(label, key, "_turn", "pos"), sequence, "place").filter(F.col("place") <= count).select("place", label, key))
    short = count - first.count()
    out = first.withColumn("fills", F.lit(False))
    if short <= 0:
        return out
    rest = rows.select(label, key).join(first.select(key).distinct(), key, "left_anti")
    more = numbered(rest.orderBy(digest(f"{seed}:{round_}:fill"), key).limit(short), [digest(f"{seed}:{round_}:fill"), F.asc(key)], "place")
    return out.unionByName(more.select((F.col("place") + (count - short)).alias("place"), label, key).withColumn("fills", F.lit(True)))


def fold_difficulty(rates: DataFrame, order: str, rate: str, first: int = 2, low: int = 1, high: int = 3, promote: float = 0.65, demote: float = 0.25) -> DataFrame:
    """The level after each round, promoted and demoted by the rounds' rates in order.

    One row a round: a fold over an ordered array.
    """
    rounds = rates.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(rate).alias("r")))).alias("rounds"))

    def step(acc: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["level"], F.lit(first))
        level = F.when(x["r"] >= promote, F.least(last + 1, F.lit(high))).when(x["r"] <= demote, F.greatest(last - 1, F.lit(low))).otherwise(last)
        return F.concat(acc, F.array(F.struct(x["o"].alias("o"), x["r"].alias("r"), level.cast("int").alias("level"))))

    start = F.filter(F.transform("rounds", lambda x: F.struct(x["o"].alias("o"), x["r"].alias("r"), F.lit(0).alias("level"))), lambda x: F.lit(False))
    folded = rounds.select(F.explode(F.aggregate("rounds", start, step)).alias("x"))
    return folded.select(F.col("x.o").alias(order), F.col("x.r").alias(rate), F.col("x.level").cast("long").alias("level"))


def fill_forward(df: DataFrame, value: str, keys: list[str], order: str) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
