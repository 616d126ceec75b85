"""Scoring functions as column expressions.

Absent numbers are NULL. ``finite`` turns NaN and the infinities into NULL on the way in,
since Spark orders NaN above every number.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def col(x: Number | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clamp(x: Number | str, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; NULL stays NULL, though greatest and least skip it."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(x))))


def round6(x: Column, places: int = 6) -> Column:
    """Half up in binary arithmetic, the same in any engine with IEEE doubles."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def finite(x: Column, default: float | None = None) -> Column:
    """x as a double; NULL, NaN and infinities give the default."""
    d = x.cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < math.inf)
    return F.when(ok, d).otherwise(F.lit(default).cast("double"))


def finite_text(x: Column, default: float | None = None) -> Column:
    """Like finite, and a text is read as a number."""
    return finite(x.try_cast("double"), default)


def first_finite(columns: Sequence[Column], default: float | None = None) -> Column:
    """The first finite of several; skips what is absent or not finite."""
    return F.coalesce(*(finite(c) for c in columns), F.lit(default).cast("double"))


def first_present(columns: Sequence[Column], default: float | None = None) -> Column:
    """The first present of several; the default if that one is not finite."""
    return finite(F.coalesce(*(c.cast("double") for c in columns)), default)


def first_truthy(columns: Sequence[Column], default: float = 0.0) -> Column:
    """The first that is neither absent nor zero."""
    return F.coalesce(*(F.nullif(finite(c), F.lit(0.0)) for c in columns), F.lit(default))


def sigmoid(x: Number | str) -> Column:
    e = F.exp(-F.abs(col(x)))
    return F.when(col(x) >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def range_score(x: Number | str, low: Number, high: Number) -> Column:
    """1 within [low, high], falling off linearly outside."""
    v, a, b = col(x), col(low), col(high)
    below, above = clamp(v / F.greatest(a, F.lit(1e-6))), clamp(1.0 - (v - b) / F.greatest(1.0 - b, F.lit(1e-6)))
    return F.when(v < a, below).when(v > b, above).otherwise(1.0)


def directional_score(value: Number | str, target: Number, direction: Column | str) -> Column:
    """Progress towards a target by direction: increase, decrease, at_most."""
    v, t = col(value), col(target)
    d = direction if isinstance(direction, Column) else F.lit(direction)
    floor = F.greatest(t, F.lit(1e-6))
    over = clamp(1.0 - (v - t) / F.greatest(1.0 - t, F.lit(1e-6)))
    return F.when(d == "increase", clamp(v / floor)).when(d == "decrease", clamp(-v / floor)).when(v <= t, 1.0).otherwise(over)


def stat_total(global_score: Number | str, area: Number | str, edge: Number | str) -> Column:
    """0.7 global + 0.3 local, local half area and half edge."""
    return 0.7 * col(global_score) + 0.3 * (0.5 * col(area) + 0.5 * col(edge))


def spatial_score(scope: Column, area: Column, edge: Column, outside: Column, compact: Column) -> Column:
    local = 0.25 * area + 0.25 * edge + 0.30 * outside + 0.20 * compact
    return F.when(scope == "local", local).otherwise(0.35 * area + 0.25 * edge + 0.25 * outside + 0.15 * compact)


def cycle_score(change: Column, edge: Column, recovery: Column) -> Column:
    return 0.4 * change + 0.3 * edge + 0.3 * recovery


def weighted_mean(pairs: Sequence[tuple[Column, float]], default: float = 0.0) -> Column:
    """Mean over positive weights; absent values leave their weight out."""
    used = [(v, w) for v, w in pairs if w > 0]
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in used), F.lit(0.0))
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in used), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(default)


def geometric_mean(values: Sequence[Column], default: float = 0.0, floor: float = 1e-6) -> Column:
    """Geometric mean of the present values, clamped to [floor, 1]."""
    # each value is an element of an array, so it is evaluated once however often the steps name it
    logs = F.array_compact(F.transform(F.array(*(v.cast("double") for v in values)), lambda v: F.when(finite(v).isNotNull(), F.ln(F.greatest(clamp(v), F.lit(floor))))))
    total = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(logs) > 0, F.exp(total / F.size(logs))).otherwise(default)


def geometric_blend(a: Column, weight_a: float, b: Column, weight_b: float, floor: float = 1e-6) -> Column:
    logs = weight_a * F.ln(F.greatest(clamp(a), F.lit(floor))) + weight_b * F.ln(F.greatest(clamp(b), F.lit(floor)))
    return F.exp(logs / (weight_a + weight_b))


def disagreement(values: Sequence[Column]) -> Column:
    """Population standard deviation across columns."""
    n = len(values)
    mean = sum(values[1:], values[0]) / n
    squares = [(v - mean) * (v - mean) for v in values]
    return F.sqrt(sum(squares[1:], squares[0]) / n)


def judge_unit(score: Column) -> Column:
    """A judge's score brought to [0, 1] from the scale that it seems to use."""
    s = finite_text(score)
    return clamp(F.when(s > 10, s / 100.0).when(s > 5, s / 10.0).when(s > 1, (s - 1.0) / 4.0).otherwise(s))


def contrast_margin(own: Column, best_other: Column, scale: float = 1.0) -> Column:
    return clamp(0.5 + 0.5 * (own - best_other) / scale)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def cosine01(a: Column, b: Column) -> Column:
    return 0.5 * (1.0 + cosine(a, b))


def prompt_gain(edited: Column, original: Column, text: Column) -> Column:
    return cosine(edited, text) - cosine(original, text)


def edit_specificity(margin: Column, gain: Column, min_gain: float, margin_t: float, gain_t: float) -> Column:
    return F.sqrt(sigmoid(margin / margin_t) * sigmoid((gain - min_gain) / gain_t))


def semantic_preservation(unit_cosine: Column, temperature: float) -> Column:
    return F.exp(-(1.0 - unit_cosine) / temperature)


def edit_score(specificity: Number | str, taxonomy: Number | str) -> Column:
    return F.sqrt(F.greatest(col(specificity) * col(taxonomy), F.lit(0.0)))


def raw_reward(edit: Number | str, preservation: Number | str) -> Column:
    return F.sqrt(F.greatest(col(edit) * col(preservation), F.lit(0.0)))


def checked_reward(source: Column, edit_success: Column, preservation: Column, validity: Column) -> Column:
    return source * geometric_mean([edit_success, preservation, validity])


def forbidden_gate(kind: Column, absent: Column, supported: Column, threshold: float, hard: tuple[Sequence[str], float], soft_kinds: Sequence[str], soft: Sequence[tuple[Column, float]]) -> Column:
    """Whether what must not be seen is absent.

    Of hard kinds there must be evidence, and it must reach a floor of its own; of the others no
    evidence passes. Soft kinds that miss the threshold pass where all the scores of ``soft``
    reach their floors.
    """
    hard_kinds, hard_threshold = hard
    firm = kind.isin(*hard_kinds)
    strict = F.when(firm, (supported > 0) & (absent >= hard_threshold)).otherwise((absent >= threshold) | (supported <= 0))
    softened = ~firm & kind.isin(*soft_kinds)
    for value, floor in soft:
        softened = softened & F.coalesce(value >= floor, F.lit(False))
    return F.coalesce(strict, F.lit(False)) | F.coalesce(softened, F.lit(False))


def mean_of(values: Column) -> Column:
    """Mean of an array; null if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def geometric_mean_of(values: Column, default: float = 1.0, floor: float = 1e-6) -> Column:
    """geometric_mean of an array; the default if it is empty."""
    logs = F.transform(values, lambda v: F.ln(F.greatest(F.least(v, F.lit(1.0)), F.lit(floor))))
    return F.when(F.size(values) > 0, F.exp(F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size(values))).otherwise(default)


def gate_scores(proxy: Column, told: Column, proxy_supported: Column, told_supported: Column, edge: Column, outside: Column, local: Column, told_needed: bool = False) -> tuple[Column, Column]:
    """Instruction and preservation scores of the gates: 0.70 proxy + 0.30 told by the model, 0.55 edges + 0.45 outside.

    Without a proxy the model's word counts alone, without that the proxy. Where the model's
    word is needed and not there, the instruction score is 0.
    """
    said = F.when(F.coalesce(proxy_supported, F.lit(1.0)) <= 0, F.coalesce(told, proxy)).otherwise(F.coalesce(0.70 * proxy + 0.30 * told, proxy))
    said = F.when(F.lit(told_needed) & (F.coalesce(told_supported, F.lit(0.0)) <= 0), 0.0).otherwise(said)
    return clamp(said), clamp(0.55 * F.coalesce(edge, local) + 0.45 * F.coalesce(outside, local))


def taxonomy_score(main: Column, target: Column, drops: Column, wrong: Column, supported: Column, t: float = 0.05, wrong_t: float = 0.05, drop_t: float = 0.05, needed: bool = False) -> Column:
    """How well an edit's gains by prompt (arrays) fit its kind: main, target, against wrong kinds, and the source's loss."""
    gain = F.coalesce(mean_of(main), F.lit(0.0))
    parts = [
        sigmoid(gain / t),
        sigmoid(F.coalesce(mean_of(target), gain) / t),
        F.when(F.size(wrong) > 0, sigmoid((gain - F.array_max(wrong)) / wrong_t)).otherwise(1.0),
        F.when(F.size(drops) > 0, sigmoid(mean_of(drops) / drop_t)),
    ]
    return F.when(supported, geometric_mean(parts)).otherwise(0.0 if needed else 1.0)


def grounding_score(supports: Column, center: float = 0.5, t: float = 0.1) -> Column:
    """Geometric mean over prompts (array): the source is seen before the edit; 1 without prompts."""
    return geometric_mean_of(F.transform(supports, lambda s: sigmoid((s - center) / t)))


def required_score(gains: Column, supports: Column, least: float = 0.0, center: float = 0.5, gain_t: float = 0.05, t: float = 0.1) -> Column:
    """Geometric mean over prompts: what must be seen gained, and is seen."""
    return geometric_mean_of(F.zip_with(gains, supports, lambda g, s: F.sqrt(sigmoid((g - least) / gain_t) * sigmoid((s - center) / t))))


def absence_score(gains: Column, before: Column, after: Column, least: float = 0.0, center: float = 0.5, gain_t: float = 0.05, t: float = 0.1) -> Column:
    """Geometric mean over prompts: what must not be seen lost, and is not seen."""
    drops = F.zip_with(gains, F.zip_with(before, after, lambda b, a: b - a), lambda g, d: F.greatest(-g, d))
    return geometric_mean_of(F.zip_with(drops, after, lambda d, a: F.sqrt(sigmoid((d - least) / gain_t) * sigmoid((center - a) / t))))


def kept_score(unit_cosines: Column, temperature: float = 0.1) -> Column:
    """Geometric mean over prompts: what is to be preserved looks the same."""
    return geometric_mean_of(F.transform(unit_cosines, lambda c: F.exp(-(1.0 - c) / temperature)))


def combined_reward(edit_success: Column, detector: Column, detector_supported: Column, specificity: Column, taxonomy: Column, taxonomy_counts: Column, preservations: Sequence[Column], combine: bool = True) -> Column:
    """Geometric mean of the semantic components that there are, with that of the preservation scores."""
    parts = [edit_success, F.when(detector_supported, detector)]
    if combine:
        parts += [specificity, F.when(taxonomy_counts, taxonomy)]
    return geometric_mean([geometric_mean(parts), geometric_mean(preservations)])


def feature_score(before: Column, after: Column, blank: Column, supported: Column, scale: float = 0.05, weight: float = 0.65, neutral: float = 0.5) -> Column:
    """Instruction score from the gain of the text's unit cosine, with preservation of the blank one; neutral without support."""
    told = clamp(0.5 + 0.5 * (after - before) / scale)
    return F.when(supported, weight * told + (1.0 - weight) * blank).otherwise(neutral)


def difficulty_band(rate: Column, center: float = 0.5, sigma: float = 0.25) -> Column:
    spread = 2.0 * max(sigma, 1e-6) ** 2
    return F.exp(-((rate - center) * (rate - center)) / spread)


def accepted_weight(reward: Column, mode: str = "reward", scale: float = 1.0) -> Column:
    """Weight of an accepted sample; a reward outside (0, 1] raises in mode reward."""
    if mode == "uniform":
        return F.lit(float(scale))
    if mode != "reward":
        raise ValueError(f"no such weight mode: {mode}")
    r = finite(reward)
    bad = F.raise_error(F.concat(F.lit("reward outside (0, 1]: "), F.coalesce(reward.cast("string"), F.lit("null")))).cast("double")
    return F.when((r > 0) & (r <= 1), r * float(scale)).otherwise(bad)


def rejected_weight(raw: Column, low: float, high: float, least: float, most: float, power: float = 1.0) -> Column:
    return least + (most - least) * F.pow(clamp((raw - low) / max(high - low, 1e-6)), F.lit(power))


def pair_weight(margin: Column, base: Column | float = 1.0, multipliers: Iterable[Column] = (), scale: float = 0.5, clip: float = 0.5, cap: float = 1.5) -> Column:
    product = col(base)
    for m in multipliers:
        product = product * m
    return F.least(F.lit(cap), product * (1.0 + scale * F.least(F.greatest(margin, F.lit(0.0)), F.lit(clip))))


def success_multiplier(count: Column, need: float, least: float, power: float = 1.0) -> Column:
    return least + (1.0 - least) * F.pow(F.least(F.lit(1.0), count / need), F.lit(power))


def seed(base: int, round_: Column, record: Column, proposal: Column, candidate: Column, stride: int = 1009, offset: int = 0) -> Column:
    return F.lit(base + offset).cast("long") + round_.cast("long") * 1_000_003 + record.cast("long") * stride + proposal.cast("long") * 101 + candidate.cast("long")


def rounds_needed(n: Column, each: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(n / max(1, each)).cast("long"))


def schedule(batches: Column, accumulate: Column, epochs: Column, steps: Column) -> Column:
    """struct(updates_per_epoch, steps, epochs): a number of steps decides the epochs, without one the epochs the steps."""
    updates = F.ceil(batches / accumulate).cast("long")
    return F.struct(updates.alias("updates_per_epoch"), F.coalesce(steps, epochs * updates).alias("steps"), F.when(steps.isNotNull(), F.ceil(steps / updates).cast("long")).otherwise(epochs).alias("epochs"))


def resume_position(step: Column, batches: Column, accumulate: Column) -> Column:
    """struct(epoch, skip): where to go on after so many updates; the last update of an epoch may be a short one."""
    updates = F.ceil(batches / accumulate).cast("long")
    return F.struct(F.floor(step / updates).cast("long").alias("epoch"), F.least(F.pmod(step, updates) * accumulate, batches).alias("skip"))


def rounded_side(area: Column, ratio: Column, step: int = 32) -> tuple[Column, Column]:
    """Width and height for an area and a ratio, rounded half even to a multiple of step."""
    width = F.sqrt(area * ratio)
    return tuple((F.bround(x / step) * step).cast("long") for x in (width, width / ratio))


def replay_count(n: Column, ratio: float) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.bround(n * ratio).cast("long"))


def improvement_percent(base: Column, now: Column) -> Column:
    return F.lit(100.0) * F.try_divide(now - base, base)


def same(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= tolerance
