"""Kernels over small grids and vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftloom.functions.scoring import range_score
from siftloom.functions.text import let


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x).cast("double"))


def std(x: Column) -> Column:
    """Population standard deviation."""
    squares = lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v.cast("double") - m) * (v.cast("double") - m))
    return let(mean(x), lambda m: F.sqrt(F.try_divide(squares(m), F.size(x).cast("double"))))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))


def changed_fraction(a: Column, b: Column, threshold: float) -> Column:
    return F.size(F.filter(difference(a, b), lambda d: d > threshold)) / F.size(a).cast("double")


def mean_absolute_difference(a: Column, b: Column) -> Column:
    return mean(difference(a, b))


def masked(x: Column, mask: Column) -> Column:
    """The values where the mask is true."""
    kept = F.filter(F.arrays_zip(x.alias("v"), mask.alias("m")), lambda p: p["m"])
    return F.transform(kept, lambda p: p["v"])


def difference_mask(a: Column, b: Column, threshold: float) -> Column:
    return F.transform(difference(a, b), lambda d: d > threshold)


def adaptive_mask(delta: Column, k: float) -> Column:
    """Values above mean + k standard deviations."""
    return let(mean(delta) + k * std(delta), lambda limit: F.transform(delta, lambda d: d > limit))


def correlation(a: Column, b: Column) -> Column:
    cov = lambda ma, mb: F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - ma) * (y.cast("double") - mb)), F.lit(0.0), lambda s, v: s + v)
    return let(mean(a), lambda ma: let(mean(b), lambda mb: cov(ma, mb))) / F.greatest(std(a) * std(b) * F.size(a), F.lit(1e-12))


def gradient(x: Column) -> Column:
    """Differences of neighbours."""
    return F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda b, a: b.cast("double") - a.cast("double"))


def peak_ratio(mse: Column, cap: float = 60.0) -> Column:
    """Peak signal-to-noise ratio for values up to 255, at most ``cap``."""
    return F.least(F.lit(cap), 10.0 * F.log10(F.lit(255.0 * 255.0) / F.greatest(mse, F.lit(1e-12))))


def region_statistics(a: Column, b: Column, mask: Column) -> Column:
    """Mean differences inside and outside a mask, its share, and the precision of the change."""
    d = difference(a, b)
    inside, outside = masked(d, mask), masked(d, F.transform(mask, lambda m: ~m))
    got, all_ = total(inside), total(d)
    return F.struct(
        F.coalesce(mean(inside), F.lit(0.0)).alias("inside"),
        F.coalesce(mean(outside), F.lit(0.0)).alias("outside"),
        (F.size(inside) / F.size(d).cast("double")).alias("share"),
        F.coalesce(F.try_divide(got, all_), F.lit(0.0)).alias("precision"),
    )


def masked_statistics(a: Column, b: Column, mask: Column, threshold: float = 18 / 255) -> Column:
    """How an edit keeps to its region, of grids with values in [0, 1]: areas, changes, changed shares, errors, precision.

    A region without cells has no change and no error; without cells outside the whole grid
    stands for the outside. Peak ratios stop at 60.
    """
    d, n = difference(a, b), F.size(a).cast("double")
    rest = F.transform(mask, lambda m: ~m)
    inside, outside = masked(d, mask), masked(d, rest)
    outside = F.when(F.size(outside) > 0, outside).otherwise(d)
    hit = lambda x: F.size(F.filter(x, lambda v: v > threshold)).cast("double")
    squares = lambda x: F.coalesce(mean(F.transform(x, lambda v: v * v)), F.lit(0.0))
    share = lambda x: F.coalesce(F.try_divide(hit(x), F.size(x).cast("double")), F.lit(0.0))
    peak = lambda e: F.when(e <= 1e-12, 60.0).otherwise(F.least(F.lit(60.0), -10.0 * F.log10(e)))
    own, other = hit(inside), hit(masked(d, rest))
    return F.struct(
        (F.size(inside) / n).alias("target_area"),
        (F.size(masked(d, rest)) / n).alias("outside_area"),
        (hit(d) / n).alias("changed_fraction"),
        F.coalesce(mean(inside), F.lit(0.0)).alias("target_change"),
        mean(outside).alias("outside_change"),
        share(inside).alias("target_changed_fraction"),
        share(outside).alias("outside_changed_fraction"),
        (own / n).alias("target_changed_pixels"),
        (other / n).alias("outside_changed_pixels"),
        F.when(own + other > 0, own / (own + other)).otherwise(1.0).alias("localization"),
        squares(inside).alias("target_mse"),
        squares(outside).alias("outside_mse"),
        peak(squares(inside)).alias("target_psnr"),
        peak(squares(outside)).alias("outside_psnr"),
    )


def difference_statistics(a: Column, b: Column, width: int, threshold: float = 18 / 255) -> Column:
    """Of the changed cells of two row-major grids: share, mean change inside and outside, how compact they are, precision."""
    d = difference(a, b)
    mask = F.transform(d, lambda v: v > threshold)
    places = F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    inside, outside = masked(d, mask), masked(d, F.transform(mask, lambda m: ~m))
    span = lambda f: F.array_max(F.transform(places, f)) - F.array_min(F.transform(places, f)) + 1
    box = span(lambda i: i % width) * span(lambda i: F.floor(i / width))
    own = F.coalesce(mean(inside), F.lit(0.0))
    other = F.coalesce(mean(outside), own)
    return F.struct(
        (F.size(places) / F.size(d).cast("double")).alias("changed_fraction"),
        own.alias("inside"),
        other.alias("outside"),
        mean(d).alias("total"),
        F.coalesce(F.size(places) / box.cast("double"), F.lit(0.0)).alias("compactness"),
        (own / F.greatest(own + other, F.lit(1e-6))).alias("precision"),
    )


def latent_scores(a: Column, b: Column, low: Column, high: Column, least: float = 0.02, k: float = 1.0, keep_t: float = 0.25, most: float = 0.35, drift_t: float = 0.2) -> Column:
    """struct(preservation, validity) of two latent grids: the relative change is cut at mean + k deviations.

    Outside of it little may change; the changed share should be within [low, high], and the
    mean change not beyond ``most``.
    """
    size = F.zip_with(a, b, lambda x, y: F.greatest(0.5 * (F.abs(x.cast("double")) + F.abs(y.cast("double"))), F.lit(1e-4)))

    def scored(delta: Column, average: Column, limit: Column) -> Column:
        outside = F.coalesce(mean(F.filter(delta, lambda d: d <= limit)), average)
        changed = F.size(F.filter(delta, lambda d: d > limit)) / F.size(delta).cast("double")
        drift = F.exp(-F.greatest(F.lit(0.0), average - most) / drift_t)
        return F.struct(F.exp(-outside / keep_t).alias("preservation"), F.sqrt(F.greatest(range_score(changed, low, high) * drift, F.lit(0.0))).alias("validity"))

    # bound names: what a lambda names is else evaluated for each element
    delta = F.zip_with(difference(a, b), size, lambda d, s: d / s)
    return let(delta, lambda x: let(mean(x), lambda m: let(F.greatest(F.lit(least), m + k * std(x)), lambda limit: scored(x, m, limit))))


def locality(inside: Column, outside: Column, temperature: float) -> Column:
    return F.exp(-outside / F.greatest(inside, F.lit(1e-6)) / temperature)


def box_mask(width: int, x0: Column, y0: Column, x1: Column, y1: Column, height: int | None = None) -> Column:
    """A row-major grid that is true within a box."""
    cells = F.sequence(F.lit(0), F.lit(width * (height or width) - 1))
    return F.transform(cells, lambda c: (c % width >= x0) & (c % width < x1) & (F.floor(c / width) >= y0) & (F.floor(c / width) < y1))


def dilate(mask: Column, width: int, radius: int = 1) -> Column:
    """A row-major mask with the cells within ``radius`` of a true cell, row by row and column by column."""
    near = [dy * width + dx for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]

    def any_near(_: Column, i: Column) -> Column:
        hit = F.lit(False)
        for off in near:
            dx = (off + radius * width + radius) % width - radius
            same_row = F.floor((i + dx) / width) == F.floor(i / width)
            hit = hit | (same_row & F.coalesce(F.get(mask, i + off), F.lit(False)))
        return hit

    return F.transform(mask, any_near)


def masked_mean_pool(states: Column, mask: Column, size: int) -> Column:
    """Mean of the vectors whose mask is true."""
    kept = masked(states, mask)
    zero = F.array_repeat(F.lit(0.0), size)
    sums = lambda own: F.aggregate(own, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return let(kept, lambda own: let(F.size(own).cast("double"), lambda n: F.transform(sums(own), lambda x: F.try_divide(x, n))))
