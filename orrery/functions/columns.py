"""Column builders: window features that Catalyst computes itself.

Frame aggregates take a WindowSpec; array features take an array column.  Whatever a
float could make undefined (a zero variance, a logarithm of zero) is guarded to null, as
ANSI mode would fail."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

TINY = 1e-15


def frame_features(w: WindowSpec | None, value: str = "value", index: str = "i") -> dict[str, Column]:
    """Moments, size and trend over a frame of at least four rows; without a frame as
    aggregates of a group."""
    over = (lambda c: c) if w is None else (lambda c: c.over(w))
    y, x, n = F.col(value), F.col(index), over(F.count(value))
    m2 = over(F.var_pop(y))
    rms = F.sqrt(over(F.avg(y * y)))
    varies = (m2 > TINY) & (n >= 4)
    slope = over(F.regr_slope(y, x))
    r2 = over(F.regr_r2(y, x))
    return {
        "n_obs": n,
        "mean": over(F.avg(y)),
        "std": over(F.stddev_pop(y)),
        "kurtosis": F.when(varies, over(F.kurtosis(y))),
        "skewness": F.when(varies, over(F.skewness(y))),
        "crest_factor": F.when((n >= 4) & (rms > TINY), over(F.max(F.abs(y))) / rms),
        "rms": rms,
        "peak": over(F.max(F.abs(y))),
        "peak_to_peak": over(F.max(y)) - over(F.min(y)),
        "trend_slope": F.when(n >= 3, slope),
        "trend_r2": F.when(n >= 3, F.when(m2 > TINY, r2).otherwise(0.0)),
        "detrend_std": F.when(n >= 3, F.sqrt(F.greatest(m2 * (1 - F.when(m2 > TINY, r2).otherwise(0.0)), F.lit(0.0)))),
        "pulsation_index": F.when(n >= 10, (over(F.max(y)) - over(F.min(y))) / (F.abs(over(F.avg(y))) + 1e-10)),
        "flow_mean": F.when(n >= 10, over(F.avg(y))),
        "flow_range": F.when(n >= 10, over(F.max(y)) - over(F.min(y))),
    }


def array_mean(y: Column) -> Column:
    return F.try_divide(F.aggregate(y, F.lit(0.0), lambda a, v: a + v), F.size(y).cast("double"))


def pairs(y: Column, lag: int) -> Column:
    """(x, y) structs of elements ``lag`` apart."""
    n = F.greatest(F.size(y) - lag, F.lit(0))
    return F.zip_with(F.slice(y, 1, n), F.slice(y, lag + 1, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def acf(y: Column, lag: int) -> Column:
    """Autocorrelation with the full sum of squares below (biased); null without variance."""
    m = array_mean(y)
    total = F.aggregate(y, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    cross = F.aggregate(pairs(y, lag), F.lit(0.0), lambda a, p: a + (p["a"] - m) * (p["b"] - m))
    return F.when((total > TINY) & (F.size(y) > lag), F.try_divide(cross, total))


def diffs(y: Column, lag: int = 1) -> Column:
    return F.transform(pairs(y, lag), lambda p: p["b"] - p["a"])


def var_samp_array(y: Column) -> Column:
    m = array_mean(y)
    return F.try_divide(F.aggregate(y, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), (F.size(y) - 1).cast("double"))


def variance_ratio(y: Column, q: int) -> Column:
    """Var of q-step differences over q times the var of single steps (both of ddof 1)."""
    return F.when(F.size(y) >= 20, F.try_divide(var_samp_array(diffs(y, q)), q * var_samp_array(diffs(y))))


def zero_crossings(y: Column) -> Column:
    """Changes of sign, where 0 has a sign of its own."""
    return F.aggregate(pairs(y, 1), F.lit(0), lambda a, p: a + F.when(F.signum(p["a"]) != F.signum(p["b"]), 1).otherwise(0))


def centred(y: Column) -> Column:
    """Less the mean; a difference within the rounding of the mean's sum is 0."""
    own = F.struct(array_mean(y).alias("m"), (F.array_max(F.transform(y, lambda v: F.abs(v))) * 1e-12).alias("least"))
    # an array of one, so that its mean is not made anew for every value
    return F.transform(F.array(own), lambda p: F.transform(y, lambda v: F.when(F.abs(v - p["m"]) <= p["least"], 0.0).otherwise(v - p["m"])))[0]


def rates(y: Column) -> dict[str, Column]:
    d = diffs(y)
    m = array_mean(d)
    spread = F.sqrt(F.try_divide(F.aggregate(d, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), F.size(d).cast("double")))
    own = {"mean_rate": m, "max_rate": F.array_max(d), "min_rate": F.array_min(d), "rate_std": spread, "abs_max_rate": F.array_max(F.transform(d, lambda v: F.abs(v)))}
    return {k: F.when(F.size(y) >= 3, v) for k, v in own.items()}


def ordinal_patterns(y: Column) -> Column:
    """The order pattern (0 to 5) of every three neighbours, ties by place."""
    n = F.greatest(F.size(y) - 2, F.lit(0))
    two = F.zip_with(F.slice(y, 1, n), F.slice(y, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.zip_with(two, F.slice(y, 3, n), lambda p, c: (p["a"] > p["b"]).cast("int") + 2 * (p["a"] > c).cast("int") + 4 * (p["b"] > c).cast("int"))


def entropy_of(labels: Column, base: float | None = None) -> Column:
    """Shannon entropy of the labels' shares (bits, or in another base)."""
    n = F.size(labels).cast("double")
    share = lambda v: F.size(F.filter(labels, lambda x: x == v)).cast("double") / n
    bits = F.aggregate(F.array_distinct(labels), F.lit(0.0), lambda a, v: a - share(v) * F.log2(share(v)))
    return bits if base is None else bits / F.log2(F.lit(float(base)))


def permutation_entropy(y: Column) -> Column:
    """Order 3, delay 1, as a share of log2(3!)."""
    return F.when(F.size(y) >= 4, entropy_of(ordinal_patterns(y), 6.0))


def level_labels(y: Column, bins: int = 10) -> Column:
    """Discrete levels: the values' ranks if at most ``bins`` differ, else equal-width bins
    closed on the right, so that the minimum has a level of its own."""
    few = F.array_sort(F.array_distinct(y))
    low, width = F.array_min(y), (F.array_max(y) - F.array_min(y)) / bins
    binned = F.transform(y, lambda v: F.ceil(F.try_divide(v - low, width) - 1e-9).cast("int"))
    return F.when(F.size(few) <= bins, F.transform(y, lambda v: F.array_position(few, v).cast("int"))).otherwise(binned)


def runs(y: Column) -> Column:
    """(value, length) of the runs of equal neighbours, in order: one fold whose state is
    the runs so far."""
    kind = "array<struct<v:double,n:int>>"
    one = lambda v, n: F.struct(v.cast("double").alias("v"), n.cast("int").alias("n"))

    def step(a, v):
        last = F.try_element_at(a, F.lit(-1))
        same = last["v"] == v
        return F.when(F.coalesce(same, F.lit(False)), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(one(v, last["n"] + 1)))).otherwise(F.concat(a, F.array(one(v, F.lit(1)))))

    return F.aggregate(y, F.array().cast(kind), step)


def moments(x: Column) -> dict[str, Column]:
    m = array_mean(x)
    std = F.sqrt(F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), F.size(x).cast("double")))
    return {"mean": m, "std": std, "max": F.array_max(x), "min": F.array_min(x), "cv": F.when(F.abs(m) > 1e-10, std / m)}
