"""Strided count windows over signals.

A window ends at row ``window`` - 1 of its signal and every ``stride`` rows after, and
looks back ``window`` rows.  Three forms:

* ``framed``: aggregates over a row frame, kept at window ends.  One exchange and one
  streaming pass, in which every row's frame is summed; for windows at (almost) every row.
* ``gathered``: the same aggregates of windows as groups; for windows that overlap little.
* ``arrays``: every row is copied to the windows it lies in (ceil(window / stride) of
  them), and a window's rows are gathered.  Numbering and gathering share one exchange
  by (cohort, signal_id), and no gathered group is longer than a window.  Numbering sorts a
  whole signal in one task, unless ``blocks`` cuts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNAL = ["cohort", "signal_id"]


def numbered(obs: DataFrame, keys: list[str] = SIGNAL, order: str = "signal_0", blocks: int = 0) -> DataFrame:
    """Rows with a value, numbered (``i``) from 0 in the signal's order, and their count ``n``.

    A signal is numbered in one task.  ``blocks``: for signals that are too long for that,
    each is cut at so many quantiles of its axis, numbered block by block, and prefix
    counts of the blocks (a row each) give every block's first number."""
    rows = obs.where("value is not null and not isnan(value)")
    if not blocks:
        return rows.withColumns({"i": F.row_number().over(Window.partitionBy(*keys).orderBy(order, "value")) - 1, "n": F.count("*").over(Window.partitionBy(*keys))})
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(order, [k / blocks for k in range(1, blocks)] or [0.5], 10 * blocks).alias("__cuts"))
    rows = rows.join(cuts, keys).withColumn("__block", F.size(F.filter("__cuts", lambda c: c <= F.col(order)))).drop("__cuts")
    sizes = rows.groupBy(*keys, "__block").agg(F.count("*").alias("__size"))
    per = Window.partitionBy(*keys)
    first = sizes.select(*keys, "__block", (F.sum("__size").over(per.orderBy("__block")) - F.col("__size")).alias("__first"), F.sum("__size").over(per).alias("n"))
    own = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(order, "value"))
    return rows.join(first, [*keys, "__block"]).withColumn("i", F.col("__first") + own - 1).drop("__block", "__first")


def frame(window: int, keys: list[str] = SIGNAL, order: str = "signal_0"):
    return Window.partitionBy(*keys).orderBy(order, "value").rowsBetween(-(window - 1), 0)


def ends(window: int, stride: int) -> Column:
    """Whether row i ends a window."""
    return (F.col("i") >= window - 1) & ((F.col("i") - (window - 1)) % stride == 0)


def framed(obs: DataFrame, window: int, stride: int, columns: dict[str, Column]) -> DataFrame:
    """``columns``: aggregates over ``frame(window)``, as windows see them."""
    w = frame(window)
    rows = numbered(obs).withColumns({"signal_0_start": F.first("signal_0").over(w), **columns}).where(ends(window, stride))
    return rows.select(*SIGNAL, ((F.col("i") - (window - 1)) / stride).cast("long").alias("window_id"), "signal_0_start", F.col("signal_0").alias("signal_0_end"), ((F.col("signal_0_start") + F.col("signal_0")) / 2).alias("signal_0_center"), *columns)


def gathered(obs: DataFrame, window: int, stride: int, aggregates: dict[str, Column]) -> DataFrame:
    """The same as ``framed``, for few windows a row: rows are copied to the windows they lie
    in, and each window is a group.  The groups lie in the partitions of their signals, so
    that this costs no exchange more."""
    rows = numbered(obs).where(F.col("n") >= window)
    low = F.greatest(F.ceil((F.col("i") - (window - 1)) / stride), F.lit(0)).cast("long")
    high = F.least(F.floor(F.col("i") / stride), F.floor((F.col("n") - window) / stride)).cast("long")
    each = rows.select(*SIGNAL, "signal_0", "value", "i", F.explode(F.when(low <= high, F.sequence(low, high))).alias("window_id"))
    made = each.groupBy(*SIGNAL, "window_id").agg(F.min("signal_0").alias("signal_0_start"), F.max("signal_0").alias("signal_0_end"), *[c.alias(k) for k, c in aggregates.items()])
    return made.select(*SIGNAL, "window_id", "signal_0_start", "signal_0_end", ((F.col("signal_0_start") + F.col("signal_0_end")) / 2).alias("signal_0_center"), *aggregates)


def arrays(obs: DataFrame, window: int, stride: int, look_back: int | None = None, short: str = "drop", keys: list[str] = SIGNAL, blocks: int = 0) -> DataFrame:
    """(keys, window_id, signal_0_start, signal_0_end, signal_0_center, n_obs, s, y): the
    last ``look_back`` (default: ``window``) rows up to each window's end.

    ``short``: signals of fewer rows than a window give no row (``drop``) or one of all
    their rows (``one``)."""
    back = max(look_back or window, window)
    rows = numbered(obs, keys, blocks=blocks)
    # windows k with end e_k = window - 1 + k stride, e_k - back < i <= e_k
    low = F.greatest(F.ceil((F.col("i") - (window - 1)) / stride), F.lit(0)).cast("long")
    high = F.floor((F.col("i") + back - window) / stride).cast("long")
    last = F.floor((F.col("n") - window) / stride).cast("long")
    few = F.col("n") < window
    span = F.when(few, F.array(F.lit(0).cast("long")) if short == "one" else F.array().cast("array<bigint>")).otherwise(F.when(low <= F.least(high, last), F.sequence(low, F.least(high, last))))
    each = rows.select(*keys, "signal_0", "value", "i", F.explode(span).alias("window_id"))
    made = each.groupBy(*keys, "window_id").agg(F.sort_array(F.collect_list(F.struct("i", F.col("signal_0").alias("s"), F.col("value").alias("y")))).alias("x"))
    made = made.select(*keys, "window_id", F.transform("x", lambda p: p["s"]).alias("s"), F.transform("x", lambda p: p["y"]).alias("y"))
    size = F.least(F.size("y"), F.lit(window))
    start, end = F.element_at("s", -size), F.element_at("s", -1)
    return made.select(*keys, "window_id", start.alias("signal_0_start"), end.alias("signal_0_end"), ((start + end) / 2).alias("signal_0_center"), F.size("y").cast("long").alias("n_obs"), "s", "y")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over the shuffle's partitions before a kernel runs on each.  Arrays
    are small and kernels slow: by bytes the planner would put them into a few tasks, and
    by signal a long one would fill a task of its own."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
