"""The observation table and other tables read into it.

Observations are long: cohort, signal_id, signal_0 (the order: time, cycle or any
monotone coordinate, not necessarily even), value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULT_COHORT

#: The headerless text format of turbofan run-to-failure data: a unit, a cycle, three
#: settings, 21 sensors.
CMAPSS_COLUMNS = ["unit_id", "cycle", "op1", "op2", "op3", *[f"s{i}" for i in range(1, 22)]]


def conform(df: DataFrame) -> DataFrame:
    """Cast to the observation schema; a missing or null cohort becomes the default."""
    cohort = F.coalesce(F.col("cohort").cast("string"), F.lit(DEFAULT_COHORT)) if "cohort" in df.columns else F.lit(DEFAULT_COHORT)
    return df.select(cohort.alias("cohort"), F.col("signal_id").cast("string").alias("signal_id"), F.col("signal_0").cast("double").alias("signal_0"), F.col("value").cast("double").alias("value"))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder of observations; nothing is sorted here, the windows
    that need an order sort within their partitions."""
    return conform(spark.read.parquet(path))


def read_cmapss(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the text format; short rows leave nulls, surplus fields are cut."""
    parts = F.split(F.trim("value"), " +")
    own = [F.try_element_at(parts, F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate(CMAPSS_COLUMNS)]
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(*own)


def cmapss_observations(wide: DataFrame, sensors: list[str] | None = None) -> DataFrame:
    """Sensors of the text format as observations, one cohort a unit, cycles from 0."""
    sensors = sensors or CMAPSS_COLUMNS[5:]
    ids = wide.select(F.concat(F.lit("engine_"), F.col("unit_id").cast("int").cast("string")).alias("cohort"), (F.col("cycle") - 1).alias("signal_0"), *sensors)
    return unpivot(ids, ["cohort", "signal_0"], sensors)


def unpivot(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide to long: a row for each key and column with a value."""
    return wide.unpivot(keys, columns, "signal_id", "value").where("value is not null").select("cohort", "signal_id", F.col("signal_0").cast("double").alias("signal_0"), F.col("value").cast("double").alias("value"))


def signal_ids(obs: DataFrame, limit: int = 10_000) -> list[str]:
    """The signals' names in order; a pivot's columns are known up front, so that
    Spark needs no pass of its own.  More than ``limit`` are refused."""
    found = [r[0] for r in obs.select("signal_id").distinct().orderBy("signal_id").limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} signals: a wide table of them is not sensible")
    return found


def pivot(obs: DataFrame, signals: list[str] | None = None) -> DataFrame:
    """Long to wide: cohort, signal_0 and a column for each signal.  Where a key repeats,
    the mean of its values is taken, which no order can change."""
    return obs.groupBy("cohort", "signal_0").pivot("signal_id", signals or signal_ids(obs)).agg(F.avg("value"))


def select(obs: DataFrame, cohorts: list[str] | None = None, signals: list[str] | None = None) -> DataFrame:
    """The observations of some cohorts or signals.  Conditions on columns of the table: they
    reach the scan, and a table written by cohort is pruned to its folders."""
    for name, own in (("cohort", cohorts), ("signal_id", signals)):
        if own is not None:
            obs = obs.where(F.col(name).isin(own))
    return obs


def interpolate(obs: DataFrame, axis: bool = False) -> DataFrame:
    """Missing values (null or NaN) filled on the line between their neighbours, by row (or
    along the ``axis`` signal_0); those before the first and after the last take its value.
    A signal without any value stays missing."""
    order = Window.partitionBy("cohort", "signal_id").orderBy("signal_0")
    v = F.nanvl(F.col("value"), F.lit(None))
    rows = obs.withColumns({"__v": v, "__i": F.row_number().over(order)})
    at = F.col("signal_0") if axis else F.col("__i").cast("double")
    rows = rows.withColumn("__p", F.when(F.col("__v").isNotNull(), F.struct(at.alias("__at"), "__v"))).withColumn("__at", at)
    # a frame that ends at the last row would be read to its end from every row: seen backwards instead
    known = lambda i: F.last("__p", True).over(Window.partitionBy("cohort", "signal_id").orderBy(i).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__b", known(F.col("__i"))).withColumn("__a", known(F.desc("__i")))
    gap = F.col("__a.__at") - F.col("__b.__at")
    line = F.col("__b.__v") + (F.col("__a.__v") - F.col("__b.__v")) * F.try_divide(F.col("__at") - F.col("__b.__at"), gap)
    return rows.withColumn("value", F.coalesce("__v", line, "__b.__v", "__a.__v")).drop("__v", "__i", "__at", "__p", "__b", "__a")


def impute_mean(wide: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Missing values of the columns replaced by the column's mean (within ``keys``), by 0 if
    there is none."""
    if keys is not None:
        w = Window.partitionBy(*keys)
        return wide.withColumns({c: F.coalesce(F.nanvl(c, F.lit(None)), F.avg(F.nanvl(c, F.lit(None))).over(w), F.lit(0.0)) for c in columns})
    means = wide.agg(*[F.avg(F.nanvl(c, F.lit(None))).alias(f"__{c}") for c in columns])
    made = wide.join(F.broadcast(means), F.lit(True))  # one row
    return made.withColumns({c: F.coalesce(F.nanvl(c, F.lit(None)), F.col(f"__{c}"), F.lit(0.0)) for c in columns}).drop(*[f"__{c}" for c in columns])


def event_observations(events: DataFrame, cohorts: int = 8, even: bool = True) -> DataFrame:
    """Event rows as observations: users fall into cohorts, event types are signals.
    ``even``: the order is the row's number, else seconds."""
    cohort, signal = (F.col("user_id") % cohorts).cast("string").alias("cohort"), F.col("event_type").alias("signal_id")
    if even:
        number = F.row_number().over(Window.partitionBy("cohort", "signal_id").orderBy("event_id")) - 1
        return events.select(cohort, signal, "event_id", F.col("value").cast("double").alias("value")).select("cohort", "signal_id", number.cast("double").alias("signal_0"), "value")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return events.select(cohort, signal, seconds.alias("signal_0"), F.col("value").cast("double").alias("value"))


def lineitem_wide(lineitem: DataFrame) -> DataFrame:
    """Line items as a machine's sensors: cohort, signal_0, q, p, d, t."""
    cohort = F.concat("l_returnflag", F.lit("_"), (F.col("l_suppkey") % 4).cast("string"))
    order = Window.partitionBy("cohort").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = lineitem.select(cohort.alias("cohort"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    value = lambda c: (F.col(c).cast("double") + F.lit(0.0))  # noqa: E731  (no negative zeros)
    return rows.select("cohort", (F.row_number().over(order) - 1).cast("double").alias("signal_0"), value("l_quantity").alias("q"), value("l_extendedprice").alias("p"), value("l_discount").alias("d"), value("l_tax").alias("t"))


def lineitem_observations(lineitem: DataFrame) -> DataFrame:
    return unpivot(lineitem_wide(lineitem), ["cohort", "signal_0"], ["q", "p", "d", "t"])
