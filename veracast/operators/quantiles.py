"""Exact quantiles without a buffer of all values: equal values are counted, and only the ranges that hold a wanted rank are sorted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges for each factor e of growth of 1 + |x|: finite doubles fall into some millions at the very most, a feature's into a few thousand.
RANGES = 4096


def value_range(x: Column) -> Column:
    """The number of the range that holds x; never falls as x grows."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * RANGES)


def _ranked(values: DataFrame, key: str, probabilities: Column, few_keys: bool = False) -> DataFrame:
    """Distinct values (key, x, n) of the ranges that hold ranks asked for, with the asked place i, its rank ``at`` and the values ``upto`` x.

    Equal values are counted before they are shuffled; sums by range say which ranges hold the ranks (two each at most), and only
    those ranges' values are ranked. A key with a third of all rows is spread over its ranges. ``few_keys``: the number of keys is
    a constant, and so is that of the ranges found, which are then broadcast.
    """
    counts = values.groupBy(key, "x").agg(F.count("*").alias("n")).withColumn("range", value_range(F.col("x")))
    of_key = Window.partitionBy(key)
    sums = counts.groupBy(key, "range").agg(F.sum("n").alias("m"))
    sums = sums.withColumns({"end": F.sum("m").over(of_key.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("m").over(of_key)})
    wanted = sums.select(key, "range", (F.col("end") - F.col("m")).alias("before"), "end", "all", F.posexplode(probabilities).alias("i", "p"))
    wanted = wanted.withColumn("at", (F.col("all") - 1) * F.col("p")).where("ceil(at) >= before and floor(at) < end").select(key, "range", "before", "i", "at")
    near = counts.join(F.broadcast(wanted) if few_keys else wanted, [key, "range"])
    return near.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(key, "range", "i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))


def _quantile(here: Column) -> Column:
    """Aggregate of ranked values: the quantile interpolated between the two values at the rank, of rows that are ``here``."""
    upto, n = F.col("upto"), F.col("n")
    holds = lambda rank: F.max(F.when(here & (upto - n <= rank) & (rank < upto), F.col("x")))
    low, high, at = holds(F.floor("at")), holds(F.ceil("at")), F.max(F.when(here, F.col("at")))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def grouped_quantiles(values: DataFrame, key: str, probabilities: Sequence[float]) -> DataFrame:
    """Interpolated quantiles of ``x`` for each key, as rows (key, q), q an array. ``values`` has the columns key and x, a finite double."""
    ranked = _ranked(values, key, F.array(*(F.lit(float(p)) for p in probabilities)))
    return ranked.groupBy(key).agg(F.array(*(_quantile(F.col("i") == i) for i in range(len(probabilities)))).alias("q"))


def column_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> DataFrame:
    """One row with an array of quantiles for each column of ``wanted``, of its finite values; nulls where it has none."""
    pairs = F.array(*(F.struct(F.lit(k).alias("feature"), F.col(c).cast("double").alias("x")) for k, c in enumerate(wanted)))
    values = df.select(F.explode(pairs).alias("v")).select("v.*").where(F.abs("x") < float("inf"))
    asked = F.array(*(F.array(*(F.lit(float(p)) for p in ps)) for ps in wanted.values()))
    ranked = _ranked(values, "feature", asked[F.col("feature")], few_keys=True)
    # a row for each feature and place: one small aggregate instead of three for each of them
    width = max(map(len, wanted.values()), default=1)
    found = ranked.groupBy("feature", "i").agg(_quantile(F.lit(True)).alias("q"))
    one = found.agg(F.map_from_entries(F.collect_list(F.struct(F.col("feature") * width + F.col("i"), "q"))).alias("m"))
    return one.selectExpr(*("array({}) AS `{}`".format(", ".join(f"try_element_at(m, {k * width + i})" for i in range(len(ps))), c) for k, (c, ps) in enumerate(wanted.items())))
