"""Running statistics and the distribution of a per-key measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillsight.operators.ranking import nearest_rank, order_statistics


def stat_counter(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, sum, sum of squares, mean, sample variance, deviation, standard error, min and max; merges map-side.

    The sample variance of fewer than two rows is NaN, and so is everything but count and sum (0) of none. Sums are sums
    of doubles; use ``exact_sum`` where the values are money.
    """
    v = F.col(value).cast("double")
    nan = F.lit(float("nan"))
    some = df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
        F.coalesce(F.sum(v * v), F.lit(0.0)).alias("sum_of_squares"), F.coalesce(F.avg(v), nan).alias("mean"),
        F.coalesce(F.var_samp(v), nan).alias("variance"), F.coalesce(F.stddev_samp(v), nan).alias("stdev"),
        F.coalesce(F.min(v), nan).alias("min"), F.coalesce(F.max(v), nan).alias("max"))
    return some.withColumn("stderr", F.coalesce(F.try_divide("stdev", F.sqrt("count")), nan))


def metric_distribution(df: DataFrame, name: str, keys: Sequence[Column], measure: Column, points: int,
                        to_long: Column | None = None) -> DataFrame:
    """``(stat, point, value)``: a measure is taken per key and turned into a long; point i is the nearest-rank value at
    fraction i / (points - 1) over all keys.

    ``measure`` is any aggregate column; ``to_long`` works on the column ``measure``, a plain cast by default.
    """
    return distribution_of(per_key_measures(df, keys, {"measure": measure}), name, "measure", points, to_long)


def per_key_measures(df: DataFrame, keys: Sequence[Column], measures: dict[str, Column]) -> DataFrame:
    """Several measures per key in one pass, a column each; without keys one row."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    aggregates = [m.alias(n) for n, m in measures.items()]
    return (df.groupBy(*named) if named else df).agg(*aggregates).select(*measures)


def distribution_of(per_key: DataFrame, name: str, measure: str, points: int, to_long: Column | None = None) -> DataFrame:
    """``(stat, point, value)`` of one measure; ``to_long`` works on the column ``measure``."""
    per_key = per_key.select(F.col(measure).alias("measure"))
    value = F.col("measure").cast("bigint") if to_long is None else to_long
    ranked = order_statistics(per_key.select(value.alias("measure")), "measure", points, nearest_rank(points))
    return ranked.select(F.lit(name).alias("stat"), "point", "value")
