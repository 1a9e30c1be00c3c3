"""Stored partial results that merge without the fact rows: statistic states and sketches of distinct values.

A table's partials are a row for each key. Partials of several tables (days, regions, loads) are put together and merged by aggregates
over those rows alone, in any order and as often as needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

STATE = ("origin", "n", "offset", "m2", "low", "high")
SKETCH_BITS = 12


# -- statistic states

def stat_states(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, origin, n, offset, m2, low, high``: number, mean, sum of squared deviations and range of the values of each key.

    The mean is ``origin + offset``, with some value of the table as the origin, so values that are far from zero and close to each
    other lose nothing. Nulls are passed over; a key without values has n = 0 and nulls.
    """
    v = F.col(value).cast("double")
    some = df.filter(v.isNotNull() & ~F.isnan(v)).select(v.alias("v")).first()
    origin = F.lit(some["v"] if some and math.isfinite(some["v"]) else 0.0)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v - origin).alias("offset"), (F.var_pop(v - origin) * F.count(v)).alias("m2"),
        F.min(v).alias("low"), F.max(v).alias("high")).select(*keys, origin.alias("origin"), *STATE[1:])


def merge_states(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One state for each key of the given ones, by the pairwise formula: deviations add up, and so do those of the means.

    All means are counted from the least origin of the table of states, which is one value.
    """
    least = states.filter("n > 0").agg(F.min("origin")).scalar()
    n = F.col("n").cast("double")
    moved = states.withColumn("_o", F.coalesce(least, F.lit(0.0))).withColumn("_d", (F.col("origin") - F.col("_o")) + F.col("offset"))
    # A second origin for each key, near its means: squares of differences stay small.
    near = moved.filter("n > 0").groupBy(*keys).agg(F.min("_d").alias("_near"))
    moved = moved.join(near, list(keys), "left") if keys else moved.crossJoin(F.broadcast(near))
    apart = F.col("_d") - F.col("_near")
    return moved.groupBy(*keys).agg(
        F.first("_o").alias("origin"), F.sum("n").alias("n"), F.try_divide(F.sum(n * apart), F.sum(n)).alias("_shift"),
        F.first("_near", True).alias("_near"), F.sum("m2").alias("_m2"), F.sum(n * apart * apart).alias("_between"),
        F.min("low").alias("low"), F.max("high").alias("high")).select(
        *keys, "origin", "n", (F.col("_near") + F.col("_shift")).alias("offset"),
        (F.col("_m2") + F.greatest(F.col("_between") - F.col("n") * F.col("_shift") * F.col("_shift"), F.lit(0.0))).alias("m2"), "low", "high")


def state_statistics(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The columns of ``stat_counter`` from states, but for the sum of squares: NaN where there are too few values."""
    nan = F.lit(float("nan"))
    mean = F.col("origin") + F.col("offset")
    variance = F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1))
    return states.select(
        *keys, F.col("n").alias("count"), F.coalesce(mean * F.col("n"), F.lit(0.0)).alias("sum"), F.coalesce(mean, nan).alias("mean"),
        F.coalesce(variance, nan).alias("variance"), F.coalesce(F.sqrt(variance), nan).alias("stdev"),
        F.coalesce(F.sqrt(variance / F.col("n")), nan).alias("stderr"), F.coalesce("low", nan).alias("min"),
        F.coalesce("high", nan).alias("max"))


# -- distinct counts

def distinct_states(df: DataFrame, keys: Sequence[Column], values: dict[str, Column], bits: int = SKETCH_BITS) -> DataFrame:
    """The keys (``_k0``, ``_k1`` ...) with a sketch of the distinct values of each column; a sketch has at most 2^bits bytes or so."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    sketches = [F.hll_sketch_agg(v, bits).alias(n) for n, v in values.items()]
    return df.groupBy(*named).agg(*sketches) if named else df.agg(*sketches)


def merge_distinct(states: DataFrame, names: Sequence[str]) -> DataFrame:
    """One sketch for each key of the given ones."""
    keys = [c for c in states.columns if c not in names]
    merged = [F.hll_union_agg(n).alias(n) for n in names]
    return states.groupBy(*keys).agg(*merged) if keys else states.agg(*merged)


def distinct_estimates(states: DataFrame, names: Sequence[str]) -> DataFrame:
    keys = [c for c in states.columns if c not in names]
    return states.select(*keys, *[F.hll_sketch_estimate(n).alias(n) for n in names])


def sketch_error(bits: int = SKETCH_BITS, deviations: float = 4.0) -> float:
    """Relative error that a sketch of 2^bits cells stays below but for one case in ten thousand or so."""
    return deviations * 1.04 / math.sqrt(1 << bits)
