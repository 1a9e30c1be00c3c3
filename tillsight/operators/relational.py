"""Counts, distinct sets, latest rows, roll-ups and filters over the fat table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillsight.operators.ranking import numbered_in_order, top_rows
from tillsight.session import stage_table
from tillsight.sources.schema import BUSINESS_KEY

CUSTOMER = "masked_customer_id"


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` columns per key; pass enough of them to leave no tie."""
    others = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def customer_business_pairs(df: DataFrame) -> DataFrame:
    return df.select(CUSTOMER, *BUSINESS_KEY).distinct()


def multi_map(df: DataFrame, key: str, value: str, name: str = "values") -> DataFrame:
    """Key -> sorted set of its values. For keys whose sets are known to be small; the operators stay with the long
    table instead."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))


def reduce_by_key(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[a.alias(name) for name, a in aggregates.items()])


def popularity(pairs: DataFrame) -> DataFrame:
    """Distinct customers per business."""
    return pairs.groupBy(*BUSINESS_KEY).agg(F.count_distinct(CUSTOMER).alias("customers"))


def popular_businesses(pairs: DataFrame, n: int) -> DataFrame:
    return top_rows(popularity(pairs), "customers", n, BUSINESS_KEY)


def min_visit_pairs(df: DataFrame, min_visits: int) -> DataFrame:
    """Pairs of customer and business with at least ``min_visits`` rows."""
    visits = count_by(df, [CUSTOMER, *BUSINESS_KEY], "visits")
    return visits.filter(F.col("visits") >= min_visits)


def with_numbers(df: DataFrame, wide: str, keys: Sequence[str], *aggregates: Column) -> tuple[DataFrame, DataFrame]:
    """Aggregates per ``keys`` and ``wide`` value, which is replaced by a number ``_place``, and ``(_place, wide)``; numbers
    follow the order of the values.

    For values far wider than the rest of a row, of which there are few. A row carries a hash of its value, and the same pass
    collects the different values, so none goes into a table of the keys. Two values with one hash stop the job.
    """
    # Nulls leave a hash as it is, so places inside the value are told apart by its text.
    hashed = df.withColumn("_hash", F.xxhash64(F.col(wide), F.col(wide).cast("string")))
    both = stage_table(hashed.groupingSets([[*keys, "_hash"], ["_hash", wide]], *keys, "_hash", wide).agg(
        F.grouping(wide).alias("_narrow"), *aggregates))
    values = numbered_in_order(both.filter("_narrow = 0").select("_hash", wide), [F.col(wide), F.col("_hash")], "_place")
    if not values.groupBy("_hash").count().filter("count > 1").isEmpty():
        raise ValueError(f"two values of {wide} have the same hash")
    counted = both.filter("_narrow = 1").drop("_narrow", wide).join(values.select("_hash", "_place"), "_hash").drop("_hash")
    return counted, values.select("_place", wide)


def rollup_parts(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Sums per customer, business and the other attributes, the group as its number; and the groups, if there are any.

    The attributes go into the key of this aggregate, which can so be a hash aggregate with fixed-width buffers;
    only its result, about one row per pair, is reduced by comparing texts and numbers.
    """
    carried = [c for c in ("merchant_category_code", "business_postcode") if c in df.columns]
    sums = [F.sum(F.col("amount").cast("decimal(18,2)")).alias("_sum"), F.count(F.lit(1)).alias("_n")]
    keys = [CUSTOMER, *BUSINESS_KEY, *carried]
    if "categorical_group" not in df.columns:
        return df.groupBy(*keys).agg(*sums), None
    return with_numbers(df.select(*keys, "categorical_group", "amount"), "categorical_group", keys, *sums)


def rollup_of_parts(parts: DataFrame, groups: DataFrame | None) -> DataFrame:
    carried = [c for c in ("_place", "merchant_category_code", "business_postcode") if c in parts.columns]
    rolled = parts.groupBy(CUSTOMER, *BUSINESS_KEY).agg(
        F.sum("_sum").cast("double").alias("amount_sum"), F.sum("_n").cast("int").alias("visits"),
        *[F.min(c).alias(c) for c in carried])
    if groups is not None:
        rolled = rolled.join(groups, "_place")
    order = (CUSTOMER, "categorical_group", "amount_sum", "visits", "merchant_category_code", *BUSINESS_KEY,
             "business_postcode")
    return rolled.select(*[c for c in order if c in rolled.columns])


def customer_business_rollup(df: DataFrame) -> DataFrame:
    """Spend and visits per customer and business; an attribute with several values takes the smallest. The wide group is
    attached last."""
    return rollup_of_parts(*rollup_parts(df))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that keep two tables from being equal as bags; no rows means equal."""
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only_left.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def semi_join(df: DataFrame, keys_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keys_table.select(*keys), list(keys), "left_semi")


def anti_join(df: DataFrame, keys_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keys_table.select(*keys), list(keys), "left_anti")


# A join key with more rows than this, or more joined rows, is spread over several salts.
HOT_ROWS, HOT_RESULT = 100_000, 10_000_000


def salted_join(many: DataFrame, few: DataFrame, key: str, spread: str, hot_rows: int | None = None,
                hot_result: int | None = None) -> DataFrame:
    """Inner equi-join for a key that may hold a large part of ``many`` and has several rows in ``few``.

    A hot key goes to one salt per ``hot_rows`` of its rows or ``hot_result`` of its joined rows (rows of ``many`` times
    rows of ``few``), whichever are more, but not more salts than rows; the salt is chosen by the column ``spread``. Only
    for hot keys the rows of ``few`` are repeated per salt.
    """
    hot_rows, hot_result = hot_rows or HOT_ROWS, hot_result or HOT_RESULT
    n, m = F.col("_n"), F.col("_m")
    salts = F.least(n, F.greatest(F.ceil(n / hot_rows), F.ceil(n.cast("double") * m / hot_result)))
    hot = count_by(many, [key], "_n").join(count_by(few, [key], "_m"), key).select(
        key, salts.cast("int").alias("_salts")).filter("_salts > 1")
    salts = F.coalesce("_salts", F.lit(1))
    salted = many.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    repeated = few.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.drop("_salts").join(repeated.drop("_salts"), [key, "_salt"]).drop("_salt")


def apply_if(df: DataFrame, condition: bool, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return df.transform(step) if condition else df


def tap(df: DataFrame, name: str, *aggregates: Column) -> DataFrame:
    """Attach counters that are filled when the plan runs, without a pass of their own."""
    return df.observe(name, *(aggregates or (F.count(F.lit(1)).alias("rows"),)))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(stage, rows)`` for several stages of a plan."""
    counted = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(stage).alias("stage"), "rows")
               for stage, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def union_all(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
