"""Filters of the cleaning plan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillsight.operators.relational import CUSTOMER, count_by, semi_join
from tillsight.sources.schema import BUSINESS_KEY

# A record is dropped when its town contains one of these texts, matched with case, inside words too.
BAD_TOWNS = (
    "WESTON", "CREWKERNE", "KINGTON", "BAR", "BARWELL", "BAWDESWELL", "BELCOO", "BRIDGWATER", "BRIMSCOMBE",
    "BRIMSDOWN", "SOMERSET", "SOUTH GLOUCES", "SOUTHEND-ON-S", "STOKE ON TREN", "STOURBRIDGE", "STROUD", "THE MALL",
    "TAUNTON", "THATCHAM", "UK", "WALTON-ON-THA", "WEST REAGROUP", "WESTERN SUPER", "WESTMINSTER", "BRIXTON",
    "BURNHAM", "CAERPHILLY", "CARDIFF", "CHARD", "CHEDGRAVE", "CHIPPENHAM", "WINTERSTOKE", "WOLVERHAMPTON",
    "BRISTOL NAGS", "WSTN SPRMARE", "YEOVIL", "BRISTON", "BRIXTON MORLE", "LEOMINSTER", "LONDON", "MIDHURST",
    "NORTHWICH", "PLYMOUTH", "RADLETT", "RECEPTION", "REDFIELD", "RESTAURANT", "SHERBORNE", "DINGLES", "GATESHEAD",
    "GLASTONBURY", "GLENROTHES", "HACKBRIDGE", "KIDDERMINSTER",
)


def drop_bad_towns(df: DataFrame, towns: Sequence[str] = BAD_TOWNS) -> DataFrame:
    """A chain of ``contains`` on constants; each reaches the scan as a pushed filter."""
    if not towns:
        return df
    bad = reduce(lambda a, b: a | b, [F.col("business_town").contains(t) for t in towns])
    return df.filter(~F.coalesce(bad, F.lit(False)))


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters of a text, none for a shorter one."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))).otherwise(
        F.array().cast("array<string>"))


def listed_towns(towns: DataFrame, literals: DataFrame) -> DataFrame:
    """The different ``business_town`` that contain some ``literal``, for lists of any length; no town meets all literals.

    An inverted index of the literals: each stands under one run of three characters (a shorter one under its whole text), the one
    of its runs that the fewest towns have. A town looks up its own runs; ``contains`` is tested on what meets.
    """
    towns = towns.select("business_town").filter(F.col("business_town").isNotNull()).distinct()
    town = F.col("business_town")
    # An empty literal is in every town.
    every = F.concat(F.array(F.lit("")), *[_grams(town, size) for size in range(1, GRAM + 1)])
    looked_up = towns.select("business_town", F.explode(every).alias("gram"))
    known = looked_up.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    literals = literals.select("literal").filter(F.col("literal").isNotNull()).distinct()
    own = F.when(F.length("literal") < GRAM, F.array("literal")).otherwise(_grams(F.col("literal"), GRAM))
    runs = literals.select("literal", F.explode(own).alias("gram")).join(known, "gram", "left")
    # A literal with a run that no town has is in none.
    index = runs.groupBy("literal").agg(
        F.min_by("gram", "n").alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("possible")).filter("possible").select("gram", "literal")
    return looked_up.join(index, "gram").filter(town.contains(F.col("literal"))).select("business_town").distinct()


def drop_listed_towns(df: DataFrame, literals: DataFrame) -> DataFrame:
    """``drop_bad_towns`` with the list as a table ``(literal)``; a null town stays."""
    return df.join(listed_towns(df, literals), "business_town", "left_anti").select(*df.columns)


def active_customers(df: DataFrame, min_per_customer: int = 5) -> DataFrame:
    """Customers with more than ``min_per_customer`` rows."""
    return count_by(df, [CUSTOMER]).filter(F.col("n") > min_per_customer)


def active_businesses(df: DataFrame, min_per_business: int = 10) -> DataFrame:
    return count_by(df, BUSINESS_KEY).filter(F.col("n") > min_per_business)


def keep_active(df: DataFrame, min_per_business: int = 10, min_per_customer: int = 5) -> DataFrame:
    """Rows of active customers at active businesses. Both counts are taken on the input, once.

    The counts are combined before their shuffle and read two columns at most. The semi-joins are left to the adaptive
    planner: it broadcasts a key set by its measured size, else splits skewed partitions of the rows.
    """
    kept = semi_join(df, active_customers(df, min_per_customer), [CUSTOMER])
    return semi_join(kept, active_businesses(df, min_per_business), BUSINESS_KEY).select(*df.columns)


def with_postcode(df: DataFrame) -> DataFrame:
    return df.filter(F.col("business_postcode").isNotNull())
