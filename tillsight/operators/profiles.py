"""Customer profiles: shares of visits (wallets) and of group attributes (pdfs), as one long table.

A profile row is ``(masked_customer_id, family, key, weight)``. The weights of a family sum to one per customer, except
that the business wallet is cut to its largest shares and not rescaled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillsight.functions.scalars import postcode_sector
from tillsight.operators.ranking import top_n
from tillsight.operators.relational import CUSTOMER, count_by
from tillsight.sources.schema import BUCKET_FIELDS

BUSINESS_FAMILY = "business"
KEY_SEPARATOR = "\u0001"


def business_key() -> Column:
    """The two parts of a business key as one text."""
    return F.concat_ws(KEY_SEPARATOR, "business_name", "business_town")


def _shares(counted: DataFrame, keys: list[str]) -> DataFrame:
    # Totals come from the same shuffled counts and are joined, not windowed: a customer with very many keys stays
    # splittable, and small totals are broadcast by their measured size.
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("_total"))
    return counted.join(totals, keys).withColumn("weight", F.col("n") / F.col("_total")).drop("n", "_total")


def wallet(df: DataFrame, key: Column) -> DataFrame:
    """``(masked_customer_id, key, weight)``: the share of the customer's rows that fall on each key."""
    return _shares(count_by(df.select(CUSTOMER, key.alias("key")), [CUSTOMER, "key"]), [CUSTOMER])


def truncate_wallet(shares: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest shares per customer, not rescaled."""
    return top_n(shares, [CUSTOMER], "weight", n, ["key"]).drop("rank")


def wallets(df: DataFrame) -> DataFrame:
    """The four wallets in one pass: rows become (family, key) counts before the only shuffle of the table."""
    entry = lambda family, key: F.struct(F.lit(family).alias("family"), key.alias("key"))
    entries = F.array(
        entry("day", F.col("day_of_week").cast("string")),
        entry("postcode", postcode_sector(F.col("business_postcode"))),
        entry("category", F.col("merchant_category_code")),
        entry(BUSINESS_FAMILY, business_key()),
    )
    rows = df.select(CUSTOMER, F.explode(entries).alias("e")).select(CUSTOMER, "e.family", "e.key")
    counted = count_by(rows.filter(F.col("key").isNotNull()), [CUSTOMER, "family", "key"])
    return _shares(counted, [CUSTOMER, "family"])


def group_pdfs(groups: DataFrame) -> DataFrame:
    """``(group, family, key, weight)``: shares of each attribute value among a group's buckets, nulls left out."""
    def entries_of(field: str) -> Column:
        return F.transform(
            F.col("group"), lambda b: F.struct(F.lit(field).alias("family"), b[field].cast("string").alias("key")))

    entries = F.flatten(F.array(*[entries_of(f) for f in BUCKET_FIELDS]))
    rows = groups.select("group_key", F.explode(entries).alias("e")).select("group_key", "e.family", "e.key")
    counted = count_by(rows.filter(F.col("key").isNotNull()), ["group_key", "family", "key"])
    return _shares(counted, ["group_key", "family"])


def customer_pdfs(df: DataFrame) -> DataFrame:
    """The five pdfs per customer. They are worked out once per distinct group, then handed to its customers."""
    # The count hashes its keys; the minimum, which sorts, then only looks at one row per customer and group. In place of the count a
    # distinct would not do: under a minimum the optimiser leaves it out, and all rows are sorted with their wide groups.
    pairs = count_by(df.select(CUSTOMER, F.col("categorical_group.group").alias("group")), [CUSTOMER, "group"]).filter("n > 0")
    members = pairs.groupBy(CUSTOMER).agg(F.min("group").alias("group"))
    keyed = members.withColumn("group_key", F.md5(F.to_json("group")))
    groups = keyed.select("group_key", "group").distinct()
    return keyed.select(CUSTOMER, "group_key").join(group_pdfs(groups), "group_key").drop("group_key")


def customer_features(df: DataFrame, max_businesses: int = 100) -> DataFrame:
    """All nine families; the business wallet holds the ``max_businesses`` largest shares."""
    shares = wallets(df)
    columns = [CUSTOMER, "family", "key", "weight"]
    businesses = truncate_wallet(shares.filter(F.col("family") == BUSINESS_FAMILY), max_businesses)
    others = shares.filter(F.col("family") != BUSINESS_FAMILY)
    return (
        others.select(*columns)
        .unionByName(businesses.select(*columns))
        .unionByName(customer_pdfs(df).select(*columns))
    )
