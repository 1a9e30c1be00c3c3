"""Views of the star-schema and event tables as the data model: raw tables and fat tables.

The event table gives repeat visits to a small set of businesses, the order tables give wide spending histories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tillsight.functions.scalars import exact_sum, iso_day_of_week, round_half_up
from tillsight.operators.anonymise import bucket_struct
from tillsight.sources.schema import FAT_COLUMNS, RAW_CUSTOMER


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its footer is asked for the schema once per process, not once per plan."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _quasi_identifiers() -> list[Column]:
    key = F.col("c_custkey")
    return [
        (F.col("c_acctbal") >= 0).alias("online_active"),
        F.col("n_regionkey").cast("int").alias("acorn_type_id"),
        F.col("c_mktsegment").alias("gender"),
        F.when(key % 2 != 0, F.lit(1)).cast("int").alias("marital_status_id"),
        F.when(key % 10 == 0, F.lit(4)).cast("int").alias("occupation_id"),
    ]


def _customers_and_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their quasi-identifiers; income is the sum of their orders."""
    income = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(exact_sum(F.col("o_totalprice")).alias("income"))
    key = F.col("c_custkey")
    joined = _customers_and_nations(spark, sf_dir).join(income, key == F.col("o_custkey"), "left")
    return joined.select(
        key.alias("customer_id"),
        F.when(key % 11 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(key % 13 != 0, 18 + key % 60).cast("int").alias("age"),
        "income",
        round_half_up(F.col("c_acctbal")).cast("double").alias("gross_income"),
        F.concat(F.lit("S"), (key % 50).cast("string")).alias("postal_sector"),
        *_quasi_identifiers(),
    ).select(*RAW_CUSTOMER.names)


def customer_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(customer_id, five categorical attributes)`` without the numbers, so the orders are not read."""
    return _customers_and_nations(spark, sf_dir).select(F.col("c_custkey").alias("customer_id"), *_quasi_identifiers())


def _groups_of_regions(customers: DataFrame) -> DataFrame:
    """``(acorn_type_id, online_active, categorical_group)``: a group holds the distinct buckets of one region and online flag."""
    return customers.groupBy("acorn_type_id", "online_active").agg(
        F.struct(
            F.array_sort(F.collect_set(bucket_struct())).alias("group"),
            F.count(F.lit(1)).cast("int").alias("group_size"),
        ).alias("categorical_group"))


def region_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(customer_id, categorical_group)``: the group of each customer's region and online flag."""
    customers = customer_buckets(spark, sf_dir)
    return customers.join(_groups_of_regions(customers), ["acorn_type_id", "online_active"]).select("customer_id", "categorical_group")


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int")
    events = table(spark, sf_dir, "events").withColumn("k", k)
    text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    return events.select(
        F.col("user_id").alias("masked_customer_id"),
        F.col("value").alias("amount"),
        iso_day_of_week(F.col("ts")).alias("day_of_week"),
        F.col("event_type").alias("merchant_category_code"),
        text("B", F.col("k")).alias("business_name"),
        text("T", F.col("k") % 10).alias("business_town"),
        F.when(F.col("k") % 7 != 0, F.concat(text("P", F.col("k") % 20), F.lit(" 1AB"))).alias("business_postcode"),
    )


def _with_groups(transactions: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide group is attached last, from a table of two rows per region; only region and flag go through the joins."""
    customers = customer_buckets(spark, sf_dir)
    regions = customers.select(F.col("customer_id").alias("masked_customer_id"), "acorn_type_id", "online_active")
    return transactions.join(regions, "masked_customer_id").join(
        F.broadcast(_groups_of_regions(customers)), ["acorn_type_id", "online_active"]).select(*FAT_COLUMNS)


def event_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fat table without its group column: the rows that have a customer."""
    return event_fat(spark, sf_dir).drop("categorical_group")


def event_fat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_groups(event_transactions(spark, sf_dir), spark, sf_dir)


def order_raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transactions: a line item is a purchase of a brand from a supplier's nation."""
    read = lambda name: table(spark, sf_dir, name)
    towns = (
        read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        read("lineitem")
        .join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(towns, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("p_brand").alias("merchant_name"),
            F.col("n_name").alias("merchant_town"),
            F.col("r_name").alias("merchant_country"),
            F.col("p_type").alias("merchant_category_code"),
            F.col("l_extendedprice").alias("amount"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_custkey").alias("customer_id"),
        )
    )


def order_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean merchant names of every brand and nation outside Asia."""
    read = lambda name: table(spark, sf_dir, name)
    nations = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).filter(
        F.col("r_name") != "ASIA")
    sellers = read("lineitem").select("l_partkey", "l_suppkey").join(
        read("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(
        read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        "p_brand", "s_nationkey").distinct()
    return sellers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.upper("p_brand").alias("merchant_name"),
        F.upper("n_name").alias("merchant_town"),
        F.concat(F.lit("Shop "), F.col("p_brand")).alias("name"),
        F.initcap("n_name").alias("town"),
        F.concat(F.substring("n_name", 1, 2), F.col("n_nationkey").cast("string"), F.lit(" 9XY")).alias("postcode"),
    )


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of the order tables under the fat table's names, without the group and without a merchant list; the
    postcode comes from the town."""
    town: Column = F.col("merchant_town")
    return order_raw_transactions(spark, sf_dir).select(
        F.col("customer_id").alias("masked_customer_id"),
        "amount",
        iso_day_of_week(F.col("date")).alias("day_of_week"),
        "merchant_category_code",
        F.col("merchant_name").alias("business_name"),
        town.alias("business_town"),
        F.when(F.col("merchant_country") != "ASIA",
               F.concat(F.substring(town, 1, 3), F.lit(" 9XY"))).alias("business_postcode"),
    )


def order_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fat table without its group column: the rows that have a customer."""
    return order_fat(spark, sf_dir).drop("categorical_group")


def order_fat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_groups(order_transactions(spark, sf_dir), spark, sf_dir)
