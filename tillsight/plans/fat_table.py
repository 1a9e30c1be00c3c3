"""From raw transactions, customers and merchants to the anonymised fat table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillsight.functions.scalars import iso_day_of_week, match_key
from tillsight.operators.anonymise import bucket_text, categorical_groups, mask_ids
from tillsight.operators.relational import latest_by
from tillsight.session import cut_lineage, stage_table
from tillsight.sources import jdbc
from tillsight.sources.delimited import read_businesses, write_fat
from tillsight.sources.schema import FAT_COLUMNS, RAW_CUSTOMER


def latest_customers(snapshots: DataFrame) -> DataFrame:
    """One row per customer, from the latest ``summary_date``; the other columns settle equal dates."""
    order = ["summary_date", *[c for c in RAW_CUSTOMER.names if c != "customer_id"]]
    return latest_by(snapshots, ["customer_id"], order).drop("summary_date")


def join_customers(transactions: DataFrame, groups: DataFrame, masks: DataFrame) -> DataFrame:
    """Transactions with the customer's masked id and what ``groups`` has of the customer; unknown customers drop out.

    The two customer tables are joined with each other first, so the transactions are shuffled by customer once.
    """
    known = groups.join(masks, "customer_id")
    return transactions.join(known, "customer_id")


def join_merchants(transactions: DataFrame, merchants: DataFrame, normalise_merchants: bool = False) -> DataFrame:
    """Clean merchant name, town and postcode where the match key is known, else the match key itself.

    Keys of the transactions are trimmed and upper-cased, those of the merchants only with ``normalise_merchants``.
    A merchant key that occurs twice doubles its transactions.
    """
    keyed = transactions.withColumn("merchant_name", match_key(F.col("merchant_name"))).withColumn(
        "merchant_town", match_key(F.col("merchant_town")))
    if normalise_merchants:
        merchants = merchants.withColumn("merchant_name", match_key(F.col("merchant_name"))).withColumn(
            "merchant_town", match_key(F.col("merchant_town")))
    joined = keyed.join(merchants, ["merchant_name", "merchant_town"], "left")
    return joined.select(
        *[c for c in transactions.columns if c not in ("merchant_name", "merchant_town")],
        F.coalesce("name", "merchant_name").alias("business_name"),
        F.coalesce("town", "merchant_town").alias("business_town"),
        F.col("postcode").alias("business_postcode"))


def fat_table(transactions: DataFrame, customers: DataFrame, merchants: DataFrame, k: int = 10, salt: str = "1",
              normalise_merchants: bool = False, **group_options) -> DataFrame:
    """The anonymised fat table. Country, raw id, numbers and the date of the inputs are left behind.

    A transaction carries its group's id through the joins; the group's array of buckets is attached last.
    """
    placed = cut_lineage(categorical_groups(customers, k, **group_options))
    groups = customers.withColumn("bucket", bucket_text()).join(placed.select("bucket", "group_id"), "bucket").select(
        "customer_id", "group_id")
    masks = mask_ids(transactions, "customer_id", salt)
    joined = join_merchants(join_customers(transactions, groups, masks), merchants, normalise_merchants)
    joined = joined.join(placed.select("group_id", "categorical_group").dropDuplicates(["group_id"]), "group_id")
    return joined.withColumn("day_of_week", iso_day_of_week(F.col("date"))).select(*FAT_COLUMNS)


def fat_table_job(transactions: DataFrame, snapshots: DataFrame, merchants: DataFrame, output: str, k: int = 10,
                  sep: str = "\t", **options) -> None:
    """Latest customers, generalisation, joins, and the text output. Transactions and customers are staged first: the plan reads
    them several times, and a live source might change in between."""
    transactions, customers = stage_table(transactions), stage_table(latest_customers(snapshots))
    write_fat(fat_table(transactions, customers, merchants, k, **options), output, sep=sep)


def database_job(spark: SparkSession, transaction_tables: str, customer_table: str, merchants_path: str, output: str,
                 min_customer_id: int = jdbc.TRANSACTION_BOUNDS[0], max_customer_id: int = jdbc.TRANSACTION_BOUNDS[1],
                 k: int = 10, sep: str = "\t", options: dict | None = None, **connection: str) -> None:
    """The same from a database: a comma-separated list of transaction tables, a customer table, and a merchant file.
    ``connection`` holds url, driver, user and password."""
    transactions = jdbc.load_transactions(spark, transaction_tables, min_customer_id, max_customer_id, **connection)
    snapshots = jdbc.load_customers(spark, customer_table, **connection)
    fat_table_job(transactions, snapshots, read_businesses(spark, merchants_path, sep), output, k, sep, **(options or {}))
