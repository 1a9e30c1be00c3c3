"""Partitioned reads from a relational source, and typed views of the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillsight.functions.scalars import digits_only_int, flag, trimmed_int
from tillsight.operators.relational import union_all

# Default id bounds and read parallelism of the two raw tables.
CUSTOMER_BOUNDS = (1510072, 9996928884)
CUSTOMER_PARTITIONS = 12
TRANSACTION_BOUNDS = (1517945, 9996927217)
TRANSACTION_PARTITIONS = 20


def jdbc_options(url: str, driver: str, user: str, password: str, table: str, partition_column: str,
                 lower: int, upper: int, partitions: int) -> dict[str, str]:
    """Options of a range-partitioned JDBC read."""
    return {
        "url": url, "driver": driver, "user": user, "password": password, "dbtable": table,
        "partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def load_table(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def raw_customers(source: DataFrame) -> DataFrame:
    """Typed customers with their snapshot date; columns are taken by name, so unused ones are never read."""
    # The column names of the source table.
    c = F.col
    return source.select(
        c("SUMMARY_DATE").cast("date").alias("summary_date"),
        c("CUSTOMER_IDENTIFIER").cast("bigint").alias("customer_id"),
        c("CA_AVG_CLEARED_BALANCE_AMT").cast("double").alias("balance"),
        c("AGE").cast("int").alias("age"),
        flag(c("ONLINE_ACTIVE")).alias("online_active"),
        c("CUSTOMER_INCOME").cast("double").alias("income"),
        c("GROSS_INCOME_AMOUNT").cast("double").alias("gross_income"),
        c("POSTAL_SECTOR").cast("string").alias("postal_sector"),
        c("ACORN_TYPE_ID").cast("int").alias("acorn_type_id"),
        c("SEX_INDICATOR").cast("string").alias("gender"),
        trimmed_int(c("MARITAL_STATUS_CODE")).alias("marital_status_id"),
        digits_only_int(c("OCCUPATION_CODE")).alias("occupation_id"),
    )


def raw_transactions(source: DataFrame) -> DataFrame:
    """Typed transactions; the source's eight columns are customer id, date, merchant number, merchant name,
    merchant town, amount, merchant country and category code, and the merchant number is dropped."""
    customer, date, _, name, town, amount, country, code = source.columns
    return source.select(
        F.col(name).alias("merchant_name"),
        F.col(town).alias("merchant_town"),
        F.col(country).alias("merchant_country"),
        F.col(code).alias("merchant_category_code"),
        F.col(amount).cast("double").alias("amount"),
        F.col(date).cast("date").alias("date"),
        F.col(customer).cast("bigint").alias("customer_id"),
    )


def load_transactions(spark: SparkSession, tables: str, lower: int = TRANSACTION_BOUNDS[0],
                      upper: int = TRANSACTION_BOUNDS[1], partitions: int = TRANSACTION_PARTITIONS,
                      partition_column: str = "CUSTOMER_IDENTIFIER", **connection: str) -> DataFrame:
    """One partitioned scan per name of a comma-separated table list, appended."""
    return union_all(
        raw_transactions(load_table(spark, table=name.strip(), partition_column=partition_column, lower=lower,
                                    upper=upper, partitions=partitions, **connection))
        for name in tables.split(",") if name.strip()
    )


def load_customers(spark: SparkSession, table: str, partition_column: str = "CUSTOMER_IDENTIFIER",
                   **connection: str) -> DataFrame:
    return raw_customers(load_table(
        spark, table=table, partition_column=partition_column, lower=CUSTOMER_BOUNDS[0], upper=CUSTOMER_BOUNDS[1],
        partitions=CUSTOMER_PARTITIONS, **connection))
