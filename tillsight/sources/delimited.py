"""Delimited text layout of the fat table, of its roll-up and of the merchant list.

Fields are split by ``sep``, buckets inside the group by ``list_sep``, attributes inside a bucket by ``bucket_sep``.
Null is the empty string. A line with another number of fields stops the job.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillsight.functions.scalars import empty_to_null
from tillsight.sources.schema import BUCKET_FIELDS, RAW_BUSINESS


def _exact_split(text: Column, sep: str, size: int, what: str) -> Column:
    parts = F.split(text, re.escape(sep), -1)
    problem = F.raise_error(F.concat(F.lit(f"expected {size} {what} fields in: "), text))
    return F.when(F.size(parts) == size, parts).otherwise(problem.cast("array<string>"))


def _bucket_text(bucket: Column, sep: str) -> Column:
    fields = [F.coalesce(bucket[name].cast("string"), F.lit("")) for name in BUCKET_FIELDS]
    return F.concat_ws(sep, *fields)


def _bucket_struct(text: Column, sep: str) -> Column:
    parts = _exact_split(text, sep, len(BUCKET_FIELDS), "bucket")
    return F.struct(
        F.when(parts[0].isin("true", "false"), parts[0] == "true").otherwise(
            F.raise_error(F.concat(F.lit("malformed flag: "), parts[0])).cast("boolean")).alias("online_active"),
        parts[1].cast("int").alias("acorn_type_id"),
        parts[2].alias("gender"),
        empty_to_null(parts[3], "int").alias("marital_status_id"),
        empty_to_null(parts[4], "int").alias("occupation_id"),
    )


def _format(df: DataFrame, measures: tuple[str, str], sep: str, list_sep: str, bucket_sep: str) -> DataFrame:
    group = F.array_join(
        F.transform(F.col("categorical_group.group"), lambda b: _bucket_text(b, bucket_sep)), list_sep
    )
    fields = [
        F.col("masked_customer_id"), group, F.col("categorical_group.group_size"),
        *[F.col(m) for m in measures],
        F.col("merchant_category_code"), F.col("business_name"), F.col("business_town"), F.col("business_postcode"),
    ]
    return df.select(F.concat_ws(sep, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]).alias("value"))


def _parse(lines: DataFrame, measures: list[tuple[str, str]], sep: str, list_sep: str, bucket_sep: str) -> DataFrame:
    parts = lines.select(_exact_split(F.col("value"), sep, 9, "record").alias("p"))
    p = F.col("p")
    buckets = F.transform(F.split(p[1], re.escape(list_sep)), lambda b: _bucket_struct(b, bucket_sep))
    return parts.select(
        p[0].cast("bigint").alias("masked_customer_id"),
        F.struct(
            F.array_sort(F.array_distinct(buckets)).alias("group"), p[2].cast("int").alias("group_size")
        ).alias("categorical_group"),
        *[p[3 + i].cast(kind).alias(name) for i, (name, kind) in enumerate(measures)],
        p[5].alias("merchant_category_code"),
        p[6].alias("business_name"),
        p[7].alias("business_town"),
        empty_to_null(p[8]).alias("business_postcode"),
    )


def format_fat(df: DataFrame, sep: str = "\t", list_sep: str = ",", bucket_sep: str = "|") -> DataFrame:
    """Fat table to one ``value`` column of text lines."""
    return _format(df, ("amount", "day_of_week"), sep, list_sep, bucket_sep)


def parse_fat(lines: DataFrame, sep: str = "\t", list_sep: str = ",", bucket_sep: str = "|") -> DataFrame:
    return _parse(lines, [("amount", "double"), ("day_of_week", "int")], sep, list_sep, bucket_sep)


def format_rollup(df: DataFrame, sep: str = "\t", list_sep: str = ",", bucket_sep: str = "|") -> DataFrame:
    return _format(df, ("amount_sum", "visits"), sep, list_sep, bucket_sep)


def parse_rollup(lines: DataFrame, sep: str = "\t", list_sep: str = ",", bucket_sep: str = "|") -> DataFrame:
    return _parse(lines, [("amount_sum", "double"), ("visits", "int")], sep, list_sep, bucket_sep)


def parse_businesses(lines: DataFrame, sep: str = "\t") -> DataFrame:
    parts = lines.select(_exact_split(F.col("value"), sep, len(RAW_BUSINESS), "merchant").alias("p"))
    return parts.select(*[F.col("p")[i].alias(name) for i, name in enumerate(RAW_BUSINESS.names)])


def read_fat(spark: SparkSession, path: str, **seps: str) -> DataFrame:
    return parse_fat(spark.read.text(path), **seps)


def write_fat(df: DataFrame, path: str, **seps: str) -> None:
    format_fat(df, **seps).write.mode("overwrite").text(path)


def read_rollup(spark: SparkSession, path: str, **seps: str) -> DataFrame:
    return parse_rollup(spark.read.text(path), **seps)


def write_rollup(df: DataFrame, path: str, **seps: str) -> None:
    format_rollup(df, **seps).write.mode("overwrite").text(path)


def read_businesses(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return parse_businesses(spark.read.text(path), sep)


def write_statistics(df: DataFrame, path: str, text_path: str | None = None) -> None:
    """Long statistics table as Parquet, and as tab-separated text when a second path is given."""
    df.write.mode("overwrite").parquet(path)
    if text_path:
        df.write.mode("overwrite").csv(text_path, sep="\t", header=True)
