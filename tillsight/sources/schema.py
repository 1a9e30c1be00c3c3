"""Fixed schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_CUSTOMER = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("balance", T.DoubleType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("online_active", T.BooleanType(), False),
    T.StructField("income", T.DoubleType()),
    T.StructField("gross_income", T.DoubleType(), False),
    T.StructField("postal_sector", T.StringType()),
    T.StructField("acorn_type_id", T.IntegerType(), False),
    T.StructField("gender", T.StringType(), False),
    T.StructField("marital_status_id", T.IntegerType()),
    T.StructField("occupation_id", T.IntegerType()),
])

RAW_TRANSACTION = T.StructType([
    T.StructField("merchant_name", T.StringType()),
    T.StructField("merchant_town", T.StringType()),
    T.StructField("merchant_country", T.StringType()),
    T.StructField("merchant_category_code", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("date", T.DateType()),
    T.StructField("customer_id", T.LongType()),
])

RAW_BUSINESS = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("merchant_name", "merchant_town", "name", "town", "postcode")
])

# The five quasi-identifiers, in the order the text layout prints them.
BUCKET_FIELDS = ("online_active", "acorn_type_id", "gender", "marital_status_id", "occupation_id")

CATEGORICAL_BUCKET = T.StructType([RAW_CUSTOMER[name] for name in BUCKET_FIELDS])

CATEGORICAL_GROUP = T.StructType([
    T.StructField("group", T.ArrayType(CATEGORICAL_BUCKET)),
    T.StructField("group_size", T.IntegerType()),
])

# The four numerical quasi-identifiers.
NUMERIC_FIELDS = ("balance", "age", "income", "gross_income")

LONG_RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

FAT_COLUMNS = (
    "masked_customer_id", "categorical_group", "amount", "day_of_week",
    "merchant_category_code", "business_name", "business_town", "business_postcode",
)

ROLLUP_COLUMNS = (
    "masked_customer_id", "categorical_group", "amount_sum", "visits",
    "merchant_category_code", "business_name", "business_town", "business_postcode",
)

BUSINESS_KEY = ("business_name", "business_town")
