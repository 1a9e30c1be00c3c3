"""Scalar functions: each takes and returns Columns, so all of them stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# What a missing postcode or gender is called in the output.
NO_POSTCODE = "$NONE_POSTCODE$"
NO_GENDER = "$NONE_GENDER$"


def empty_to_null(text: Column, data_type: str | None = None) -> Column:
    """The text, or null when it is empty; optionally cast."""
    value = F.nullif(text, F.lit(""))
    return value.cast(data_type) if data_type else value


def trimmed_int(text: Column) -> Column:
    return empty_to_null(F.trim(text), "int")


def digits_only_int(text: Column) -> Column:
    """Int when every character is a digit, else null (the empty string included)."""
    return F.when(text.rlike("^[0-9]+$"), text).cast("int")


def flag(value: Column) -> Column:
    return value == F.lit(1)


def match_key(text: Column) -> Column:
    """Merchant match key: trimmed and upper-cased."""
    return F.upper(F.trim(text))


def iso_day_of_week(date: Column) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(date) + F.lit(1)


def drop_right(text: Column, count: int) -> Column:
    return F.substring(text, F.lit(1), F.greatest(F.length(text) - F.lit(count), F.lit(0)))


def postcode_sector(postcode: Column) -> Column:
    return drop_right(postcode, 2)


def postcode_district(postcode: Column) -> Column:
    return F.when(F.length(postcode) > 0, drop_right(postcode, 3)).otherwise(F.lit(NO_POSTCODE))


def business_id(name: Column, town: Column, postcode: Column) -> Column:
    return F.concat_ws("_", name, town, F.coalesce(postcode, F.lit("")))


def set_to_id(values: Column) -> Column:
    """Sorted, comma-joined text of the non-null members of an array."""
    return F.array_join(F.array_sort(F.array_compact(values)), ",")


def first_gender(genders: Column) -> Column:
    return F.coalesce(F.array_min(genders), F.lit(NO_GENDER))


def round_half_up(value: Column) -> Column:
    """Round to long with halves going up: -2.5 becomes -2 (Spark's round gives -3)."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def truncate(value: Column) -> Column:
    return value.cast("bigint")


def exact_sum(value: Column) -> Column:
    """Sum of a money column that does not depend on row order."""
    return F.sum(value.cast("decimal(18,2)")).cast("double")


def epoch_millis_to_timestamp(value: Column) -> Column:
    return F.timestamp_millis(value)


def group_attribute(group: Column, field: str) -> Column:
    """Distinct values of one attribute over the buckets of a categorical group."""
    return F.array_distinct(F.transform(group["group"], lambda bucket: bucket[field]))


def hamming(left: list[Column], right: list[Column]) -> Column:
    """Number of differing attributes; null equals null."""
    return reduce(lambda a, b: a + b, [(~a.eqNullSafe(b)).cast("int") for a, b in zip(left, right)])


def end_gap_distance(left: list[Column], right: list[Column]) -> Column:
    """Euclidean distance of two boxes given as ``{start, end}`` columns; an axis adds its smaller end gap."""
    def gap(a: Column, b: Column) -> Column:
        return F.least(F.abs(a["start"] - b["end"]), F.abs(a["end"] - b["start"])).cast("double")

    return F.sqrt(reduce(lambda a, b: a + b, [gap(a, b) * gap(a, b) for a, b in zip(left, right)]))


def range_union(value: Column) -> Column:
    """Aggregate: smallest range that covers a column of ``{start, end}`` ranges."""
    return F.struct(F.min(value["start"]).alias("start"), F.max(value["end"]).alias("end"))


def dense_dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


# Map helpers -----------------------------------------------------------------------------------------


def map_normalize(values: Column) -> Column:
    """Scale the values of a map to sum to one; with a total of 0 every value becomes null."""
    total = F.aggregate(F.map_values(values), F.lit(0.0), lambda acc, x: acc + x)
    return F.transform_values(values, lambda _, v: F.try_divide(v.cast("double"), total))


def map_dot(left: Column, right: Column) -> Column:
    """Sparse dot product of two maps over their shared keys."""
    products = F.map_zip_with(left, right, lambda _, a, b: F.coalesce(a * b, F.lit(0.0)))
    return F.aggregate(F.map_values(products), F.lit(0.0), lambda acc, x: acc + x)


def map_join(left: Column, right: Column) -> Column:
    """Inner join of two maps on equal keys: key -> {left, right}."""
    shared = F.array_sort(F.array_intersect(F.map_keys(left), F.map_keys(right)))
    return F.map_from_entries(F.transform(
        shared,
        lambda k: F.struct(k, F.struct(F.element_at(left, k).alias("left"), F.element_at(right, k).alias("right"))),
    ))


def map_flat_keys(values: Column, expand) -> Column:
    """Entries of a map with every key replaced by the array ``expand(key)``; returns an array of structs."""
    return F.flatten(F.transform(
        F.map_entries(values),
        lambda e: F.transform(expand(e["key"]), lambda k: F.struct(k.alias("key"), e["value"].alias("value"))),
    ))


def array_product(left: Column, right: Column) -> Column:
    """All pairs of the members of two (small) arrays of one row."""
    return F.flatten(F.transform(
        left, lambda a: F.transform(right, lambda b: F.struct(a.alias("left"), b.alias("right"))),
    ))
