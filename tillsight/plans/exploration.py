"""The seventeen exploratory statistics over the fat table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillsight.functions.scalars import (business_id, exact_sum, first_gender, group_attribute, postcode_district,
                                         round_half_up, set_to_id, truncate)
from tillsight.operators import partials
from tillsight.operators.statistics import distribution_of, metric_distribution, per_key_measures
from tillsight.session import cut_lineage, stage_table
from tillsight.sources.delimited import write_statistics


def _business():
    return business_id(F.col("business_name"), F.col("business_town"), F.col("business_postcode"))


def _marital():
    return set_to_id(group_attribute(F.col("categorical_group"), "marital_status_id"))


def _gender():
    return first_gender(group_attribute(F.col("categorical_group"), "gender"))


def _spend():
    return exact_sum(F.col("amount"))


def _mean():
    return exact_sum(F.col("amount")) / F.count(F.lit(1))


def _rows():
    return F.count(F.lit(1))


def _rounded():
    return round_half_up(F.col("measure"))


def _district():
    return postcode_district(F.col("business_postcode"))


# number -> (name, keys, measure, long conversion, points); columns are made when a session exists.
STATISTICS: dict[str, tuple[str, Callable, Callable, Callable | None, int]] = {
    "x01": ("unique customers", lambda: [], lambda: F.count_distinct("masked_customer_id"), None, 101),
    "x02": ("unique merchants", lambda: [], lambda: F.count_distinct(_business()), None, 101),
    "x03": ("transactions per business", lambda: [_business()], _rows, None, 1001),
    "x04": ("transactions per customer", lambda: [F.col("masked_customer_id")], _rows, None, 1001),
    "x05": ("transactions per marital status", lambda: [_marital()], _rows, None, 1001),
    "x06": ("spend per marital status", lambda: [_marital()], _spend, lambda: truncate(F.col("measure")), 1001),
    "x07": ("spend per day of week", lambda: [F.col("day_of_week")], _spend,
            lambda: truncate(F.col("measure")), 1001),
    "x08": ("spend per customer", lambda: [F.col("masked_customer_id")], _spend, _rounded, 1001),
    "x09": ("customers per amount", lambda: [round_half_up(F.col("amount"))],
            lambda: F.count_distinct("masked_customer_id"), None, 1001),
    "x10": ("mean spend per business", lambda: [_business()], _mean, _rounded, 1001),
    "x11": ("mean spend per customer", lambda: [F.col("masked_customer_id")], _mean, _rounded, 1001),
    "x12": ("transactions per district", lambda: [_district()], _rows, None, 1001),
    "x13": ("spend per district", lambda: [_district()], _spend, _rounded, 1001),
    "x14": ("mean spend per district", lambda: [_district()], _mean, _rounded, 1001),
    "x15": ("merchant codes per district", lambda: [_district()],
            lambda: F.count_distinct("merchant_category_code"), None, 1001),
    "x16": ("mean spend per merchant code", lambda: [F.col("merchant_category_code")], _mean, _rounded, 1001),
    "x17": ("mean spend per merchant code and gender", lambda: [F.col("merchant_category_code"), _gender()], _mean,
            _rounded, 1001),
}


def statistic(fat: DataFrame, number: str) -> DataFrame:
    name, keys, measure, to_long, points = STATISTICS[number]
    return metric_distribution(fat, name, keys(), measure(), points, to_long() if to_long else None)


# Statistics with the same keys share a pass over the fat table.
SHARED = (("x03", "x10"), ("x04", "x08", "x11"), ("x05", "x06"), ("x12", "x13", "x14", "x15"))


# Statistics by an attribute of the group.
BY_GROUP = ("x05", "x06", "x17")


def _narrow(fat: DataFrame, groups: Sequence[Sequence[str]]) -> tuple[DataFrame, dict[str, list[Column]]]:
    """The fat table without its group, written once, and the keys of each set of statistics on it. Keys that look at the
    group are worked out before, as the group is far wider than the rest of a row."""
    kept = [c for c in fat.columns if c != "categorical_group"]
    keys, made = {}, []
    for group in groups:
        keys[group[0]] = STATISTICS[group[0]][1]()
        if group[0] in BY_GROUP:
            named = [f"_{group[0]}_{i}" for i in range(len(keys[group[0]]))]
            made += [key.alias(n) for key, n in zip(keys[group[0]], named, strict=True)]
            keys[group[0]] = [F.col(n) for n in named]
    return stage_table(fat.select(*kept, *made)), keys


def explore(fat: DataFrame, numbers: Sequence[str] | None = None) -> DataFrame:
    """All statistics as one long table. The fat table is worked out once; there is one pass over its narrow copy for each set of keys."""
    wanted = list(numbers or STATISTICS)
    together = [[n for n in shared if n in wanted] for shared in SHARED]
    alone = [[n] for n in wanted if not any(n in shared for shared in SHARED)]
    groups = [g for g in together + alone if g]
    narrow, keys = _narrow(fat, groups)
    parts = []
    for group in groups:
        measures = {n: STATISTICS[n][2]() for n in group}
        per_key = cut_lineage(per_key_measures(narrow, keys[group[0]], measures))
        for n in group:
            name, _, _, to_long, points = STATISTICS[n]
            parts.append(distribution_of(per_key, name, n, points, to_long() if to_long else None))
    return reduce(DataFrame.unionByName, parts)


# Distinct counts that can be kept as sketches: statistic -> column that is counted.
SKETCHED: dict[str, Callable] = {
    "x01": lambda: F.col("masked_customer_id"), "x02": _business, "x09": lambda: F.col("masked_customer_id"),
    "x15": lambda: F.col("merchant_category_code")}


def distinct_partials(fat: DataFrame, number: str, bits: int = partials.SKETCH_BITS) -> DataFrame:
    """The sketches of one load of the fat table, a row for each key of the statistic: to be stored."""
    return partials.distinct_states(fat, STATISTICS[number][1](), {"measure": SKETCHED[number]()}, bits)


def distinct_exact(fat: DataFrame, number: str) -> DataFrame:
    """The same keys with the exact count, from the fact rows."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(STATISTICS[number][1]())]
    measure = STATISTICS[number][2]().alias("measure")
    return fat.groupBy(*named).agg(measure) if named else fat.agg(measure)


def distinct_from_partials(stored: Sequence[DataFrame]) -> DataFrame:
    """The statistic's estimated measure for each key, from stored partials of any number of loads; no fact row is read."""
    return partials.distinct_estimates(partials.merge_distinct(reduce(DataFrame.unionByName, stored), ["measure"]), ["measure"])


def exploration_job(fat: DataFrame, output: str, text_output: str | None = None) -> None:
    write_statistics(explore(fat), output, text_output)
