"""k-anonymous generalisation of the five categorical quasi-identifiers, and id masking.

Customers are only counted, joined and grouped by Spark. What is merged is the table of distinct buckets, whose size is
bounded by the attribute domains. Three ways to merge the buckets with fewer than k customers:

* ``rounds``, the default, masks one to four attributes at a time and accepts every group of masked buckets that reaches
  k. It is a chain of DataFrame steps of fixed length, for any number of buckets.
* ``nearest`` lets every group below k join the nearest one, round by round (``contraction``), for any number of buckets; it
  takes several Spark jobs a round, and so many seconds even on a small table.
* ``greedy`` visits the small buckets in a given order and gathers the nearest free ones until k customers are reached.
  It is sequential and its groups depend on the order, so it runs only when asked for, on the driver, and on a bucket
  table of checked size.

They give different groups. Which one runs never depends on the number of buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillsight.functions.scalars import hamming
from tillsight.operators.contraction import contract
from tillsight.operators.ranking import number_rows
from tillsight.session import cut_lineage
from tillsight.sources.schema import BUCKET_FIELDS

MAX_GREEDY_BUCKETS = 50_000
_OPTIONAL_FIELDS = ("marital_status_id", "occupation_id")
_REST = "rest"


def bucket_struct() -> Column:
    return F.struct(*BUCKET_FIELDS)


def bucket_text() -> Column:
    """Printed form of a bucket, with optional values as ``Some(x)`` and ``None``: a null-safe join key, and the order
    in which buckets at one distance are taken."""
    def shown(field: str) -> Column:
        text = F.col(field).cast("string")
        if field not in _OPTIONAL_FIELDS:
            return text
        return F.coalesce(F.concat(F.lit("Some("), text, F.lit(")")), F.lit("None"))

    return F.concat_ws(",", *[shown(f) for f in BUCKET_FIELDS])


def bucket_counts(customers: DataFrame) -> DataFrame:
    """``(bucket, five attributes, n)`` for the distinct buckets."""
    counted = customers.groupBy(*BUCKET_FIELDS).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(bucket_text().alias("bucket"), *BUCKET_FIELDS, "n")


def _gather(buckets: pd.DataFrame, k: int, seed_order: Sequence[str] | None) -> pd.DataFrame:
    """Greedy groups over a bounded bucket table, as ``(bucket, grp)``."""
    buckets = buckets.sort_values("bucket").reset_index(drop=True)
    codes = np.column_stack([pd.factorize(buckets[f], use_na_sentinel=False)[0] for f in BUCKET_FIELDS])
    sizes = buckets["n"].to_numpy()
    group = np.full(len(buckets), -1)
    place = {text: i for i, text in enumerate(buckets["bucket"])}
    seeds = [place[t] for t in seed_order if t in place] if seed_order else []
    seeds += [i for i in range(len(buckets)) if i not in set(seeds)]
    totals: list[int] = []
    for seed in seeds:
        if group[seed] >= 0:
            continue
        free = np.flatnonzero(group < 0)
        away = (codes[free] != codes[seed]).sum(axis=1)
        nearest = free[np.argsort(away, kind="stable")]  # rows are in text order, which settles equal distances
        reached = np.cumsum(sizes[nearest])
        last = min(int(np.searchsorted(reached, k)), len(nearest) - 1)
        group[nearest[:last + 1]] = len(totals)
        totals.append(int(reached[last]))
    if totals and totals[-1] < k:
        if len(totals) == 1:
            raise ValueError(f"these customers cannot be generalised with k = {k}")
        rest = codes[group == len(totals) - 1]
        # Equal distances count once in the sum; it is divided by the number of buckets of the other group.
        cost = [
            np.unique((rest[:, None, :] != codes[group == g][None, :, :]).sum(axis=2)).sum() / (group == g).sum()
            for g in range(len(totals) - 1)
        ]
        group[group == len(totals) - 1] = int(np.argmin(cost))
    return pd.DataFrame({"bucket": buckets["bucket"], "grp": [f"g{g}" for g in group]})


def _merge_in_rounds(small: DataFrame, k: int) -> DataFrame:
    """``(bucket, grp)``; a step masks one choice of attributes and keeps the groups of free buckets that reach k."""
    texts = {f: F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in BUCKET_FIELDS}
    merged = small.withColumn("grp", F.lit(None).cast("string"))
    for masked in range(1, len(BUCKET_FIELDS)):
        for hidden in combinations(range(len(BUCKET_FIELDS)), masked):
            kept = F.concat_ws(",", *[F.lit("*") if i in hidden else texts[f] for i, f in enumerate(BUCKET_FIELDS)])
            free = F.col("grp").isNull()
            reached = F.sum("n").over(Window.partitionBy(kept, free)) >= k
            merged = merged.withColumn("grp", F.when(free & reached, kept).otherwise(F.col("grp")))
        merged = cut_lineage(merged)
    merged = merged.withColumn("grp", F.coalesce("grp", F.lit(_REST)))

    rest, others = merged.filter(F.col("grp") == _REST), merged.filter(F.col("grp") != _REST)
    rest_size = F.coalesce(rest.agg(F.sum("n")).scalar(), F.lit(0))
    # A rest of k customers or more stands as a group. A smaller one has fewer than k buckets: those are compared.
    compared = rest.filter(rest_size < k)
    rest_buckets = compared.agg(F.collect_list(bucket_struct())).scalar()
    own = [F.col(f) for f in BUCKET_FIELDS]
    away = F.array_distinct(F.transform("_rest", lambda b: hamming(own, [b[f] for f in BUCKET_FIELDS])))
    cost = others.withColumn("_rest", rest_buckets).groupBy("grp").agg(
        (F.aggregate(F.array_distinct(F.flatten(F.collect_set(away))), F.lit(0), lambda a, x: a + x)
         / F.count(F.lit(1))).alias("cost"))
    nearest = cost.orderBy("cost", "grp").limit(1).select("grp").scalar()
    return merged.select("bucket", F.when(
        (F.col("grp") == _REST) & (rest_size < k), F.coalesce(nearest, F.lit(_REST))).otherwise(F.col("grp")).alias("grp"))


def categorical_groups(customers: DataFrame, k: int, strategy: str = "rounds", seed_order: Sequence[str] | None = None,
                       max_buckets: int = MAX_GREEDY_BUCKETS) -> DataFrame:
    """``(bucket, group_id, categorical_group)``, one row per distinct bucket; each group has at least k customers.

    A bucket with k customers stands alone. Raises when all small buckets together hold fewer than k customers, and with
    ``greedy`` when there are more than ``max_buckets`` of them.
    """
    counts = cut_lineage(bucket_counts(customers))
    small = counts.filter(F.col("n") < k)
    if strategy == "greedy":
        table = small.limit(max_buckets + 1).toPandas()
        if len(table) > max_buckets:
            raise ValueError(f"more than {max_buckets} small buckets: use strategy='rounds'")
        merged = customers.sparkSession.createDataFrame(_gather(table, k, seed_order), "bucket string, grp string") \
            if len(table) else small.select("bucket", F.lit("").alias("grp"))
    elif strategy == "rounds":
        merged = _merge_in_rounds(small, k)
    elif strategy == "nearest":
        merged = contract(small, BUCKET_FIELDS, k)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    placed = counts.join(merged, "bucket", "left").withColumn("grp", F.coalesce("grp", "bucket"))
    groups = placed.groupBy("grp").agg(
        F.min("bucket").alias("group_id"), F.array_sort(F.collect_list(bucket_struct())).alias("group"),
        F.sum("n").cast("int").alias("group_size"))
    size = F.when(F.col("group_size") >= k, F.col("group_size")).otherwise(
        F.raise_error(F.lit(f"these customers cannot be generalised with k = {k}")).cast("int"))
    groups = groups.select("grp", "group_id", F.struct("group", size.alias("group_size")).alias("categorical_group"))
    return placed.select("bucket", "grp").join(groups, "grp").select("bucket", "group_id", "categorical_group")


def undersized_groups(groups: DataFrame, k: int) -> DataFrame:
    """Groups below k; no rows means the table is k-anonymous."""
    return groups.filter(F.col("categorical_group.group_size") < k)


def group_summary(groups: DataFrame, k: int) -> DataFrame:
    """One row: number of groups, buckets and customers in them, the smallest size, and how many groups are below k."""
    size = F.col("categorical_group.group_size")
    each = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("buckets"), F.first(size).alias("size"))
    return each.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("buckets").alias("buckets"), F.sum("size").alias("customers"),
        F.min("size").alias("smallest"), F.count_if(F.col("size") < k).alias("violations"))


def generalise_categories(customers: DataFrame, k: int, **options) -> DataFrame:
    """Customers with their ``group_id`` and ``categorical_group``."""
    groups = categorical_groups(customers, k, **options)
    return customers.withColumn("bucket", bucket_text()).join(groups, "bucket").drop("bucket")


def mask_ids(df: DataFrame, key: str = "customer_id", salt: str = "1", masked: str = "masked_customer_id") -> DataFrame:
    """``(key, masked)``: arbitrary unique numbers for the distinct ids, the same ones for the same salt."""
    return number_rows(df, [key], salt, masked)

