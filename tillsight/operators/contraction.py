"""Groups of at least k customers by rounds of contraction: every group that is too small joins the nearest one.

1. Each small bucket is a group. In a round, every group below k looks for the nearest other group: two groups are as near as their
   nearest buckets, by the number of fields that differ. A bucket is put under each choice of hidden fields; buckets that
   agree in the others meet there, and the first two group names of such a meeting are enough to give everybody another one.
   So a round costs 31 rows a bucket, and no pairs.
2. Groups toss a coin that depends on name and round only. One that shows tails joins the group it has chosen if that has reached k or
   shows heads: the merges of a round are stars, never chains.
3. A group below k takes in the nearest proposals only until it reaches k. The others ask again in the next round.

The rounds go on until every group has k customers or one is left. Everything is decided by counts and names, so the result does not
depend on the layout of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillsight.session import cut_lineage

# Half of the groups below k join another one in a round or so; this many rounds are never needed.
MAX_ROUNDS = 200


def masked_keys(fields: Sequence[str]) -> Column:
    """One ``{hidden, kept}`` for each choice of at least one field to hide: how many, and the others' values."""
    text = {f: F.coalesce(F.col(f).cast("string"), F.lit("\u0000")) for f in fields}
    keys = []
    for number in range(1, len(fields) + 1):
        for hidden in combinations(range(len(fields)), number):
            kept = [F.lit("\u0001") if i in hidden else text[f] for i, f in enumerate(fields)]
            keys.append(F.struct(F.lit(number).alias("hidden"), F.concat_ws("\u0002", *kept).alias("kept")))
    return F.array(*keys)


def nearest_groups(buckets: DataFrame, sizes: DataFrame, fields: Sequence[str], k: int) -> DataFrame:
    """``(grp, target, away)`` for each group below k: the nearest other group; equal distances go to groups below k, then by name."""
    keyed = buckets.select("grp", F.inline(masked_keys(fields))).distinct()
    known = keyed.join(sizes.select("grp", (F.col("n") >= k).alias("full")), "grp")
    # Of those that meet under one key the first two are enough: whoever is one of them takes the other.
    rank = F.row_number().over(Window.partitionBy("hidden", "kept").orderBy("full", "grp"))
    two = known.withColumn("_r", rank).filter("_r <= 2").groupBy("hidden", "kept").agg(
        F.min(F.when(F.col("_r") == 1, F.struct("full", "grp"))).alias("one"),
        F.min(F.when(F.col("_r") == 2, F.struct("full", "grp"))).alias("two"))
    asking = known.filter(~F.col("full")).select("grp", "hidden", "kept")
    met = asking.join(two, ["hidden", "kept"])
    other = F.when(F.col("one.grp") == F.col("grp"), F.col("two")).otherwise(F.col("one"))
    best = met.select("grp", "hidden", other.alias("o")).filter("o IS NOT NULL").groupBy("grp").agg(
        F.min(F.struct("hidden", F.col("o.full").alias("full"), F.col("o.grp").alias("target"))).alias("b"))
    return best.select("grp", F.col("b.target").alias("target"), F.col("b.hidden").alias("away"))


def heads(group: str, number: int) -> Column:
    """The coin of a group in a round."""
    return F.ascii(F.md5(F.concat(F.lit(f"{number}|"), F.col(group)))) < 56


def contract(small: DataFrame, fields: Sequence[str], k: int) -> DataFrame:
    """``(bucket, grp)`` for the buckets ``(bucket, fields, n)``: groups of at least k customers, if there are so many at all."""
    state = cut_lineage(small.select("bucket", *fields, "n", F.col("bucket").alias("grp")))
    for number in range(MAX_ROUNDS):
        sizes = cut_lineage(state.groupBy("grp").agg(F.sum("n").alias("n")))
        count = sizes.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") < k).alias("open")).first()
        if not count["open"] or count["groups"] <= 1:
            return state.select("bucket", "grp")
        chosen = nearest_groups(state.select("grp", *fields), sizes, fields, k).join(sizes, "grp")
        goal = sizes.select(F.col("grp").alias("target"), F.col("n").alias("size"))
        proposed = chosen.join(goal, "target").filter(~heads("grp", number) & ((F.col("size") >= k) | heads("target", number)))
        before = F.sum("n").over(Window.partitionBy("target").orderBy("away", "grp").rowsBetween(Window.unboundedPreceding, -1))
        taken = proposed.withColumn("_before", F.col("size") + F.coalesce(before, F.lit(0)))
        # A group that has reached k takes in whoever has nowhere else to go.
        joins = cut_lineage(taken.filter((F.col("size") >= k) | (F.col("_before") < k)).select("grp", "target"))
        state = cut_lineage(state.join(joins, "grp", "left").select(
            "bucket", *fields, "n", F.coalesce("target", "grp").alias("grp")))
    raise RuntimeError("groups did not settle")
