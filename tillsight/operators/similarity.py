"""Similarity of businesses through shared customers, and Hamming range search over buckets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tillsight.functions.scalars import hamming
from tillsight.operators.relational import CUSTOMER
from tillsight.sources.schema import BUSINESS_KEY

Metric = Callable[[Column, Column, Column], Column]

# A customer's items are cut into blocks of about this many, so one row never stands for more than its square in pairs.
BLOCK_ITEMS = 256


def tanimoto(n1: Column, n2: Column, n12: Column) -> Column:
    """Shared customers over all customers of either business."""
    return n12 / (n1 + n2 - n12)


def conditional(n1: Column, n2: Column, n12: Column) -> Column:
    """Share of the candidate's customers that also visit the row's business."""
    return n12 / n2


def item_id() -> Column:
    """A business key as a 60-bit number taken from its digest. It also settles ties, evenly over the businesses."""
    digest = F.md5(F.concat_ws("\u0001", *BUSINESS_KEY))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def with_item_ids(pairs: DataFrame) -> DataFrame:
    """Pairs with their item number; a number that is there already is kept."""
    return pairs if "item" in pairs.columns else pairs.withColumn("item", item_id())


def item_pairs(pairs: DataFrame) -> DataFrame:
    return with_item_ids(pairs).select(CUSTOMER, "item")


def item_dictionary(pairs: DataFrame) -> DataFrame:
    """``(item, business_name, business_town, customers)`` of distinct pairs; two businesses with one number stop the
    job instead of being mixed up."""
    name = F.struct(*BUSINESS_KEY)
    # Names are part of the first key, so all pairs go through a hash aggregate; names are compared on its result.
    counted = with_item_ids(pairs).groupBy("item", *BUSINESS_KEY).agg(F.count(F.lit(1)).alias("customers"))
    grouped = counted.groupBy("item").agg(
        F.min(name).alias("_low"), F.max(name).alias("_high"), F.sum("customers").alias("customers"))
    checked = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(
        F.raise_error(F.lit("two businesses share one number")).cast("struct<business_name:string,business_town:string>"))
    return grouped.select("item", checked.alias("_key"), "customers").select("item", "_key.*", "customers")


def co_occurrence(items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(item, other, n12)`` with item < other: customers shared by two items, for all pairs that share one.

    ``items`` holds distinct ``(masked_customer_id, item)``. The items of a customer are hashed into blocks of about
    ``block_items``; pairs are formed within a block and, for customers with several blocks, between two blocks. A
    customer with very many items is thus spread over many tasks, every pair is formed once, and the counts are
    combined before the shuffle.
    """
    sizes = items.groupBy(CUSTOMER).agg(F.count(F.lit(1)).alias("_m"))
    # At most one row per block_items pairs, so this side is small beside the table.
    wide = sizes.filter(F.col("_m") > block_items).select(
        CUSTOMER, F.ceil(F.col("_m") / block_items).cast("int").alias("_blocks"))
    placed = items.join(wide, CUSTOMER, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn(
        "_block", F.pmod(F.xxhash64("item"), F.col("_blocks")).cast("int"))
    blocks = placed.groupBy(CUSTOMER, "_block", "_blocks").agg(F.array_sort(F.collect_list("item")).alias("_items"))

    within = (
        blocks.select(F.posexplode("_items").alias("_i", "item"), "_items")
        .select("item", F.explode(F.slice("_items", F.col("_i") + 2, F.size("_items"))).alias("other"))
    )
    split = blocks.filter(F.col("_blocks") > 1)
    ahead = split.filter(F.col("_block") < F.col("_blocks") - 1).select(
        CUSTOMER, F.explode(F.sequence(F.col("_block") + 1, F.col("_blocks") - 1)).alias("_block"),
        F.col("_items").alias("_left"))
    between = (
        ahead.join(split.select(CUSTOMER, "_block", "_items"), [CUSTOMER, "_block"])
        .select(F.explode("_left").alias("_a"), "_items")
        .select("_a", F.explode("_items").alias("_b"))
        .select(F.least("_a", "_b").alias("item"), F.greatest("_a", "_b").alias("other"))
    )
    return within.unionByName(between).groupBy("item", "other").agg(F.count(F.lit(1)).alias("n12"))


def item_similarity(pairs: DataFrame, metric: Metric, dictionary: DataFrame | None = None) -> DataFrame:
    """``(item, other, score)`` in both directions for businesses with a shared customer."""
    return scored_both_ways(shared_customers(pairs, dictionary), metric)


def shared_customers(pairs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``(item, other, n12, n1, n2)`` with item < other: shared customers, and those of each; any metric follows from them."""
    counts = (dictionary if dictionary is not None else item_dictionary(pairs)).select("item", "customers")
    return (
        co_occurrence(item_pairs(pairs))
        .join(counts.withColumnRenamed("customers", "n1"), "item")
        .join(counts.select(F.col("item").alias("other"), F.col("customers").alias("n2")), "other")
    )


def scored_both_ways(half: DataFrame, metric: Metric) -> DataFrame:
    n1, n2, n12 = F.col("n1"), F.col("n2"), F.col("n12")
    both = F.array(
        F.struct(F.col("item").alias("item"), F.col("other").alias("other"), metric(n1, n2, n12).alias("score")),
        F.struct(F.col("other").alias("item"), F.col("item").alias("other"), metric(n2, n1, n12).alias("score")),
    )
    return half.select(F.explode(both).alias("r")).select("r.item", "r.other", "r.score")


def item_matrix(pairs: DataFrame, metric: Metric) -> DataFrame:
    """The similarity table with business names on both sides."""
    names = item_dictionary(pairs).select("item", *BUSINESS_KEY)
    similar = names.select(
        F.col("item").alias("other"), F.col("business_name").alias("similar_name"),
        F.col("business_town").alias("similar_town"))
    return (
        item_similarity(pairs, metric).join(names, "item").join(similar, "other")
        .select(*BUSINESS_KEY, "similar_name", "similar_town", "score")
    )


def row_normalised(matrix: DataFrame) -> DataFrame:
    """Scores divided by the sum of their row."""
    sums = matrix.groupBy("item").agg(F.sum("score").alias("_sum"))
    return matrix.join(sums, "item").select("item", "other", (F.col("score") / F.col("_sum")).alias("score"))


ALL_PAIRS_SALTS = 64


def hamming_range_pairs(df: DataFrame, fields: Sequence[str], key: str, radius: int) -> DataFrame:
    """``(key, other, distance)`` for all ordered pairs of rows that differ in at most ``radius`` fields, each row
    paired with itself too. A radius of all fields asks for all pairs; take it for small bucket tables only.

    Two rows lie within the radius just when they agree after ``radius`` well-chosen fields are masked, so the search
    is an equi-join on (mask, remaining values). A pair that meets under several masks is kept under the first one
    that covers its differing fields, which needs no distinct.
    """
    fields = list(fields)
    if not 0 <= radius <= len(fields):
        raise ValueError(f"radius must be between 0 and {len(fields)}")
    if radius == len(fields):
        # Every pair qualifies: the result is all pairs, and one side is dealt over salts.
        mine = df.select(key, *fields).withColumn("_s", F.pmod(F.xxhash64(key), F.lit(ALL_PAIRS_SALTS)))
        theirs = df.select(F.col(key).alias("other"), *[F.col(f).alias(f"o_{f}") for f in fields]).withColumn(
            "_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ALL_PAIRS_SALTS - 1).cast("bigint"))))
        distance = hamming([F.col(f) for f in fields], [F.col(f"o_{f}") for f in fields])
        return mine.join(theirs, "_s").select(key, "other", distance.alias("distance"))
    masks = [sum(1 << i for i in chosen) for chosen in combinations(range(len(fields)), radius)]
    first_cover = [next((m for m in masks if bits & ~m == 0), -1) for bits in range(1 << len(fields))]

    def masked(mask: int) -> Column:
        kept = [F.coalesce(F.col(f).cast("string"), F.lit("\u0000")) for i, f in enumerate(fields) if not mask >> i & 1]
        return F.struct(F.lit(mask).alias("mask"), F.concat_ws("\u0001", *kept).alias("rest"))

    exploded = df.select(key, *fields, F.explode(F.array(*[masked(m) for m in masks])).alias("_m")).select(
        key, *fields, "_m.*")
    other = exploded.select("mask", "rest", F.col(key).alias("other"), *[F.col(f).alias(f"o_{f}") for f in fields])
    mine, theirs = [F.col(f) for f in fields], [F.col(f"o_{f}") for f in fields]
    bits = sum(((~a.eqNullSafe(b)).cast("int") * (1 << i) for i, (a, b) in enumerate(zip(mine, theirs))), F.lit(0))
    cover = F.element_at(F.array(*[F.lit(m) for m in first_cover]), bits + 1)
    return exploded.join(other, ["mask", "rest"]).filter(F.col("mask") == cover).select(
        key, "other", hamming(mine, theirs).alias("distance"))
