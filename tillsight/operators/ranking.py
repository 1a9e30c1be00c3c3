"""Sorts, limits, top-n, arg-max, exact order statistics and dense numbering.

Nothing here ranks a whole table in one task. Global ranks are taken in two levels: rows are put into ordered buckets
by a pure function of the sort key, the bucket counts (a table of proven size) are summed up in order, and rows are
ranked inside their bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillsight.session import cut_lineage, stage_table

SCORE_DIGITS = 9


def stable_score(score: Column) -> Column:
    """Score used for ordering: sums taken in another order must not change a rank."""
    return F.round(score, SCORE_DIGITS)


def top_n(df: DataFrame, keys: Sequence[str], score: Column | str, n: int, ties: Sequence[str],
          rank: str = "rank") -> DataFrame:
    """Best ``n`` rows per key, ranked from 1; equal scores go by ``ties`` ascending.

    The limit is applied before the shuffle as well, so a hot key sends at most ``n`` rows per task.
    """
    score = F.col(score) if isinstance(score, str) else score
    window = Window.partitionBy(*keys).orderBy(stable_score(score).desc(), *[F.col(t).asc() for t in ties])
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def top_rows(df: DataFrame, score: Column | str, n: int, ties: Sequence[str]) -> DataFrame:
    """Best ``n`` rows of the table, in order."""
    score = F.col(score) if isinstance(score, str) else score
    return df.orderBy(score.desc(), *[F.col(t).asc() for t in ties]).limit(n)


def _extreme_rows(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    ranked = df.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.filter(F.col("_r") == 1).drop("_r")


def max_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows that reach the maximum of ``value`` within their key; with no keys, within the table."""
    if not keys:
        return df.filter(F.col(value) == df.agg(F.max(value)).scalar())
    return _extreme_rows(df.filter(F.col(value).isNotNull()), keys, F.col(value).desc())


def min_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    if not keys:
        return df.filter(F.col(value) == df.agg(F.min(value)).scalar())
    return _extreme_rows(df.filter(F.col(value).isNotNull()), keys, F.col(value).asc())


def arg_max(df: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """One item per key with the largest value; the smallest item wins a tie."""
    best = F.max(F.col(value)).alias(value)
    # max_by would leave ties open, so the tie is settled on the rows that reach the maximum.
    return max_rows(df, keys, value).groupBy(*keys).agg(F.min(item).alias(item), best)


def arg_min(df: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    best = F.min(F.col(value)).alias(value)
    return min_rows(df, keys, value).groupBy(*keys).agg(F.min(item).alias(item), best)


# Two-level global ranks ------------------------------------------------------------------------------


def magnitude_bucket(value: Column) -> Column:
    """Ordered bucket of a long: its bit length and its next seven bits.

    Monotone in the value, at most about 16,600 different results, and never wider than 1/128 of the value, so heavy
    tails spread over many buckets.
    """
    def positive(v: Column) -> Column:
        bits = F.length(F.bin(v))
        next_bits = F.call_function("shiftright", v, bits - 8).bitwiseAND(127)
        return F.when(v < 128, v.cast("int")).otherwise((bits * 128 + next_bits).cast("int"))

    value = value.cast("bigint")
    return F.when(value >= 0, positive(value)).otherwise(F.lit(-1) - positive(F.bitwise_not(value)))


def running_offsets(df: DataFrame, keys: Sequence[str], bucket: str, weight: Column) -> DataFrame:
    """Rows before each bucket and rows in all; the caller's bucket function bounds the rows per key."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("_in"))
    ordered = Window.partitionBy(*keys).orderBy(bucket)
    return totals.select(
        *keys, bucket,
        (F.sum("_in").over(ordered) - F.col("_in")).alias("_before"),
        F.sum("_in").over(Window.partitionBy(*keys)).alias("_total"),
    )


def value_histogram(df: DataFrame, value: str) -> DataFrame:
    """Distinct values and ``_n``, how often each occurs."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))


def cumulative_histogram(histogram: DataFrame, value: str, to_bucket: Callable[[Column], Column] = magnitude_bucket) -> DataFrame:
    """The distinct values of a histogram with ``_low`` (rows below), ``_high`` (rows up to and including) and ``_total``."""
    histogram = histogram.withColumn("_bucket", to_bucket(F.col(value)))
    # One row per bucket, and the bucket function has a fixed number of results.
    offsets = F.broadcast(running_offsets(histogram, [], "_bucket", F.col("_n")))
    inside = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    high = F.col("_before") + F.sum("_n").over(inside)
    return (
        histogram.join(offsets, "_bucket")
        .select(value, "_n", high.alias("_high"), "_total")
        .select(value, (F.col("_high") - F.col("_n")).alias("_low"), "_high", "_total")
    )


def nearest_rank(points: int) -> Callable[[Column, Column], Column]:
    """Rank (from 1) of point i of ``points``: the nearest rank at fraction i / (points - 1)."""
    if points == 1:
        return lambda i, total: F.lit(1).cast("bigint")
    steps = F.lit(points - 1).cast("bigint")
    return lambda i, total: F.greatest(
        F.lit(1).cast("bigint"), F.call_function("div", i * total + steps - 1, steps))


def bin_rank(bins: int) -> Callable[[Column, Column], Column]:
    """Rank (from 1) of bin i of ``bins``: one more than floor(i * rows / bins)."""
    return lambda i, total: F.floor(i.cast("double") * (total.cast("double") / F.lit(float(bins)))).cast("bigint") + 1


def order_statistics(df: DataFrame, value: str, points: int, rank_of: Callable[[Column, Column], Column],
                     to_bucket: Callable[[Column], Column] = magnitude_bucket) -> DataFrame:
    """``(point, value)`` for points 0 ... points - 1, exact, without sorting the table in one task."""
    return histogram_statistics(value_histogram(df, value), value, points, rank_of, to_bucket)


def histogram_statistics(histogram: DataFrame, value: str, points: int, rank_of: Callable[[Column, Column], Column],
                         to_bucket: Callable[[Column], Column] = magnitude_bucket) -> DataFrame:
    """The same from a histogram ``(value, _n)``."""
    ranges = cumulative_histogram(histogram, value, to_bucket)
    step = F.col("_total").cast("double") / F.lit(float(max(points - 1, 1)))
    last = F.lit(points - 1).cast("bigint")
    # The points that can fall into (_low, _high], with room for both rank rules; the exact test follows.
    first = F.greatest(F.floor(F.col("_low") / step * F.lit(0.999)) - 2, F.lit(0)).cast("bigint")
    final = F.least(F.ceil(F.col("_high") / step * F.lit(1.002)) + 2, last).cast("bigint")
    rank = rank_of(F.col("point"), F.col("_total"))
    return (
        ranges.filter(first <= final)
        .select(value, "_low", "_high", "_total", F.explode(F.sequence(first, final)).alias("point"))
        .filter((rank > F.col("_low")) & (rank <= F.col("_high")))
        .select(F.col("point").cast("int").alias("point"), F.col(value).alias("value"))
    )


MAX_BUCKETS = 4096


def even_bucket(df: DataFrame, value: str, distinct: bool = False) -> Callable[[Column], Column]:
    """Ordered buckets of a double with about equal numbers of distinct values, however they are spread.

    At most ``MAX_BUCKETS`` bounds are collected; one bucket for each 20,000 distinct values or so. NaN is the largest
    value, as in Spark's own order, and lies in the last bucket. ``distinct`` says that no value occurs twice.
    """
    values = df.select(value).filter(F.col(value).isNotNull() & ~F.isnan(value))
    values = values if distinct else values.distinct()
    rows = values.count()
    buckets = max(1, min(MAX_BUCKETS, rows // 20_000))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(values.agg(F.percentile_approx(value, shares, 10 * MAX_BUCKETS)).first()[0])) if shares else []
    if not bounds:
        return lambda v: F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    tiers = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(t[0]) for t in tiers])
    inner = F.array(*[F.array(*[F.lit(b) for b in t]) for t in tiers])

    def bucket(v: Column) -> Column:
        upto = lambda values: F.size(F.filter(values, lambda bound: bound <= v))
        tier = upto(heads)
        return F.when(tier == 0, F.lit(0)).otherwise((tier - 1) * width + upto(F.element_at(inner, F.greatest(tier, F.lit(1)))))

    return bucket


def _double_histogram(df: DataFrame, value: str) -> DataFrame:
    """Written once: the number of values, the bounds of the buckets and the ranks are all taken from it."""
    return stage_table(value_histogram(df.select(F.col(value).cast("double").alias(value)), value))


def percentile_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Value at index floor(i * rows / bins) of the sorted values, i = 0 ... bins - 1."""
    histogram = _double_histogram(df, value)
    return histogram_statistics(histogram, value, bins, bin_rank(bins), even_bucket(histogram, value, distinct=True))


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row: the middle value, or the mean of the two middle values."""
    histogram = _double_histogram(df, value)
    ranges = cumulative_histogram(histogram, value, even_bucket(histogram, value, distinct=True))
    low = F.call_function("div", F.col("_total") - 1, F.lit(2).cast("bigint")) + 1
    high = F.call_function("div", F.col("_total"), F.lit(2).cast("bigint")) + 1
    holds = lambda rank: (F.col("_low") < rank) & (rank <= F.col("_high"))
    return ranges.agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias("median")
    )


def numbered_in_order(df: DataFrame, order: Sequence[Column], place: str = "place") -> DataFrame:
    """The rows with their ``place`` (from 0) in the order, which must leave no ties.

    Rows are dealt in ranges and sorted inside them; a row's place is the rows of earlier ranges and its number in its own. The
    numbered rows are written, so that both uses of them see the same ranges.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_range", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    # A row for each range.
    before = at.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).select("_range", "_before")
    return at.join(F.broadcast(before), "_range").withColumn(place, F.col("_before") + F.col("_in")).select(*df.columns, place)


def number_rows(df: DataFrame, keys: Sequence[str], salt: str, number: str = "number") -> DataFrame:
    """Dense numbers from 0 for distinct keys, in the order of ``md5(salt ‖ key)``: arbitrary but reproducible.

    The digest spreads the keys evenly over 65,536 buckets, so no bucket is hot.
    """
    text = F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in keys])
    hashed = df.select(*keys).distinct().withColumn("_h", F.md5(text)).withColumn("_bucket", F.substring("_h", 1, 4))
    offsets = F.broadcast(running_offsets(hashed, [], "_bucket", F.lit(1)))
    inside = Window.partitionBy("_bucket").orderBy("_h", *keys)
    return hashed.join(offsets, "_bucket").select(
        *keys, (F.col("_before") + F.row_number().over(inside) - 1).cast("bigint").alias(number)
    )
