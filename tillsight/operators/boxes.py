"""k-anonymous generalisation of the four numerical quasi-identifiers by recursive halving.

A part of the point set is split at the median of the distinct values of one axis, until a side would hold fewer than k
points. Parts above ``local_points`` are split level by level with aggregates over all parts at once; smaller parts are
finished inside one task each, a bounded group per call.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillsight.functions.scalars import exact_sum, round_half_up
from tillsight.operators.anonymise import generalise_categories
from tillsight.operators.ranking import magnitude_bucket, running_offsets
from tillsight.session import cut_lineage, ship_with_tasks
from tillsight.sources.schema import NUMERIC_FIELDS

# Candidate axes in the order that settles equal scores.
AXES = ("age", "balance", "gross_income", "income")
LOCAL_POINTS = 20_000

ship_with_tasks(__name__)


def group_means(customers: DataFrame) -> DataFrame:
    """Rounded means per categorical group; a null adds nothing to the sum but counts as a row."""
    mean = lambda total: round_half_up(total / F.count(F.lit(1)))
    return customers.groupBy("group_id").agg(
        mean(exact_sum(F.col("balance"))).alias("mean_balance"),
        mean(F.sum("age")).alias("mean_age"),
        mean(exact_sum(F.col("income"))).alias("mean_income"))


def impute_numbers(customers: DataFrame) -> DataFrame:
    """The four numbers as rounded longs, nulls replaced by the mean of the group; stops when a group has no mean."""
    failed = lambda field: F.raise_error(F.lit(f"a group has no {field} at all")).cast("bigint")
    filled = lambda field: F.coalesce(round_half_up(F.col(field)), F.col(f"mean_{field}"), failed(field)).alias(field)
    return customers.join(group_means(customers), "group_id").select(
        "customer_id", "group_id", filled("balance"), filled("age"), filled("income"),
        round_half_up(F.col("gross_income")).alias("gross_income"))


def distinct_points(numbers: DataFrame) -> DataFrame:
    return numbers.groupBy("group_id", *NUMERIC_FIELDS).agg(F.count(F.lit(1)).alias("n"))


def _middle(values: np.ndarray) -> int:
    """Median of sorted distinct longs; of two middle ones the mean, cut toward zero."""
    low, high = int(values[(len(values) - 1) // 2]), int(values[len(values) // 2])
    total = low + high
    return low if low == high else total // 2 if total >= 0 else -(-total // 2)


def _halve_locally(points: np.ndarray, part: str, k: int, inner_k: int, balanced: bool) -> list[str]:
    """Leaf name of every point of one bounded part; columns are in the order of ``AXES``."""
    leaves = [""] * len(points)
    open_parts = [(np.arange(len(points)), part)]
    while open_parts:
        rows, name = open_parts.pop()
        here = points[rows]
        lefts = [here[:, a] <= _middle(np.unique(here[:, a])) for a in range(len(AXES))]
        scores = [
            sum(abs(len(np.unique(here[left, a])) - len(np.unique(here[~left, a]))) for a in range(len(AXES)))
            for left in lefts
        ]
        left = lefts[int(np.argmin(scores) if balanced else np.argmax(scores))]
        least = k if name == "" else inner_k
        if left.sum() < least or (~left).sum() < least:
            for row in rows:
                leaves[row] = name
        else:
            open_parts += [(rows[left], name + "0"), (rows[~left], name + "1")]
    return leaves


def _axis_values() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in AXES]))


def _medians(points: DataFrame) -> DataFrame:
    """``(group_id, part, m_<axis>)``: median of the distinct values of each axis, in two levels."""
    part = ["group_id", "part"]
    distinct = (
        points.select(*part, _axis_values().alias("v")).select(*part, "v.axis", "v.value").distinct()
        .withColumn("_bucket", magnitude_bucket(F.col("value")))
    )
    low = F.call_function("div", F.col("_total") - 1, F.lit(2).cast("bigint")) + 1
    high = F.call_function("div", F.col("_total"), F.lit(2).cast("bigint")) + 1
    wanted = running_offsets(distinct, [*part, "axis"], "_bucket", F.lit(1)).withColumn("_next", F.lead(
        "_before", 1).over(Window.partitionBy(*part, "axis").orderBy("_bucket")))
    wanted = wanted.filter((F.col("_before") < high) & (F.coalesce("_next", "_total") >= low)).drop("_next")
    inside = Window.partitionBy(*part, "axis", "_bucket").orderBy("value")
    ranked = distinct.join(wanted, [*part, "axis", "_bucket"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(inside))
    middles = ranked.groupBy(*part, "axis").agg(
        F.max(F.when(F.col("_rank") == low, F.col("value"))).alias("low"),
        F.max(F.when(F.col("_rank") == high, F.col("value"))).alias("high"))
    middle = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
        F.call_function("div", F.col("low") + F.col("high"), F.lit(2).cast("bigint")))
    return middles.withColumn("m", middle).groupBy(*part).agg(
        *[F.max(F.when(F.col("axis") == a, F.col("m"))).alias(f"m_{a}") for a in AXES])


def _split_level(points: DataFrame, k: int, inner_k: int, balanced: bool) -> DataFrame:
    """Every part split once, or marked ``done``."""
    part = ["group_id", "part"]
    sided = points.join(_medians(points), part).select(
        *points.columns, *[(F.col(a) <= F.col(f"m_{a}")).alias(f"l_{a}") for a in AXES])
    sides = [f"l_{a}" for a in AXES]
    # A value counts once for each side of each candidate split on which it occurs.
    seen = sided.select(*part, *sides, _axis_values().alias("v")).groupBy(*part, "v.axis", "v.value").agg(
        *[F.max(s).cast("int").alias(f"a_{s}") for s in sides], *[F.max(~F.col(s)).cast("int").alias(f"b_{s}") for s in sides])
    per_axis = seen.groupBy(*part, "axis").agg(
        *[F.abs(F.sum(f"a_{s}") - F.sum(f"b_{s}")).alias(s) for s in sides])
    scores = per_axis.groupBy(*part).agg(*[F.sum(s).alias(f"s_{s}") for s in sides])
    sizes = sided.groupBy(*part).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(s).cast("int")).alias(f"c_{s}") for s in sides])
    ranked = [
        F.struct((F.col(f"s_{s}") if balanced else -F.col(f"s_{s}")).alias("score"), F.lit(i).alias("i"),
                 F.col(f"c_{s}").alias("left"))
        for i, s in enumerate(sides)
    ]
    best = F.least(*ranked)
    least = F.when(F.col("part") == "", F.lit(k)).otherwise(F.lit(inner_k))
    choice = scores.join(sizes, part).select(
        *part, best["i"].alias("_axis"),
        ((best["left"] < least) | (F.col("rows") - best["left"] < least)).alias("done"))
    left = F.element_at(F.array(*sides), F.col("_axis") + 1)
    name = F.when(F.col("done"), F.col("part")).otherwise(
        F.concat("part", F.when(left, F.lit("0")).otherwise(F.lit("1"))))
    return sided.join(choice, part).select(
        "group_id", name.alias("part"), *NUMERIC_FIELDS, "n", "done")


def halve_points(points: DataFrame, k: int = 10, inner_k: int | None = None, axis_choice: str = "unbalanced",
                 local_points: int = LOCAL_POINTS) -> DataFrame:
    """Points with the ``part`` they end in. ``points`` is ``(group_id, four numbers, n)``, distinct per group.

    The split with the largest difference in distinct values between its sides is taken (``axis_choice="balanced"``
    takes the smallest). ``inner_k`` is the limit below the first split, k if not given; the original has 10 there.
    """
    if axis_choice not in ("unbalanced", "balanced"):
        raise ValueError(f"unknown axis choice {axis_choice!r}")
    inner_k, balanced = k if inner_k is None else inner_k, axis_choice == "balanced"
    columns = ["group_id", "part", *NUMERIC_FIELDS, "n"]
    part_size = F.col("rows") > local_points
    state = cut_lineage(points.withColumn("part", F.lit("")).select(*columns))
    small, finished = None, []
    while True:
        sizes = state.groupBy("group_id", "part").agg(F.count(F.lit(1)).alias("rows"))
        large = sizes.filter(part_size).select("group_id", "part")
        if not large.limit(1).count():
            small = state if small is None else small.unionByName(state)
            break
        rest = state.join(large, ["group_id", "part"], "left_anti").select(*columns)
        small = rest if small is None else small.unionByName(rest)
        level = cut_lineage(_split_level(
            state.join(large, ["group_id", "part"], "left_semi").select(*columns), k, inner_k, balanced))
        finished.append(level.filter("done").select(*columns))
        state = level.filter(~F.col("done")).select(*columns)

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        names = _halve_locally(part[list(AXES)].to_numpy(), part["part"].iloc[0], k, inner_k, balanced)
        return part.assign(part=names)[columns]

    schema = "group_id string, part string, balance long, age long, income long, gross_income long, n long"
    done = small.groupBy("group_id", "part").applyInPandas(finish, schema)
    for table in finished:
        done = done.unionByName(table)
    return done


def boxes_of(points: DataFrame) -> DataFrame:
    """``(group_id, part, numerical_group)``: ranges of the four numbers and the customers inside."""
    covering = [F.struct(F.min(f).alias("start"), F.max(f).alias("end")).alias(f) for f in NUMERIC_FIELDS]
    return points.groupBy("group_id", "part").agg(*covering, F.sum("n").cast("int").alias("group_size")).select(
        "group_id", "part", F.struct(*NUMERIC_FIELDS, "group_size").alias("numerical_group"))


def numeric_boxes(numbers: DataFrame, k: int = 10, **options) -> DataFrame:
    """Boxes of customers given as ``(group_id, four longs)``; groups are generalised apart from each other."""
    return boxes_of(halve_points(distinct_points(numbers), k, **options))


# Cells of an axis have 2^0, 2^4, 2^8 ... values: few widths, so a point is looked up in few ways.
LEVEL_STEP = 4


def _level(width: Column) -> Column:
    """The least of the levels whose cells are as wide as an interval of ``width`` values, so it touches two of them at most."""
    bits = F.length(F.bin(F.greatest(width, F.lit(1)) - 1))
    needed = F.when(width <= 1, F.lit(0)).otherwise(bits)
    return F.least(F.ceil(needed / LEVEL_STEP) * LEVEL_STEP, F.lit(60)).cast("int")


def _prefix(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def place_points(numbers: DataFrame, boxes: DataFrame) -> DataFrame:
    """Customers ``(customer_id, group_id, four longs)`` with ``part`` and ``numerical_group`` of the box that holds their point; both
    are null outside of all boxes. Of boxes that overlap, the first part in order is taken.

    An interval join on four axes: every box is covered by the cells that it touches on each axis, bit prefixes of a length that
    follows its width, so there are 16 cells at most for a box of any size. A point knows its own cell for each
    combination of lengths that its group has; equal cells meet, and the four intervals are tested on what meets.
    """
    start = {a: F.col(f"numerical_group.{a}.start") for a in AXES}
    end = {a: F.col(f"numerical_group.{a}.end") for a in AXES}
    levels = [f"_l{i}" for i in range(len(AXES))]
    cells = [f"_c{i}" for i in range(len(AXES))]
    wide = boxes.select("group_id", "part", "numerical_group", *[
        _level(end[a] - start[a] + 1).alias(level) for a, level in zip(AXES, levels, strict=True)])
    for a, level, cell in zip(AXES, levels, cells, strict=True):
        first, last = _prefix(start[a], F.col(level)), _prefix(end[a], F.col(level))
        wide = wide.withColumn(cell, F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))
    shapes = wide.select("group_id", *levels).distinct()
    looked_up = numbers.select("customer_id", "group_id", *AXES).join(shapes, "group_id").select(
        "customer_id", "group_id", *AXES, *levels,
        *[_prefix(F.col(a), F.col(level)).alias(cell) for a, level, cell in zip(AXES, levels, cells, strict=True)])
    inside = [F.col(a).between(start[a], end[a]) for a in AXES]
    met = looked_up.join(wide, ["group_id", *levels, *cells])
    for condition in inside:
        met = met.filter(condition)
    found = met.groupBy("customer_id", "group_id").agg(F.min(F.struct("part", "numerical_group")).alias("_box")).select(
        "customer_id", "group_id", "_box.*")
    return numbers.join(found, ["customer_id", "group_id"], "left")


def generalise(customers: DataFrame, k1: int = 100, k2: int = 10, categorical_options: dict | None = None,
               **numeric_options) -> DataFrame:
    """``(customer_id, categorical_group, numerical_group)``: categories first, then numbers inside each group.

    The part of a point is carried along, so a customer finds the box by an equi-join on the point; no box is ever
    unfolded into its cells.
    """
    grouped = cut_lineage(generalise_categories(customers, k1, **(categorical_options or {})))
    numbers = cut_lineage(impute_numbers(grouped))
    placed = cut_lineage(halve_points(distinct_points(numbers), k2, **numeric_options))
    point = ["group_id", *NUMERIC_FIELDS]
    return (
        numbers.join(placed.select(*point, "part"), point)
        .join(boxes_of(placed), ["group_id", "part"])
        .join(grouped.select("customer_id", "categorical_group"), "customer_id")
        .select("customer_id", "categorical_group", "numerical_group")
    )
