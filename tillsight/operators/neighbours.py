"""Nearest customers by profile cosine: an exact k-nearest-neighbour join.

Larger tables are searched by lists of sparse keys and cells of dense parts (``nearest_exact``). The join with pivots alone:
profiles are scaled to unit length, where the chord length sqrt(2 - 2 cos) is a metric. It follows the published
pivot scheme for k-nearest-neighbour joins on clusters (Voronoi cells around sampled pivots, triangle-inequality bounds):

1. Customers with one and the same profile are folded into one representative, so copies cost nothing; a fold keeps the
   few smallest customer ids that can ever be an answer.
2. Representatives go to the cell of their nearest pivot.
3. Each one is compared with its nearest cells, enough of them to find k candidates. That gives its search radius.
4. It is then compared with every other cell that the bounds cannot rule out.

Cells are compared in bounded blocks of left and right rows, so a crowded cell is many tasks. Only pivots and one row
of statistics per cell come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tillsight.operators.nearest_exact import exact_lists
from tillsight.operators.profile_blocks import BLOCK_ROWS, Block, ProfileSearch, best_found, block_search
from tillsight.operators.profiles import BUSINESS_FAMILY
from tillsight.operators.ranking import top_n
from tillsight.operators.relational import CUSTOMER, salted_join
from tillsight.session import cut_lineage, ship_with_tasks, stage_table

MAX_PIVOTS = 2048
# Below this many candidates one cell is searched whole and no pivot is drawn.
ONE_CELL_ROWS = 4096
# Room for rounding in the bounds: similarities are ranked at nine digits.
SLACK = 1e-8

ship_with_tasks(__name__)


def unit_profiles(features: DataFrame, min_businesses: int) -> DataFrame:
    """One row per customer: sorted 64-bit feature hashes, unit-length weights, and whether it may be a neighbour."""
    entry = F.struct(F.xxhash64("family", "key").alias("f"), F.col("weight").alias("w"))
    businesses = F.sum((F.col("family") == BUSINESS_FAMILY).cast("int"))
    grouped = features.groupBy(CUSTOMER).agg(
        F.array_sort(F.collect_list(entry)).alias("e"), (businesses > min_businesses).alias("eligible"))
    # The sum of squares is handed to the division as a value: a column of its own would be worked out anew for each entry.
    weights = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"], lambda acc: F.transform("e", lambda x: x["w"] / F.sqrt(acc)))
    return (
        grouped.select(CUSTOMER, "eligible", F.transform("e", lambda x: x["f"]).alias("features"), weights.alias("weights"))
        .withColumn("profile", F.md5(F.concat_ws(
            ",", F.col("features").cast("array<string>"), F.col("weights").cast("array<string>"))))
    )


def check_feature_keys(features: DataFrame) -> None:
    """Two features with one 64-bit hash would be merged silently: stop instead."""
    keys = features.select("family", "key").distinct().groupBy(F.xxhash64("family", "key")).agg(F.count(F.lit(1)).alias("n"))
    if not keys.filter(F.col("n") > 1).isEmpty():
        raise ValueError("two features have the same hash")


def _chord(similarity: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * similarity, 0.0))


def _pivot_distances(batch: pd.DataFrame, pivots: Block) -> np.ndarray:
    return _chord(np.vstack([dots for _, dots in pivots.against(batch["features"], batch["weights"])]))


def _draw_pivots(candidates: DataFrame, count: int) -> pd.DataFrame:
    """The profiles with the smallest digests: a reproducible sample of at most ``MAX_PIVOTS`` rows."""
    return candidates.select("profile", "features", "weights").orderBy("profile").limit(count).toPandas()


def _assign(folded: DataFrame, pivots: pd.DataFrame) -> DataFrame:
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(pivots["features"], pivots["weights"])
        for batch in batches:
            if len(batch):
                distance = _pivot_distances(batch, block)
                nearest = distance.argmin(axis=1)
                yield batch.assign(cell=nearest.astype("int32"), gap=distance[np.arange(len(batch)), nearest])

    return folded.mapInPandas(
        step, "profile string, first_id long, features array<long>, weights array<double>, cell int, gap double")


def _visits(searching: DataFrame, pivots: pd.DataFrame, stats: pd.DataFrame, wanted: int, bounded: bool) -> DataFrame:
    """``(profile, cell)``: the cells to search. First the nearest ones that hold enough candidates; with ``bounded``
    all further ones that the radius reached so far does not rule out."""
    count = np.zeros(len(pivots), dtype=np.int64)
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    cells = stats["cell"].to_numpy()
    count[cells], low[cells], high[cells] = stats["n"], stats["low"], stats["high"]

    def first_cells(distance: np.ndarray) -> np.ndarray:
        order = np.argsort(distance, axis=1, kind="stable")
        before = np.cumsum(count[order], axis=1) - count[order]
        chosen = np.zeros(distance.shape, dtype=bool)
        np.put_along_axis(chosen, order, before < wanted, axis=1)
        return chosen & (count > 0)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(pivots["features"], pivots["weights"])
        apart = _pivot_distances(pivots, block)
        for batch in batches:
            if not len(batch):
                continue
            distance = _pivot_distances(batch, block)
            chosen = first_cells(distance)
            if bounded:
                radius = np.sqrt(np.maximum(2.0 - 2.0 * batch["reach"].fillna(-np.inf).to_numpy(), 0.0) + SLACK)
                own = distance.argmin(axis=1)
                nearest = distance[np.arange(len(batch)), own]
                between = np.maximum(apart[own], 1e-12)
                plane = (distance ** 2 - nearest[:, None] ** 2) / (2.0 * between)
                plane[np.arange(len(batch)), own] = 0.0
                # Coinciding pivots give no plane.
                plane = np.where(apart[own] > 1e-6, plane, 0.0)
                floor = np.maximum(np.maximum(distance - high, low - distance), plane)
                chosen = (floor <= radius[:, None] + SLACK) & (count > 0) & ~chosen
            row, cell = np.nonzero(chosen)
            yield pd.DataFrame({"profile": batch["profile"].to_numpy()[row], "cell": cell.astype("int32")})

    return searching.mapInPandas(step, "profile string, cell int")


def _with_block_counts(visits: DataFrame, candidates: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visits and candidates with the numbers of left and right blocks of their cell."""
    # One row per cell and at most MAX_PIVOTS cells.
    planned = F.broadcast(
        visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("left_blocks"))
        .join(F.broadcast(sizes), "cell"))
    return visits.join(planned, "cell"), candidates.join(planned, "cell")


def _profile_neighbours(folded: DataFrame, wanted: int, pivots: int | None) -> DataFrame:
    """The ``wanted`` nearest candidate profiles of every profile."""
    if pivots is not None and pivots > MAX_PIVOTS:
        raise ValueError(f"at most {MAX_PIVOTS} pivots")
    candidates = folded.filter(F.col("first_id").isNotNull())
    rows = candidates.count()
    if pivots is None:
        pivots = 1 if rows <= ONE_CELL_ROWS else min(max(int(math.sqrt(rows) / 2), 8), MAX_PIVOTS)
    spark = folded.sparkSession

    blocks = lambda n: max(math.ceil(n / BLOCK_ROWS), 1)
    if pivots <= 1 or rows <= 1:
        whole = {"cell": F.lit(0), "left_blocks": F.lit(blocks(folded.count())), "right_blocks": F.lit(blocks(rows))}
        return best_found(block_search(folded.select("profile").withColumns(whole), folded, candidates.withColumns(whole),
                                   wanted), wanted)

    drawn = _draw_pivots(candidates, pivots)
    placed = cut_lineage(_assign(folded, drawn))
    candidates = placed.filter(F.col("first_id").isNotNull())
    per_cell = candidates.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"))
    stats = per_cell.toPandas()  # one row per pivot
    sizes = spark.createDataFrame(
        [(int(c), blocks(n)) for c, n in zip(stats["cell"], stats["n"])],
        "cell int, right_blocks int")

    searching = placed.select("profile", "features", "weights")
    near = cut_lineage(_visits(searching, drawn, stats, wanted, bounded=False))

    def search(visits: DataFrame) -> DataFrame:
        counted, counted_candidates = _with_block_counts(visits, candidates, sizes)
        return block_search(counted, placed, counted_candidates, wanted)

    first = cut_lineage(best_found(search(near), wanted))
    # The radius is the similarity of the last wanted candidate; with fewer found there is none yet.
    reach = first.groupBy("profile").agg(
        F.when(F.count(F.lit(1)) >= wanted, F.min("similarity")).alias("reach"))
    far = cut_lineage(_visits(searching.join(reach, "profile", "left"), drawn, stats, wanted, bounded=True))
    return best_found(first.unionByName(search(far)), wanted)


def nearest_customers(features: DataFrame, k: int, min_businesses: int = 5, exclude_self: bool = True,
                      pivots: int | None = None, search: ProfileSearch | None = None) -> DataFrame:
    """``(masked_customer_id, neighbour, similarity, rank)``: the k most similar customers; exact, unless ``search`` is
    ``nearest_approx.approximate()``. Few candidates are searched in one blocked cell, more of them by ``nearest_exact.exact_lists()``;
    with ``pivots`` it is the pivot search at any size.

    Only customers whose business wallet has more than ``min_businesses`` entries may be neighbours; every customer
    may have neighbours. Equal similarities (at nine digits) go by customer id.
    """
    wanted = k + 1 if exclude_self else k
    # The features are read twice; they are worked out once.
    features = stage_table(features)
    check_feature_keys(features)
    profiles = cut_lineage(unit_profiles(features, min_businesses))
    # Of a fold of copies only the smallest ids can be among the nearest.
    members = top_n(profiles.filter("eligible").select("profile", CUSTOMER), ["profile"], F.lit(0.0), wanted,
                    [CUSTOMER]).select("profile", F.col(CUSTOMER).alias("neighbour"))
    folded = cut_lineage(profiles.groupBy("profile").agg(
        F.min(F.when(F.col("eligible"), F.col(CUSTOMER))).alias("first_id"),
        F.first("features").alias("features"), F.first("weights").alias("weights")))
    # A profile may be near to very many others, and may stand for very many customers.
    if search is None and pivots is None and folded.filter(F.col("first_id").isNotNull()).count() > ONE_CELL_ROWS:
        search = exact_lists()
    near = cut_lineage(search(folded, wanted) if search else _profile_neighbours(folded, wanted, pivots))
    near = salted_join(near.select("profile", F.col("other").alias("_other"), "similarity"),
                       members.withColumnRenamed("profile", "_other"), "_other", "profile")
    near = top_n(near, ["profile"], "similarity", wanted, ["neighbour"]).drop("rank")
    pairs = salted_join(profiles.select(CUSTOMER, "profile"), near, "profile", CUSTOMER)
    if exclude_self:
        pairs = pairs.filter(F.col(CUSTOMER) != F.col("neighbour"))
    return top_n(pairs, [CUSTOMER], "similarity", k, ["neighbour"]).select(
        CUSTOMER, "neighbour", "similarity", "rank")
