"""Exact nearest profiles without comparing all pairs: inverted lists of sparse keys, cells of dense parts.

A profile's similarity with another one is the dot product over the keys that very many profiles have (the dense part) and over
all others (the sparse part). An approximate search comes first and gives each profile its reach: the similarity of the last wanted
neighbour found so far. What can still beat it lies in one of two places:

* It shares a sparse key. Candidates stand in a list for each of their sparse keys. A profile's own sparse keys are put in order, rare
  ones first, and only a prefix of them is looked up: as soon as the best dense part there is and the length of the remaining keys
  cannot reach it together, the rest is left out. Long lists are compared in blocks.
* It shares none. Then the dense parts alone decide. Equal dense parts are folded: of a fold only the wanted smallest customer ids can be
  an answer, as shared keys only add. Dense parts lie in the cells of sampled pivots, and distances to the pivots rule cells out.

Where nearly all entries are those of dense keys, lists are empty and the bounds rule out little, while every visited cell costs a copy
of the profile: all pairs are then compared in few large blocks, without an approximate search before. That is quadratic in profiles, but
not in rows sent as long as a block holds them.

Weights must not be negative. Similarities are those of whole profiles, so the result equals the all-pairs search.
The driver gets the dense keys (a bounded number: each is in more than a share of the profiles), the pivots and a row for each cell.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillsight.operators.nearest_approx import approximate
from tillsight.operators.profile_blocks import BLOCK_ROWS, Block, ProfileSearch, best_found, block_search, pair_search
from tillsight.operators.ranking import top_n
from tillsight.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

MAX_PIVOTS = 2048
# A key is dense if so large a share of the candidates has it.
DENSE_SHARE = 1 / 16
# All pairs are compared if so large a share of the entries are those of dense keys.
PAIRS_SHARE = 0.9
# Room for rounding in the bounds: similarities are ranked at nine digits.
SLACK = 1e-8
# A key that every dense part has, with weight 0, so none is empty.
_NOTHING = -(1 << 63)

SPLIT = ("profile string, first_id long, features array<long>, weights array<double>, reach double, dense string, "
         "dense_features array<long>, dense_weights array<double>, dense_square double")


def dense_keys(candidates: DataFrame, rows: int, share: float) -> tuple[np.ndarray, int]:
    """Keys that more than a share of the candidates have (at most the entries of a profile over the share) and the number of their entries."""
    counts = candidates.select(F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter(F.col("n") > share * rows).select("f", "n").toPandas()
    return np.sort(found["f"].to_numpy(np.int64)), int(found["n"].sum())


def split_profiles(folded: DataFrame, dense: np.ndarray) -> DataFrame:
    """Profiles with their dense part and its name; equal parts have one name."""
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for features, weights in zip(batch["features"], batch["weights"], strict=True):
                own = np.isin(features, dense)
                f, w = np.append(features[own], _NOTHING).astype(np.int64), np.append(weights[own], 0.0)
                parts.append((hashlib.md5(f.tobytes() + w.tobytes()).hexdigest(), f, w, float(w @ w)))
            yield batch.assign(**{c: [p[k] for p in parts] for k, c in enumerate(
                ("dense", "dense_features", "dense_weights", "dense_square"))})

    return folded.select("profile", "first_id", "features", "weights", "reach").mapInPandas(step, SPLIT)


def _distances(batch: pd.DataFrame, pivots: pd.DataFrame, block: Block) -> np.ndarray:
    dots = np.vstack([d for _, d in block.against(batch["dense_features"], batch["dense_weights"])])
    square = batch["dense_square"].to_numpy()[:, None] + pivots["dense_square"].to_numpy()[None, :] - 2.0 * dots
    return np.sqrt(np.maximum(square, 0.0))


def assign_cells(parts: DataFrame, pivots: pd.DataFrame) -> DataFrame:
    """Dense parts with the cell of their nearest pivot and the distance to it."""
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(pivots["dense_features"], pivots["dense_weights"])
        for batch in batches:
            if len(batch):
                distance = _distances(batch, pivots, block)
                nearest = distance.argmin(axis=1)
                yield pd.DataFrame({"dense": batch["dense"], "cell": nearest.astype("int32"),
                                    "gap": distance[np.arange(len(batch)), nearest], "dense_square": batch["dense_square"]})

    return parts.mapInPandas(step, "dense string, cell int, gap double, dense_square double")


def open_cells(searching: DataFrame, pivots: pd.DataFrame, stats: pd.DataFrame) -> DataFrame:
    """``(profile, cells, ceiling)``: cells whose members may have a dense product within reach, and the largest dense product that the
    bounds leave for any candidate."""
    number = len(pivots)
    low, high, norm = np.full(number, np.inf), np.full(number, -np.inf), np.full(number, -np.inf)
    cells = stats["cell"].to_numpy()
    low[cells], high[cells], norm[cells] = stats["low"], stats["high"], stats["square"]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(pivots["dense_features"], pivots["dense_weights"])
        apart = _distances(pivots, pivots, block)
        for batch in batches:
            if not len(batch):
                continue
            distance = _distances(batch, pivots, block)
            rows = np.arange(len(batch))
            own = distance.argmin(axis=1)
            between = apart[own]
            plane = (distance ** 2 - distance[rows, own][:, None] ** 2) / (2.0 * np.maximum(between, 1e-12))
            # Coinciding pivots give no plane.
            plane = np.where(between > 1e-6, plane, 0.0)
            floor = np.maximum(np.maximum(np.maximum(distance - high, low - distance), plane), 0.0)
            square = batch["dense_square"].to_numpy()
            most = np.where(np.isfinite(norm), (square[:, None] + norm - floor ** 2) / 2.0, -np.inf)
            most = np.minimum(most, np.sqrt(square[:, None] * np.maximum(norm, 0.0)))
            visited = most + SLACK >= batch["reach"].fillna(-np.inf).to_numpy()[:, None]
            visited &= np.isfinite(norm)
            yield pd.DataFrame({"profile": batch["profile"], "cells": [np.flatnonzero(v).astype("int32") for v in visited],
                                "ceiling": most.max(axis=1)})

    return searching.mapInPandas(step, "profile string, cells array<int>, ceiling double")


def looked_up_keys(entries: DataFrame, lists: DataFrame, bounds: DataFrame, longest: float) -> DataFrame:
    """``(profile, cell)``: of each profile's sparse keys ``(profile, f, w)`` the prefix that has to be looked up.

    Keys go by the length of their list. A key is looked up if it and all later ones could, together with the ceiling of the
    dense part, still lift a candidate into reach; ``longest`` is the greatest length of a candidate's sparse part.
    """
    order = Window.partitionBy("profile").orderBy("n", "f").rowsBetween(0, Window.unboundedFollowing)
    kept = entries.join(lists, "f").withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(order)))
    within = F.col("reach").isNull() | (F.col("ceiling") + F.col("rest") * longest + SLACK >= F.col("reach"))
    return kept.join(bounds, "profile").filter(within).select("profile", F.col("f").alias("cell"))


def _blocks(count: Column) -> Column:
    return F.ceil(count / BLOCK_ROWS).cast("int")


def search_lists(looked_up: DataFrame, candidates: DataFrame, split: DataFrame, wanted: int, compared=None) -> DataFrame:
    """Best candidates among those in the lists of the keys looked up. ``candidates`` is ``(cell, profile, first_id, features, weights)``."""
    planned = looked_up.groupBy("cell").agg(_blocks(F.count(F.lit(1))).alias("left_blocks")).join(
        candidates.groupBy("cell").agg(_blocks(F.count(F.lit(1))).alias("right_blocks")), "cell")
    return block_search(looked_up.join(planned, "cell"), split, candidates.join(planned, "cell"), wanted, compared)


def exact_lists(near: ProfileSearch | None = None, compared=None, share: float = DENSE_SHARE, pivots: int | None = None,
                pairs_share: float = PAIRS_SHARE) -> ProfileSearch:
    """A search for ``nearest_customers(..., search=exact_lists())``; ``near`` is the approximate search that sets the reach. All pairs are
    compared if more than ``pairs_share`` of the entries are dense (never with 1)."""
    def search(folded: DataFrame, wanted: int) -> DataFrame:
        candidates = folded.filter("first_id IS NOT NULL")
        rows, entries = candidates.agg(F.count(F.lit(1)), F.sum(F.size("features"))).first()
        dense, dense_entries = dense_keys(candidates, rows, share)
        if not rows or dense_entries > pairs_share * entries:
            return pair_search(folded, candidates, wanted, folded.count(), rows, compared)
        first = (near or approximate(rounds=1, compared=compared))(folded, wanted)
        reach = first.groupBy("profile").agg(F.when(F.count(F.lit(1)) >= wanted, F.min("similarity")).alias("reach"))
        split = cut_lineage(split_profiles(folded.join(reach, "profile", "left"), dense))
        able = split.filter("first_id IS NOT NULL")

        # Those that share no sparse key: cells of dense parts.
        folds = able.groupBy("dense").agg(F.first("dense_features").alias("dense_features"),
                                          F.first("dense_weights").alias("dense_weights"), F.first("dense_square").alias("dense_square"))
        folds = cut_lineage(folds)
        number = folds.count()
        drawn = folds.orderBy("dense").limit(pivots or min(max(int(math.sqrt(number) / 2), 8), MAX_PIVOTS)).toPandas()
        placed = cut_lineage(assign_cells(folds, drawn))
        stats = placed.groupBy("cell").agg(
            F.min("gap").alias("low"), F.max("gap").alias("high"), F.max("dense_square").alias("square")).toPandas()
        found = cut_lineage(open_cells(split, drawn, stats))
        members = top_n(able.select("dense", "profile", "first_id"), ["dense"], F.lit(0.0), wanted, ["first_id"]).select("dense", "profile")
        in_cells = members.join(placed.select("dense", "cell"), "dense").select("cell", "profile").join(
            able.select("profile", "first_id", "features", "weights"), "profile")
        by_cells = search_lists(found.select("profile", F.explode("cells").alias("cell")), in_cells, split, wanted, compared)

        # Those that share one: inverted lists.
        entry = F.explode(F.arrays_zip("features", "weights")).alias("e")
        sparse = lambda table, *columns: table.select(*columns, entry).select(
            *columns, F.col("e.features").alias("f"), F.col("e.weights").alias("w")).filter(
            ~F.col("f").isin(dense.tolist()) if len(dense) else F.lit(True))
        lists = cut_lineage(sparse(able, "profile").groupBy("f").agg(F.count(F.lit(1)).alias("n")))
        least = able.agg(F.min("dense_square")).first()[0]
        bounds = found.select("profile", "ceiling").join(split.select("profile", "reach"), "profile")
        looked_up = cut_lineage(looked_up_keys(sparse(split, "profile"), lists, bounds, math.sqrt(max(1.0 - least, 0.0))))
        in_lists = sparse(able, "profile", "first_id", "features", "weights").withColumnRenamed("f", "cell").drop("w")
        by_lists = search_lists(looked_up, in_lists, split, wanted, compared)

        every = first.select("profile", "other", "first_id", "similarity").unionByName(by_cells).unionByName(by_lists)
        # A pair may be found in several places.
        return best_found(every.groupBy("profile", "other").agg(
            F.min("first_id").alias("first_id"), F.max("similarity").alias("similarity")), wanted)

    return search
