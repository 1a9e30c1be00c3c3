"""The best items by inner product of factors, without multiplying every user with every item.

Items are ordered by the length of their factors, longest first, and cut into slices. Users meet one slice after the other; a user's
product with an item is at most the product of both lengths, so a user whose worst place is above what the next slice can
reach is finished. Inside a slice the same test is made for each block of items, so most users see a few blocks only.

A slice is bounded in bytes and grows from round to round, so the first ones are small and rounds are few. Users are worked on in Arrow
batches; those that are not finished after a slice are written to the checkpoint folder with their best places so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tillsight.operators.ranking import SCORE_DIGITS, numbered_in_order
from tillsight.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

FIRST_SLICE, SLICE_GROWTH, SLICE_BYTES = 4096, 8, 32 << 20
BLOCK_ITEMS, BLOCK_USERS = 512, 1024
# Room for rounding between the bound and the rounded score.
SLACK = 1e-8
STATE = "user int, features array<float>, known array<int>, items array<int>, scores array<double>, open boolean"


def slices(items: int, rank: int) -> list[tuple[int, int]]:
    """First and last place (from 0, end not included) of each slice of the ordered items."""
    most, size, start, found = max(SLICE_BYTES // (8 * (rank + 1)), 1), FIRST_SLICE, 0, []
    while start < items:
        end = min(start + min(size, most), items)
        found.append((start, end))
        start, size = end, size * SLICE_GROWTH
    return found


def _known_in(known: list, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the items of a block that each user knows; ``ids`` is in order."""
    rows = np.repeat(np.arange(len(known)), [len(k) for k in known])
    values = np.concatenate(known) if len(rows) else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
    hit = ids[at] == values
    return rows[hit], at[hit]


def best_places(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the best ``n`` entries: score falling at nine digits, then smaller ids. Unknown entries are -inf."""
    order = np.lexsort((ids, -np.round(scores, SCORE_DIGITS)), axis=1)[:, :n]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _against(table: pd.DataFrame, n: int, ahead: float, compared):
    """A slice for all open users; ``ahead`` is the length of the longest item beyond it."""
    factors = np.vstack(table["features"].to_numpy()).astype(np.float64)
    ids, length = table["id"].to_numpy(np.int64), table["length"].to_numpy()

    def part(users: pd.DataFrame) -> pd.DataFrame:
        mine = np.vstack(users["features"].to_numpy()).astype(np.float64)
        reach = np.linalg.norm(mine, axis=1)
        top_ids = np.full((len(users), n), -1, np.int64)
        top = np.full((len(users), n), -np.inf)
        for row, (found, scores) in enumerate(zip(users["items"], users["scores"], strict=True)):
            top_ids[row, :len(found)], top[row, :len(scores)] = found, scores
        known = [np.asarray(k, np.int64) for k in users["known"]]
        live = np.arange(len(users))
        for start in range(0, len(ids), BLOCK_ITEMS):
            live = live[reach[live] * length[start] + SLACK >= top[live, -1]]
            if not len(live):
                break
            block = slice(start, start + BLOCK_ITEMS)
            order = np.argsort(ids[block])
            own = ids[block][order]
            scores = mine[live] @ factors[block][order].T
            if compared is not None:
                compared.add(scores.size)
            row, column = _known_in([known[k] for k in live], own)
            scores[row, column] = -np.inf
            top_ids[live], top[live] = best_places(
                np.hstack([top_ids[live], np.broadcast_to(own, scores.shape)]), np.hstack([top[live], scores]), n)
        found = [np.isfinite(t) for t in top]
        return users.assign(items=[i[f].astype(np.int32) for i, f in zip(top_ids, found, strict=True)],
                            scores=[t[f] for t, f in zip(top, found, strict=True)], open=reach * ahead + SLACK >= top[:, -1])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK_USERS):
                yield part(batch.iloc[start:start + BLOCK_USERS])

    return step


def top_products(users: DataFrame, items: DataFrame, n: int, compared=None) -> DataFrame:
    """``(user, item, score, rank)``: the ``n`` items of each user with the greatest product of factors, among those not in ``known``.

    ``users`` is ``(user, features, known)``, ``items`` is ``(id, features)``; equal scores at nine digits go to the smaller id.
    ``compared``, an accumulator, gets the number of products.
    """
    length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    ordered = numbered_in_order(items.select("id", "features", length.alias("length")), [F.col("length").desc(), F.col("id")])
    number = ordered.count()
    state = users.select(
        F.col("user").cast("int").alias("user"), F.col("features").cast("array<float>").alias("features"),
        F.col("known").cast("array<int>").alias("known"), F.expr("CAST(array() AS array<int>)").alias("items"),
        F.expr("CAST(array() AS array<double>)").alias("scores"), F.lit(True).alias("open"))
    finished = [state.limit(0)]
    if number:
        cuts = slices(number, len(items.first()["features"]))
        for k, (start, end) in enumerate(cuts):
            # One slice on the driver: its bytes are bounded.
            table = ordered.filter((F.col("place") >= start) & (F.col("place") < end)).orderBy("place").toPandas()
            ahead = ordered.filter(F.col("place") == end).select("length").first()
            state = cut_lineage(state.mapInPandas(_against(table, n, ahead[0] if ahead else -np.inf, compared), STATE))
            if k + 1 == len(cuts):
                finished.append(state)
                break
            finished.append(state.filter(~F.col("open")))
            state = state.filter("open")
            if state.isEmpty():
                break
    found = finished[0]
    for more in finished[1:]:
        found = found.unionByName(more)
    return found.select("user", F.posexplode(F.arrays_zip("items", "scores")).alias("at", "e")).select(
        "user", F.col("e.items").alias("item"), F.col("e.scores").alias("score"), (F.col("at") + 1).cast("int").alias("rank"))
