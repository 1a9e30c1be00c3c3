"""Range search and nearest-n search for any distance, with pivots and the triangle inequality.

A distance is a function over blocks of objects. If it is a metric, the distances to a few pivots bound all others. If it is not, it may
name a metric that it never falls below by more than a slack of each object: the bounds are those of the metric then, widened by
the slacks. A distance that is neither is refused.

Equal objects are folded. Objects lie in the cell of their nearest pivot; a cell is visited unless the bounds rule it out, and compared
in blocks of left and right rows. The driver gets the pivots and a row for each cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tillsight.operators.ranking import SCORE_DIGITS, top_n
from tillsight.operators.relational import salted_join
from tillsight.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

BLOCK_ROWS, MAX_PIVOTS, SAMPLE = 1000, 2048, 48
SLACK = 1e-9

Blocks = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


@dataclass(frozen=True)
class Distance:
    """``block`` gives the distances of left and right objects, from their ``columns``.

    Without ``metric`` it has to be a metric itself. With one, ``block(a, b) >= metric(a, b) - slack(a) - slack(b)`` must hold.
    """

    name: str
    columns: tuple[str, ...]
    block: Blocks
    metric: Blocks | None = None
    slack: Callable[[pd.DataFrame], np.ndarray] | None = None

    def bound(self, left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        return (self.metric or self.block)(left, right)

    def slacks(self, objects: pd.DataFrame) -> np.ndarray:
        return self.slack(objects) if self.slack else np.zeros(len(objects))


def weighted_hamming(fields: Sequence[str], weights: Sequence[float] | None = None) -> Distance:
    """Sum of the weights of the fields that differ; null equals null. A metric for weights above zero."""
    weights = [1.0] * len(fields) if weights is None else [float(w) for w in weights]

    def block(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        total = np.zeros((len(left), len(right)))
        for field, weight in zip(fields, weights, strict=True):
            codes = pd.factorize(pd.concat([left[field], right[field]]).astype("string"), use_na_sentinel=False)[0]
            total += weight * (codes[:len(left), None] != codes[None, len(left):])
        return total

    return Distance("weighted Hamming", tuple(fields), block)


def euclidean(fields: Sequence[str]) -> Distance:
    def block(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        total = np.zeros((len(left), len(right)))
        for field in fields:
            total += (left[field].to_numpy(float)[:, None] - right[field].to_numpy(float)[None, :]) ** 2
        return np.sqrt(total)

    return Distance("Euclidean", tuple(fields), block)


def box_gaps(axes: Sequence[str]) -> Distance:
    """Distance of boxes by their nearer ends, from columns ``<axis>_start`` and ``<axis>_end``.

    It is no metric (a box is not at distance 0 from itself), but it is at least the distance of the centres less both half diagonals.
    """
    columns = tuple(f"{a}_{edge}" for a in axes for edge in ("start", "end"))

    def block(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        total = np.zeros((len(left), len(right)))
        for a in axes:
            start, end = left[f"{a}_start"].to_numpy(float)[:, None], left[f"{a}_end"].to_numpy(float)[:, None]
            other_start, other_end = right[f"{a}_start"].to_numpy(float)[None, :], right[f"{a}_end"].to_numpy(float)[None, :]
            total += np.minimum(np.abs(start - other_end), np.abs(end - other_start)) ** 2
        return np.sqrt(total)

    def centres(objects: pd.DataFrame) -> np.ndarray:
        return np.stack([(objects[f"{a}_start"].to_numpy(float) + objects[f"{a}_end"].to_numpy(float)) / 2 for a in axes], 1)

    def metric(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        return np.sqrt(((centres(left)[:, None, :] - centres(right)[None, :, :]) ** 2).sum(2))

    def slack(objects: pd.DataFrame) -> np.ndarray:
        halves = [np.abs(objects[f"{a}_end"].to_numpy(float) - objects[f"{a}_start"].to_numpy(float)) / 2 for a in axes]
        return np.sqrt(sum(h ** 2 for h in halves))

    return Distance("box gap", columns, block, metric, slack)


def check_distance(distance: Distance, objects: pd.DataFrame) -> None:
    """Raise unless the bounds hold among the given objects: a test, not a proof."""
    if not len(objects):
        return
    m = distance.bound(objects, objects)
    room = 1e-9 * max(1.0, float(np.abs(m).max()))
    if (np.diag(m) > room).any():
        raise ValueError(f"{distance.name} is no metric: an object is not at distance 0 from itself")
    if (np.abs(m - m.T) > room).any() or (m < 0).any():
        raise ValueError(f"{distance.name} is no metric: it is not symmetric, or negative")
    for k in range(len(m)):
        if (m > m[:, k][:, None] + m[k][None, :] + room).any():
            raise ValueError(f"{distance.name} is no metric: it breaks the triangle inequality")
    slack = distance.slacks(objects)
    if (distance.block(objects, objects) < m - slack[:, None] - slack[None, :] - room).any():
        raise ValueError(f"{distance.name} falls below the metric named for it")


class _Index:
    """Folded objects in the cells of pivots."""

    def __init__(self, df: DataFrame, key: str, distance: Distance, pivots: int | None, compared):
        self.distance, self.compared = distance, compared
        columns = list(distance.columns)
        name = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
        self.rows = cut_lineage(df.select(F.col(key).alias("key"), *columns).withColumn("object", name))
        objects = self.rows.groupBy("object").agg(*[F.first(c).alias(c) for c in columns])
        self.objects = cut_lineage(objects)
        self.number = self.objects.count()
        wanted = pivots or min(max(int(math.sqrt(self.number) / 2), 4), MAX_PIVOTS)
        # The smallest digests: a reproducible sample.
        self.pivots = self.objects.orderBy("object").limit(max(wanted, SAMPLE)).toPandas()
        check_distance(distance, self.pivots.head(SAMPLE))
        self.pivots = self.pivots.head(wanted)
        self.schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.objects.schema)
        if self.number:
            self._place()

    def _place(self) -> None:
        distance, pivots = self.distance, self.pivots

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    far = distance.bound(batch, pivots)
                    nearest = far.argmin(1)
                    yield batch.assign(cell=nearest.astype("int32"), gap=far[np.arange(len(batch)), nearest], slack=distance.slacks(batch))

        self.placed = cut_lineage(self.objects.mapInPandas(step, f"{self.schema}, cell int, gap double, slack double"))
        # A row for each pivot.
        self.stats = self.placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.max("slack").alias("slack")).toPandas()

    def visits(self, searching: DataFrame, first: int | None) -> DataFrame:
        """``(object, cell)``: the nearest cells with ``first`` objects; without it all cells within ``radius`` (null: all)."""
        distance, pivots, stats = self.distance, self.pivots, self.stats
        cells = stats["cell"].to_numpy()
        n, slack = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        n[cells], low[cells], high[cells], slack[cells] = stats["n"], stats["low"], stats["high"], stats["slack"]

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                far = distance.bound(batch, pivots)
                if first is not None:
                    order = np.argsort(far, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    open_ = np.zeros(far.shape, bool)
                    np.put_along_axis(open_, order, before < first, axis=1)
                else:
                    # A member is nearer to its own pivot than to mine: half the difference is a bound in any metric space.
                    half = (far - far.min(1)[:, None]) / 2
                    floor = np.maximum(np.maximum(far - high, low - far), half)
                    radius = batch["radius"].fillna(np.inf).to_numpy()
                    open_ = floor <= radius[:, None] + distance.slacks(batch)[:, None] + slack[None, :] + SLACK
                row, cell = np.nonzero(open_ & (n > 0))
                yield pd.DataFrame({"object": batch["object"].to_numpy()[row], "cell": cell.astype("int32")})

        return searching.mapInPandas(step, "object string, cell int")

    def search(self, visits: DataFrame, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """``(object, other, distance)``: of each block the cells of the distance matrix that ``keep`` selects."""
        distance, compared, columns = self.distance, self.compared, list(self.distance.columns)
        blocks = lambda c: F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(c)
        # One row for each cell.
        planned = F.broadcast(visits.groupBy("cell").agg(blocks("lefts")).join(self.placed.groupBy("cell").agg(blocks("rights")), "cell"))
        slot = lambda c: F.pmod(F.xxhash64("object"), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = visits.join(self.objects, "object").join(planned, "cell").select(
            "cell", slot("lefts").alias("i"), every("rights").alias("j"), "object", *columns)
        right = self.placed.join(planned, "cell").select(
            F.col("cell").alias("o_cell"), slot("rights").alias("o_j"), every("lefts").alias("o_i"), F.col("object").alias("o_object"),
            *[F.col(c).alias(f"o_{c}") for c in columns])

        def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(theirs):
                return pd.DataFrame({"object": pd.Series(dtype=str), "other": pd.Series(dtype=str), "distance": pd.Series(dtype=float)})
            if compared is not None:
                compared.add(len(mine) * len(theirs))
            theirs = theirs.rename(columns={f"o_{c}": c for c in columns}).sort_values("o_object")
            found = np.round(distance.block(mine, theirs), SCORE_DIGITS)
            row, column = keep(found)
            return pd.DataFrame({"object": mine["object"].to_numpy()[row], "other": theirs["o_object"].to_numpy()[column],
                                 "distance": found[row, column]})

        return left.groupBy("cell", "i", "j").cogroup(right.groupBy("o_cell", "o_i", "o_j")).applyInPandas(
            compare, "object string, other string, distance double")


def range_pairs(df: DataFrame, key: str, distance: Distance, radius: float, pivots: int | None = None, compared=None) -> DataFrame:
    """``(key, other, distance)`` for all ordered pairs of rows within the radius, at nine digits; exact.

    A row is paired with itself where its distance to itself is within the radius. ``compared``, an accumulator, gets the number of
    pairs of different objects that were compared.
    """
    index = _Index(df, key, distance, pivots, compared)
    if not index.number:
        return index.rows.select("key", F.col("key").alias("other"), F.lit(0.0).alias("distance")).toDF(key, "other", "distance")
    visits = cut_lineage(index.visits(index.objects.withColumn("radius", F.lit(float(radius))), None))
    found = index.search(visits, lambda block: np.nonzero(block <= radius))
    members = index.rows.select("object", "key")
    # Copies on both sides: the result has all of their pairs.
    mine = salted_join(found, members, "object", "other")
    both = salted_join(mine.select("key", F.col("other").alias("object"), "distance"), members.withColumnRenamed("key", "_other"), "object", "key")
    return both.select(F.col("key").alias(key), F.col("_other").alias("other"), "distance")


def nearest_n(df: DataFrame, key: str, distance: Distance, n: int, exclude_self: bool = True, pivots: int | None = None,
              compared=None) -> DataFrame:
    """``(key, other, distance, rank)``: the ``n`` nearest rows of each row, exact; equal distances at nine digits go by ``other``."""
    index = _Index(df, key, distance, pivots, compared)
    if not index.number:
        return index.rows.select("key", F.col("key").alias("other"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).toDF(
            key, "other", "distance", "rank")
    wanted = n + 1 if exclude_self else n
    # Of equal objects only the smallest keys can be among the nearest.
    members = top_n(index.rows.select("object", "key"), ["object"], F.lit(0.0), wanted, ["key"]).select("object", "key")
    least = members.groupBy("object").agg(F.min("key").alias("least"))

    def nearest(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Ties go by key, which a block does not know: all that reach the last wanted distance are kept.
        last = np.partition(block, min(wanted, block.shape[1]) - 1, axis=1)[:, min(wanted, block.shape[1]) - 1]
        return np.nonzero(block <= last[:, None])

    def best(found: DataFrame) -> DataFrame:
        ranked = top_n(found.join(least, found["other"] == least["object"]).select(found["object"], "other", "distance", "least"),
                       ["object"], -F.col("distance"), wanted, ["least"])
        return ranked.select("object", "other", "distance")

    first = cut_lineage(best(index.search(cut_lineage(index.visits(index.objects, wanted)), nearest)))
    reach = first.groupBy("object").agg(F.when(F.count(F.lit(1)) >= wanted, F.max("distance")).alias("radius"))
    far = cut_lineage(index.visits(index.objects.join(reach, "object", "left"), None))
    near = cut_lineage(best(first.unionByName(index.search(far, nearest)).distinct()))
    pairs = salted_join(near.select(F.col("object").alias("_mine"), F.col("other").alias("object"), "distance"), members, "object", "_mine")
    pairs = top_n(pairs.select("_mine", F.col("key").alias("other"), "distance"), ["_mine"], -F.col("distance"), wanted, ["other"])
    every = salted_join(index.rows.select("key", F.col("object").alias("_mine")), pairs.drop("rank"), "_mine", "key")
    if exclude_self:
        every = every.filter(F.col("key") != F.col("other"))
    return top_n(every, ["key"], -F.col("distance"), n, ["other"]).select(F.col("key").alias(key), "other", "distance", "rank")
