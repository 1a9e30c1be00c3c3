"""Profiles compared in blocks: sparse unit vectors on Arrow batches, exact dot products, the best candidates of each profile."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tillsight.operators.ranking import top_n
from tillsight.session import ship_with_tasks

ship_with_tasks(__name__)

BLOCK_ROWS = 1000
_CELLS_AT_ONCE = 2_000_000
# All pairs: tables are cut into so many blocks, into more of them where a block would get more rows than that.
PAIR_BLOCKS, PAIR_BLOCK_ROWS, _CHUNK_ROWS = 8, 50_000, 4096

# From folded profiles and a number: the so many nearest candidate profiles of each.
ProfileSearch = Callable[[DataFrame, int], DataFrame]


class Block:
    """Right-hand rows of a comparison. Features that many rows have form a dense matrix; for the others the entries are
    kept by feature, so a left row only touches the rows that share one."""

    def __init__(self, features: pd.Series, weights: pd.Series):
        lengths = features.map(len).to_numpy()
        ids = np.concatenate(features.to_numpy()).astype(np.int64)
        values = np.concatenate(weights.to_numpy()).astype(np.float64)
        owners = np.repeat(np.arange(len(lengths)), lengths)
        self.size = len(lengths)
        self.vocabulary, code, counts = np.unique(ids, return_inverse=True, return_counts=True)
        frequent = counts * 8 >= self.size
        self.dense_row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.dense = np.zeros((int(frequent.sum()), self.size))
        common = frequent[code]
        self.dense[self.dense_row[code[common]], owners[common]] = values[common]
        rare = np.flatnonzero(~common)
        rare = rare[np.argsort(code[rare], kind="stable")]
        self.owners, self.values = owners[rare], values[rare]
        self.bounds = np.concatenate([[0], np.cumsum(np.where(frequent, 0, counts))])
        self.widest = max(int(np.diff(self.bounds).max()), 1)

    def dots(self, features: list, weights: list) -> np.ndarray:
        ids, values = np.concatenate(features), np.concatenate(weights)
        left = np.repeat(np.arange(len(features)), [len(f) for f in features])
        at = np.minimum(np.searchsorted(self.vocabulary, ids), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == ids
        at, left, values = at[known], left[known], values[known]
        row = self.dense_row[at]
        common = row >= 0
        mine = np.zeros((len(features), len(self.dense)))
        mine[left[common], row[common]] = values[common]
        at, left, values = at[~common], left[~common], values[~common]
        counts = self.bounds[at + 1] - self.bounds[at]
        entry = np.repeat(self.bounds[at] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        cell = np.repeat(left, counts) * self.size + self.owners[entry]
        sparse = np.bincount(cell, np.repeat(values, counts) * self.values[entry], len(features) * self.size)
        return mine @ self.dense + sparse.reshape(len(features), self.size)

    def against(self, features: pd.Series, weights: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
        """``(first row, dot products)`` of the left rows, in steps that bound the memory in use."""
        f, w = features.to_numpy(), weights.to_numpy()
        start = 0
        while start < len(f):
            end, cells = start, 0
            while end < len(f) and (end == start or cells + len(f[end]) * self.widest + self.size <= _CELLS_AT_ONCE):
                cells += len(f[end]) * self.widest + self.size
                end += 1
            yield start, self.dots(list(f[start:end]), list(w[start:end]))
            start = end


def block_search(visits: DataFrame, folded: DataFrame, candidates: DataFrame, wanted: int, compared=None) -> DataFrame:
    """Best ``wanted`` candidates per visiting profile and block pair. Visits and candidates know their ``cell`` and its
    ``left_blocks`` and ``right_blocks``. ``compared``, an accumulator, gets the number of pairs."""
    slot = lambda blocks: F.pmod(F.xxhash64("profile"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = (
        visits.join(folded.select("profile", "features", "weights"), "profile")
        .select("cell", slot("left_blocks").alias("lb"), every("right_blocks").alias("rb"),
                "profile", "features", "weights")
    )
    right = (
        candidates
        .select("cell", slot("right_blocks").alias("rb"), every("left_blocks").alias("lb"),
                "profile", "first_id", "features", "weights")
        .toDF("r_cell", "r_rb", "r_lb", "r_profile", "r_first_id", "r_features", "r_weights")
    )

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(mine) and len(theirs):
            if compared is not None:
                compared.add(len(mine) * len(theirs))
            theirs = theirs.sort_values("r_first_id")
            names, first = theirs["r_profile"].to_numpy(), theirs["r_first_id"].to_numpy()
            right_block = Block(theirs["r_features"], theirs["r_weights"])
            keep = min(wanted, len(theirs))
            for start, dots in right_block.against(mine["features"], mine["weights"]):
                score = np.round(dots, 9)
                # Columns are in id order, so a stable sort settles ties by id.
                best = np.argsort(-score, axis=1, kind="stable")[:, :keep]
                found.append(pd.DataFrame({
                    "profile": np.repeat(mine["profile"].to_numpy()[start:start + len(dots)], keep),
                    "other": names[best.ravel()], "first_id": first[best.ravel()],
                    "similarity": np.take_along_axis(score, best, axis=1).ravel()}))
        if not found:
            return pd.DataFrame({"profile": pd.Series(dtype=str), "other": pd.Series(dtype=str),
                                 "first_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        return pd.concat(found)

    return left.groupBy("cell", "lb", "rb").cogroup(right.groupBy("r_cell", "r_lb", "r_rb")).applyInPandas(
        search, "profile string, other string, first_id long, similarity double")


def best_columns(score: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` greatest entries of each row as a mask, earlier columns first among equal ones."""
    if keep >= score.shape[1]:
        return np.ones(score.shape, bool)
    last = -np.partition(-score, keep - 1, axis=1)[:, keep - 1:keep]
    above, level = score > last, score == last
    return above | level & (np.cumsum(level, axis=1) <= keep - above.sum(axis=1)[:, None])


def best_of_block(mine: pd.DataFrame, theirs: pd.DataFrame, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, similarity)`` of the best ``wanted`` of ``theirs`` for each of ``mine``; equal ones in the order of ``theirs``.

    Chunk by chunk: what does not exceed the last of the best so far is left out unsorted.
    """
    row, column, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = np.full(len(mine), -np.inf)
    # Short chunks first: they set the floor for the long ones.
    borders = np.append(np.arange(0, len(theirs), _CHUNK_ROWS), len(theirs))
    borders = np.union1d(borders, [b for b in (_CHUNK_ROWS // 8, _CHUNK_ROWS // 3) if b < len(theirs)]).astype(int)
    for begin, end in zip(borders[:-1], borders[1:], strict=True):
        chunk = theirs.iloc[begin:end]
        found = [(row, column, value)]
        for start, dots in Block(chunk["r_features"], chunk["r_weights"]).against(mine["features"], mine["weights"]):
            # An equal one stands behind those of earlier chunks. Half a unit of the ninth digit is rounded up.
            least = floor[start:start + len(dots)]
            open_ = dots > (least + 4e-10)[:, None]
            many = np.flatnonzero(np.count_nonzero(open_, axis=1) > 4 * wanted)
            if len(many):
                open_[many] &= best_columns(np.round(dots[many], 9), wanted)
            place = np.flatnonzero(open_)
            at, other = np.divmod(place, len(chunk))
            score = np.round(dots.ravel()[place], 9)
            above = score > least[at]
            found.append((at[above] + start, other[above] + begin, score[above]))
        row, column, value = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((column, -value, row))
        row, column, value = row[order], column[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < wanted
        row, column, value, place = row[kept], column[kept], value[kept], place[kept]
        floor[row[place == wanted - 1]] = value[place == wanted - 1]
    return row, column, value


def pair_search(folded: DataFrame, candidates: DataFrame, wanted: int, rows: int, able: int, compared=None) -> DataFrame:
    """Best ``wanted`` candidates of every profile, by all pairs: blocks of left and right rows, each pair of blocks one group.

    A profile is sent to as many groups as there are blocks of the other side, not to each small block that it has to see.
    """
    count = lambda n: max(math.ceil(n / PAIR_BLOCK_ROWS), min(PAIR_BLOCKS, math.ceil(n / BLOCK_ROWS)), 1)
    lefts, rights = count(rows), count(able)
    slot = lambda blocks: F.pmod(F.xxhash64("profile"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = folded.select(slot(lefts).alias("lb"), every(rights).alias("rb"), "profile", "features", "weights")
    right = candidates.select(
        slot(rights).alias("r_rb"), every(lefts).alias("r_lb"), F.col("profile").alias("r_profile"), F.col("first_id").alias("r_first_id"),
        F.col("features").alias("r_features"), F.col("weights").alias("r_weights"))

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if compared is not None:
            compared.add(len(mine) * len(theirs))
        theirs = theirs.sort_values("r_first_id")
        row, column, value = best_of_block(mine, theirs, wanted) if len(mine) and len(theirs) else ([], [], [])
        return pd.DataFrame({
            "profile": mine["profile"].to_numpy()[row], "other": theirs["r_profile"].to_numpy()[column],
            "first_id": theirs["r_first_id"].to_numpy()[column], "similarity": value}) if len(row) else pd.DataFrame({
                "profile": pd.Series(dtype=str), "other": pd.Series(dtype=str),
                "first_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

    found = left.groupBy("lb", "rb").cogroup(right.groupBy("r_lb", "r_rb")).applyInPandas(
        search, "profile string, other string, first_id long, similarity double")
    return best_found(found, wanted)


def best_found(found: DataFrame, wanted: int) -> DataFrame:
    return top_n(found, ["profile"], "similarity", wanted, ["first_id"]).drop("rank")
