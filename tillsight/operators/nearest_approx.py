"""Approximate nearest profiles: banded random-hyperplane signatures, exact rescoring, refinement along neighbours of neighbours.

1. Each profile, less the mean profile, is put on one side or the other of random hyperplanes. The sides of a band make an
   integer key; its length follows the number of profiles, so that a bucket has about ``BUCKET`` of them.
2. Profiles that share a key are candidates and are scored exactly. A bucket that is much fuller than the others takes more
   bits of its signature, and what is still beyond ``MAX_GROUP`` then (profiles that hardly differ) is dealt over salts,
   other ones in each band.
3. Each refining round compares the neighbours of a profile with each other: those it has found, and the best of those that have found
   it. The neighbours of a near profile are near, so a round mends what the buckets have missed. What is below a profile's list so far
   is not sent.

Inside the search a profile is a number, the first 15 hex digits of its digest, which sorts like the digest; two profiles with one number
stop the job.

All comparisons happen inside groups of at most ``MAX_GROUP`` profiles, one wide row for each profile and group. The pairs compared are
bounded by the profiles times a number that depends on bands, rounds and the wanted neighbours, not on the data.

The similarities returned are exact; what may be missing are neighbours. ``recall`` measures it against the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tillsight.operators.profile_blocks import Block, ProfileSearch, best_columns
from tillsight.operators.ranking import top_n
from tillsight.operators.relational import CUSTOMER
from tillsight.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

BANDS, ROUNDS, BUCKET, MAX_GROUP = 8, 2, 64, 512
# So many neighbours are kept between rounds, where fewer are wanted: a narrow list finds its way badly.
LEAST_WIDTH = 16
# Bits of a band that are worked out; keys take as many of them as they need.
SIGNATURE_BITS = 30
# A feature is part of the mean profile if so large a share of the profiles has it. A profile has few entries, so there are at
# most its entries over this share of such features.
MEAN_SHARE = 0.01
FOUND = "profile long, other long, first_id long, similarity double"
# A group is compared as a dense matrix of at most so many cells.
_DENSE_CELLS = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hyperplanes(features: np.ndarray, plane: int) -> np.ndarray:
    """A plane's entries at the given features, about normal: the sum of four 16-bit parts of a hash."""
    salt = np.uint64((plane + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = _mixed(features.astype(np.int64).view(np.uint64) + salt)
    parts = sum((h >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)).astype(np.float64)
    return (parts / 65535.0 - 2.0) * math.sqrt(3.0)


def mean_profile(folded: DataFrame) -> pd.DataFrame:
    """``(f, w)``: means of the features that ``MEAN_SHARE`` of the profiles have."""
    rows = folded.count()
    entries = folded.select(F.explode(F.arrays_zip("features", "weights")).alias("e")).select(
        F.col("e.features").alias("f"), F.col("e.weights").alias("w"))
    means = entries.groupBy("f").agg(F.count(F.lit(1)).alias("n"), (F.sum("w") / max(rows, 1)).alias("w"))
    return means.filter(F.col("n") >= MEAN_SHARE * rows).select("f", "w").orderBy("f").toPandas()


def signatures(folded: DataFrame, bands: int) -> DataFrame:
    """``(profile, eligible, band, bits)``: the sides of ``SIGNATURE_BITS`` hyperplanes for each band."""
    mean = mean_profile(folded)
    mean_f, mean_w = mean["f"].to_numpy(np.int64), mean["w"].to_numpy(np.float64)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            lengths = batch["features"].map(len).to_numpy()
            features = np.concatenate(batch["features"].to_numpy()).astype(np.int64)
            weights = np.concatenate(batch["weights"].to_numpy()).astype(np.float64)
            starts = np.cumsum(lengths) - lengths
            distinct, code = np.unique(features, return_inverse=True)
            out = np.zeros((len(batch), bands), np.int64)
            for band in range(bands):
                for k in range(SIGNATURE_BITS):
                    plane = band * SIGNATURE_BITS + k
                    side = np.add.reduceat(hyperplanes(distinct, plane)[code] * weights, starts)
                    side -= float(hyperplanes(mean_f, plane) @ mean_w)
                    out[:, band] = out[:, band] << 1 | (side > 0)
            yield pd.DataFrame({
                "profile": np.repeat(batch["profile"].to_numpy(), bands), "band": np.tile(np.arange(bands, dtype=np.int32), len(batch)),
                "bits": out.ravel()})

    return folded.select("profile", "features", "weights").filter(F.size("features") > 0).mapInPandas(
        step, "profile long, band int, bits long")


def bucketed(signed: DataFrame, rows: int) -> DataFrame:
    """``(key, slot, profile)``: the groups whose members are compared, at most about ``MAX_GROUP`` of them in one."""
    bits = min(max(math.ceil(math.log2(max(rows, 1) / BUCKET)), 0), SIGNATURE_BITS)
    keyed = signed.withColumn("short", F.shiftright("bits", SIGNATURE_BITS - bits))
    # Full buckets take further bits, one for each doubling.
    full = keyed.groupBy("band", "short").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * BUCKET).select(
        "band", "short", F.least(F.ceil(F.log2(F.col("n") / BUCKET)), F.lit(SIGNATURE_BITS - bits)).cast("int").alias("more"))
    keyed = keyed.join(full, ["band", "short"], "left").withColumn("length", bits + F.coalesce("more", F.lit(0)))
    cut = F.call_function("shiftright", F.col("bits"), SIGNATURE_BITS - F.col("length"))
    # Band, length and bits in one number.
    key = F.shiftleft(F.shiftleft(F.col("band").cast("long"), 6) + F.col("length"), SIGNATURE_BITS) + cut
    keyed = cut_lineage(keyed.select(key.alias("key"), "band", "profile"))
    # What hardly differs goes to salts, with another draw in each band.
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_GROUP // 2).select(
        "key", F.ceil(F.col("n") / (MAX_GROUP // 2)).alias("salts"))
    salt = F.pmod(F.xxhash64("profile", "band"), F.coalesce("salts", F.lit(1)))
    return keyed.join(hot, "key", "left").select("key", salt.cast("int").alias("slot"), "profile")


def numbered(folded: DataFrame) -> DataFrame:
    """The profiles by number; ``name`` is what they were."""
    number = F.conv(F.substring("profile", 1, 15), 16, 10).cast("bigint")
    return folded.withColumn("name", F.col("profile")).withColumn("profile", number)


class Groups:
    """Rows of a batch, of which any run can be compared with itself."""

    def __init__(self, batch: pd.DataFrame):
        self.batch = batch
        self.names, first = batch["profile"].to_numpy(np.int64), batch["first_id"]
        self.able, self.first = first.notna().to_numpy(), first.fillna(0).to_numpy().astype(np.int64)
        self.least = batch["reach"].astype("float64").fillna(-np.inf).to_numpy(np.float64)
        lengths = batch["features"].map(len).to_numpy()
        self.bounds = np.append(0, np.cumsum(lengths))
        self.owner = np.repeat(np.arange(len(batch)), lengths)
        self.code = np.unique(np.concatenate(batch["features"].to_numpy()).astype(np.int64), return_inverse=True)[1]
        self.values = np.concatenate(batch["weights"].to_numpy()).astype(np.float64)

    def against(self, start: int, end: int, able: np.ndarray):
        """``(first row, dot products)`` of the rows from ``start`` to ``end`` with the able ones."""
        entries = slice(self.bounds[start], self.bounds[end])
        vocabulary, code = np.unique(self.code[entries], return_inverse=True)
        if (end - start) * len(vocabulary) > _DENSE_CELLS:
            rows = self.batch.iloc[able]
            yield from Block(rows["features"], rows["weights"]).against(
                self.batch["features"].iloc[start:end], self.batch["weights"].iloc[start:end])
            return
        matrix = np.zeros((end - start, len(vocabulary)))
        matrix[self.owner[entries] - start, code] = self.values[entries]
        yield 0, matrix @ matrix[able - start].T

    def best(self, start: int, end: int, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(profile, other, first_id, similarity)``: the best ``wanted`` of each row, without what does not reach its list so far."""
        able = start + np.flatnonzero(self.able[start:end])
        able = able[np.argsort(self.first[able], kind="stable")]
        for begin, dots in self.against(start, end, able):
            score = np.round(dots, 9)
            least = self.least[start + begin:start + begin + len(score)]
            # Columns are in id order: ties go to earlier ones.
            at, other = np.nonzero(best_columns(score, wanted) & (score >= least[:, None]))
            yield self.names[start + begin + at], self.names[able[other]], self.first[able[other]], score[at, other]


def group_search(groups: DataFrame, folded: DataFrame, wanted: int, compared=None) -> DataFrame:
    """Best ``wanted`` candidates of each profile in each of its groups ``(key, slot, profile)``, scored exactly.

    Where profiles have a ``reach``, worse candidates are left out. ``compared``, an accumulator, gets the number of pairs.
    """
    reach = F.col("reach") if "reach" in folded.columns else F.lit(None).cast("double").alias("reach")
    wide = groups.join(folded.select("profile", "first_id", "features", "weights", reach), "profile")
    dealt = wide.repartition("key", "slot").sortWithinPartitions("key", "slot")

    def search(batch: pd.DataFrame, borders: np.ndarray) -> Iterator[pd.DataFrame]:
        rows, found = Groups(batch), []
        for start, end in zip(borders[:-1], borders[1:], strict=True):
            able = np.count_nonzero(rows.able[start:end])
            if end - start < 2 or not able:
                continue
            if compared is not None:
                compared.add(int((end - start) * able))
            found += rows.best(start, end, wanted)
        if found:
            yield pd.DataFrame(dict(zip(
                ("profile", "other", "first_id", "similarity"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A group may go on in the next batch; the last one of a batch is held back."""
        held = None
        for batch in batches:
            if held is not None and len(held):
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            own = batch["key"].to_numpy(), batch["slot"].to_numpy()
            cuts = np.flatnonzero((own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])) + 1
            borders = np.append(0, cuts)
            if len(cuts):
                yield from search(batch.iloc[:cuts[-1]], borders)
            held = batch.iloc[borders[-1]:]
        if held is not None and len(held):
            yield from search(held, np.array([0, len(held)]))

    return dealt.mapInPandas(step, FOUND)


def _best_of(found: DataFrame, wanted: int) -> DataFrame:
    """A pair may be found in several groups: it counts once."""
    once = found.groupBy("profile", "other").agg(F.max("similarity").alias("similarity"), F.min("first_id").alias("first_id"))
    return top_n(once, ["profile"], "similarity", wanted, ["first_id"]).select("profile", "other", "first_id", "similarity")


def neighbourhoods(near: DataFrame, wanted: int) -> DataFrame:
    """``(key, slot, profile)``: each profile with those it has found and the best ``wanted`` of those that have found it."""
    back = top_n(near.select(F.col("other").alias("center"), "profile", "similarity"), ["center"], "similarity", wanted, ["profile"])
    ahead = near.select(F.col("profile").alias("center"), F.col("other").alias("profile"))
    own = near.select(F.col("profile").alias("center"), "profile")
    groups = ahead.unionByName(back.select("center", "profile")).unionByName(own).distinct()
    return groups.select(F.col("center").alias("key"), F.lit(0).alias("slot"), "profile")


def reached(near: DataFrame, wanted: int) -> DataFrame:
    """``(profile, reach)``: the similarity of the last of ``wanted`` neighbours, null where there are fewer."""
    return near.groupBy("profile").agg(F.when(F.count(F.lit(1)) >= wanted, F.min("similarity")).alias("reach"))


def named(near: DataFrame, folded: DataFrame) -> DataFrame:
    """Both profiles of a row by name again."""
    names = folded.select("profile", "name")
    others = names.toDF("other", "other_name")
    return near.join(names, "profile").join(others, "other").select(
        F.col("name").alias("profile"), F.col("other_name").alias("other"), "first_id", "similarity")


def approximate(bands: int = BANDS, rounds: int = ROUNDS, compared=None) -> ProfileSearch:
    """A search for ``nearest_customers(..., search=approximate())``."""
    if bands < 1 or rounds < 0:
        raise ValueError("bands must be 1 or more, rounds 0 or more")

    def search(folded: DataFrame, wanted: int) -> DataFrame:
        width = max(wanted, LEAST_WIDTH)
        folded = cut_lineage(numbered(folded))
        rows, numbers = folded.agg(F.count(F.lit(1)), F.count_distinct("profile")).first()
        if rows != numbers:
            raise ValueError("two profiles have the same number")
        groups = bucketed(signatures(folded, bands), rows)
        near = cut_lineage(_best_of(group_search(groups, folded, width, compared), width))
        for _ in range(rounds):
            found = group_search(neighbourhoods(near, width), folded.join(reached(near, width), "profile", "left"), width, compared)
            near = cut_lineage(_best_of(near.unionByName(found), width))
        return named(_best_of(near, wanted) if width > wanted else near, folded)

    return search


def recall(found: DataFrame, exact: DataFrame, every: int = 50) -> DataFrame:
    """One row: ``queries`` (customers whose id is divisible by ``every``), ``wanted`` neighbours of the exact search, ``found`` of them."""
    asked = F.col(CUSTOMER) % every == 0
    truth = exact.filter(asked).select(CUSTOMER, "neighbour")
    hit = found.filter(asked).select(CUSTOMER, "neighbour", F.lit(1).alias("hit"))
    return truth.join(hit, [CUSTOMER, "neighbour"], "left").agg(
        F.count_distinct(CUSTOMER).alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
