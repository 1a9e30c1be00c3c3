"""Near duplicates: MinHash with banding, signature verification, exact confirmation, connected components.

1. Each text becomes its set of hashed word shingles, the minima of many universal hashes of the set, and one key for each band of
   minima. Texts with equal sets are one class from here on; its smallest id speaks for it.
2. Classes that share a band key are candidates. In each bucket every member is compared with one hub (the class with most copies),
   first by signature, then by the full sets; so a bucket of n members costs n comparisons.
3. The links found make components. A bucket whose members then lie in several components still has pairs that nobody has
   compared: its members are dealt in blocks, and blocks are compared with each other by exact set sizes. Only links that join two
   components leave a task.

So every pair that shares a band is compared or already connected. A pair at similarity s shares one of b bands of r minima with
probability 1 - (1 - s^r)^b: at 0.85 all but 1 of a million pairs, at 0.8 all but 1 of 14,000, with 24 bands of 5.
The signature check loses 3.1e-6 of the pairs at 0.85 and 1.6e-5 of those at 0.8 (binomial tail over 120 minima of 8 bits); with the
bands' own loss, at most 3.9e-6 and 8.8e-5 of the pairs are missed.

Defined results: a null text, an empty one or one without words has the empty set, is linked with nothing and kept. Of words fewer
than a shingle, the whole sequence is the one shingle. Rows that share an id are one document, linked if any of its texts is. A null
id is linked with nothing, has a null component and is kept. An empty table gives no rows. Other columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.catalogue import query, table
from tillsight.llm.components import connected_components
from tillsight.llm.text import Words, bound_batches, in_doc, mix64, repeated, run_hashes, slices, utf8
from tillsight.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

BANDS, ROWS = 24, 5
#: A block of members is compared with another one in one task: at most about so many members and shingles.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 200_000
#: Lists of ids are broadcast up to this length (16 MB), and joined by a shuffle beyond it; the result is the same.
BROADCAST_IDS = 1_000_000
#: A pair whose share of equal minima (8 bits each) is lower than the threshold by this much is not confirmed: over four deviations.
SIGNATURE_SLACK = 0.16
_random = np.random.RandomState(77)
_FACTORS = _random.randint(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.randint(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, in the order of texts: hash and text."""
    hashes, first = run_hashes(words.hash, words.doc, n)
    doc, counts = words.doc[first], words.counts
    for k in range(1, n):
        few, at = run_hashes(words.hash, words.doc, k)
        own = counts[words.doc[at]] == k
        if own.any():
            hashes, doc = np.concatenate([hashes, few[own]]), np.concatenate([doc, words.doc[at][own]])
    if len(doc) and (np.diff(doc) < 0).any():
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    _, later = repeated(in_doc(hashes, doc))
    return hashes[~later], doc[~later]


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text the smallest value of each universal hash (32 bits): a row for each hash."""
    out, work = np.empty((len(_FACTORS), len(starts)), np.uint32), np.empty_like(hashes)
    for k, (factor, offset) in enumerate(zip(_FACTORS, _OFFSETS, strict=True)):
        np.multiply(hashes, factor, out=work)
        np.add(work, offset, out=work)
        out[k] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band of each text: texts x bands."""
    keys = np.zeros((BANDS, least.shape[1]), np.uint64)
    for k in range(ROWS):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS].astype(np.uint64) + np.uint64(1)
    keys += np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
    return mix64(keys).T


def _sign(n: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            hashes, doc = shingles(Words(*utf8(part["text"]), fold=True), n)
            size = np.bincount(doc, minlength=part.num_rows)
            filled = np.flatnonzero(size)
            one, two = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
            bands = np.zeros((part.num_rows, BANDS), np.uint64)
            if len(filled):
                starts = np.concatenate([[0], np.cumsum(size[filled])[:-1]])
                one[filled] = np.add.reduceat(mix64(hashes), starts)
                two[filled] = np.add.reduceat(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
                bands[filled] = band_keys(minima(hashes, starts))
            offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1).view(np.int64)))],
                ["doc_id", "n_shingles", "set_one", "set_two", "bands"])

    return sign


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            hashes, doc = shingles(Words(*utf8(part["text"]), fold=True), n)
            size = np.bincount(doc, minlength=part.num_rows)
            ends = np.cumsum(size)
            filled = np.flatnonzero(size)
            if not len(filled):
                continue
            least = (minima(hashes, (ends - size)[filled]) & np.uint32(255)).astype(np.uint8).T
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].take(pa.array(filled)), pa.array([row.tobytes() for row in least], pa.binary()),
                 pa.array([np.sort(hashes[ends[k] - size[k]:ends[k]]).tobytes() for k in filled], pa.binary())],
                ["doc_id", "signature", "shingles"])

    return sets


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            columns = [batch[c] for c in ("signature", "hub_signature", "shingles", "hub_shingles")]
            for k in range(batch.num_rows):
                sign, hub_sign, own, hub = (c[k].as_buffer() for c in columns)
                equal = np.frombuffer(sign, np.uint8) == np.frombuffer(hub_sign, np.uint8)
                if 100 * equal.mean() < percent - 100 * SIGNATURE_SLACK:
                    continue
                own, hub = np.frombuffer(own, np.uint64), np.frombuffer(hub, np.uint64)
                both = len(np.intersect1d(own, hub, assume_unique=True))
                keep[k] = 100 * both >= percent * (len(own) + len(hub) - both)
            chosen = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch["a"].take(chosen), batch["b"].take(chosen)], ["a", "b"])

    return confirm


def block_links(component: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the components of a block's members, by exact set sizes: as few as connect them."""
    size, m = np.array([len(s) for s in sets]), len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    _, column, number = np.unique(values, return_inverse=True, return_counts=True)
    shared = number[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    both, width = np.zeros((m, m), np.float32), max(1, (16 << 20) // m)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = int(column[-1]) + 1 if len(column) else 0
    for left in range(0, total, width):
        a, b = np.searchsorted(column, [left, left + width])
        part = np.zeros((m, min(width, total - left)), np.float32)
        part[owner[a:b], column[a:b] - left] = 1
        both += part @ part.T
    near = 100 * both.astype(np.int64) >= percent * (size[:, None] + size[None, :] - both.astype(np.int64))
    near |= component[:, None] == component[None, :]
    np.fill_diagonal(near, True)
    a, b, free = [], [], np.ones(m, bool)
    while free.any():
        reached = np.zeros(m, bool)
        front = np.zeros(m, bool)
        front[np.argmax(free)] = True
        while front.any():
            reached |= front
            front = near[front].any(0) & ~reached
        free &= ~reached
        found = np.unique(component[reached])
        a.append(found[1:])
        b.append(np.full(len(found) - 1, found[0]))
    return np.concatenate(a), np.concatenate(b)


def _compare_blocks(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block pair."""
        key, held = None, []

        def finish():
            component = np.array([c for c, _ in held], np.int64)
            if len(held) < 2 or (component == component[0]).all():
                return None
            a, b = block_links(component, [s for _, s in held], percent)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

        for batch in batches:
            names = list(zip(*(batch[c].to_pylist() for c in ("key", "i", "j")), strict=True))
            for k, name in enumerate(names):
                if name != key:
                    if held and (out := finish()) is not None:
                        yield out
                    key, held = name, []
                held.append((batch["component"][k].as_py(), np.frombuffer(batch["shingles"][k].as_py(), np.uint64)))
        if held and (out := finish()) is not None:
            yield out

    return compare


def _with_ids(docs: DataFrame, ids: DataFrame, number: int, how: str = "left_semi") -> DataFrame:
    return docs.join(F.broadcast(ids) if number <= BROADCAST_IDS else ids, "doc_id", how)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: a row for each document.

    Documents are linked whose shingle sets have 100 x intersection >= ``percent`` x union.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    signed = cut_lineage(docs.mapInArrow(
        _sign(shingle_words), "doc_id long, n_shingles long, set_one long, set_two long, bands array<long>"))
    sets = ["n_shingles", "set_one", "set_two"]
    # Written first: so the large side of the join is not bound to the aggregate's partitions, and a hot class can be split.
    classes = cut_lineage(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*sets).agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    members = cut_lineage(signed.join(classes, sets, "left").select(
        "doc_id", "n_shingles", "bands", F.coalesce("copies", F.lit(1)).alias("copies"),
        F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("rep", "doc_id")).alias("rep")).withColumn(
        "bands", F.when(F.col("doc_id") == F.col("rep"), F.col("bands"))))

    # Buckets of classes with a common band key, and the hub of each: most copies, then by a hash.
    banded = members.where("bands IS NOT NULL").select("rep", "n_shingles", "copies", F.explode("bands").alias("key"))
    rank = F.shiftleft(F.least("copies", F.lit(1 << 22)), 40).bitwiseOR(F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1)))
    buckets = banded.groupBy("key").agg(F.max_by("rep", rank).alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(banded.select("key", "rep", "n_shingles").join(buckets, "key"))
    ids = cut_lineage(shared.select(F.col("rep").alias("doc_id")).distinct())
    number = ids.count()
    if not number:
        return _result(members, None)
    full = cut_lineage(_with_ids(docs.where("text IS NOT NULL"), ids, number).mapInArrow(
        _sets(shingle_words), "doc_id long, signature binary, shingles binary"))

    # Every member against its hubs.
    pairs = shared.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    sided = pairs.join(full.withColumnRenamed("doc_id", "a"), "a").join(
        full.select(F.col("doc_id").alias("b"), F.col("signature").alias("hub_signature"), F.col("shingles").alias("hub_shingles")),
        "b")
    links = sided.mapInArrow(_confirm(percent), "a long, b long")
    first = cut_lineage(connected_components(links))

    # What the hubs left open: buckets of three or more with members of several components.
    placed = shared.join(first, shared["rep"] == first["node"], "left").select(
        "key", "rep", "n", "n_shingles", F.coalesce("component", "rep").alias("component"))
    open_keys = placed.where("n > 2").groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n_shingles").alias("volume"),
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(rep))").alias("who")).where("low <> high")
    # Bands with the same members are one bucket.
    open_keys = open_keys.groupBy("who", "n", "volume").agg(F.min("key").alias("key")).select(
        "key", F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("volume") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = placed.select("key", "rep", "component").join(open_keys, "key").withColumn(
        "block", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "component")
    blocks = dealt.join(full.select(F.col("doc_id").alias("rep"), "shingles"), "rep").select("key", "i", "j", "component", "shingles")
    more = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        _compare_blocks(percent), "a long, b long")
    second = connected_components(more)
    final = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("merged")), "component", "left")
    final = final.select("node", F.coalesce("merged", "component").alias("component_id"))
    # Components of one class that only the second step linked.
    alone = second.join(first.select("node"), "node", "left_anti").select("node", F.col("component").alias("component_id"))
    return _result(members, final.unionAll(alone))


def _result(members: DataFrame, final: DataFrame | None) -> DataFrame:
    if final is not None:
        members = members.join(final, members["rep"] == final["node"], "left")
        component = F.coalesce("component_id", "rep", "doc_id")
    else:
        component = F.coalesce("rep", "doc_id")
    return members.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@query("op5_minhash")
def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), 3, 85)
