"""Near duplicates by SimHash: byte-position inverted index, count filtering, verification, connected components.

1. Each text becomes one 64-bit fingerprint: a bit is set if more than half of its word shingles (repeats included) have it set in
   their XXH64. Rows of one fingerprint are one entry from here on.
2. Fingerprints that differ in at most d bits have equal bytes in at least 8 - d of the eight positions: the guaranteed minimum of
   matches. The inverted index lists fingerprints by the bytes at several positions at once. A family of position sets, one of
   which avoids any d positions, makes sure that every pair to be found meets in a list.
3. A coarse index (four bytes a list) finds the fingerprints that share a list with any other; of random ones few do.
   Those go to the fine index, whose lists hold 8 - d bytes: the members of such a list share the guaranteed minimum. A list of
   the fine index has at most 2^(8 d) members, whatever the input is: 65,536 for two bits.
4. In each fine list the shared bytes of the members are tallied and pairs that reach the minimum are verified by their differing
   bits. What leaves a task are links that connect what is connected in the list: fewer than its members. Large lists are not
   compared pair by pair: their members look up the values that differ in the free bytes by up to d bits.
5. The links are closed by alternating large-star and small-star.

Nothing is lost: the index is exact for any two fingerprints within d bits.

Defined results: a null, empty or wordless text has fingerprint zero and is linked like any other. Of words fewer than a shingle, the
whole sequence is the one shingle. Rows that share an id are documents of their own. A null id takes part but names no component:
the component is the smallest id that is not null, or null. An empty table gives no rows. Other columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.catalogue import query, table, written
from tillsight.llm.components import connected_components
from tillsight.llm.text import FOLD, SPACE, bound_batches, slices, utf8
from tillsight.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

SHINGLE_WORDS, BITS, SEED = 3, 2, 42
#: A list of up to so many members is compared pair by pair, in one block of numbers; the result is the same beyond it.
PAIRWISE = 256
#: Shingles longer than this are hashed one by one.
LONG = 256

# The five primes of XXH64. Fixed values.
_P1, _P2, _P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_P4, _P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_BYTE_LANES = np.uint64(0x0101010101010101)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _rotated(state + value * np.uint64(_P2), 31) * np.uint64(_P1)


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many spans of the bytes, each step for all spans that have it."""
    # Room for a full word at the end.
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    halves = np.ndarray(len(data) - 3, "<u4", data, 0, (1,))
    size = (ends - starts).astype(np.int64)
    hashes, at = np.full(len(starts), (seed + _P5) % (1 << 64), np.uint64), starts.astype(np.int64)
    some = np.flatnonzero(size >= 32)
    if len(some):
        lanes = [np.full(len(some), x % (1 << 64), np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        for k in range(int(size[some].max()) // 32):
            on = np.flatnonzero(size[some] >= 32 * (k + 1))
            place = at[some[on]] + 32 * k
            for lane in range(4):
                lanes[lane][on] = _round(lanes[lane][on], words[place + 8 * lane])
        mixed = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
        for lane in lanes:
            mixed = (mixed ^ _round(np.zeros_like(lane), lane)) * np.uint64(_P1) + np.uint64(_P4)
        hashes[some] = mixed
        at[some] += size[some] // 32 * 32
    hashes += size.astype(np.uint64)
    left = starts + size - at
    for k in range(3):
        on = np.flatnonzero(left >= 8)
        if not len(on):
            break
        hashes[on] = _rotated(hashes[on] ^ _round(np.zeros(len(on), np.uint64), words[at[on]]), 27) * np.uint64(_P1) + np.uint64(_P4)
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    hashes[on] = _rotated(hashes[on] ^ halves[at[on]].astype(np.uint64) * np.uint64(_P1), 23) * np.uint64(_P2) + np.uint64(_P3)
    at[on] += 4
    left[on] -= 4
    for k in range(3):
        on = np.flatnonzero(left > k)
        hashes[on] = _rotated(hashes[on] ^ data[at[on] + k].astype(np.uint64) * np.uint64(_P5), 11) * np.uint64(_P1)
    hashes = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(_P2)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_P3)
    return hashes ^ (hashes >> np.uint64(32))


def shingle_spans(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with words joined by one space, and the spans of all shingles in them: start, end, text; in the order of texts."""
    data = FOLD[data]
    is_word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    ends_word = is_word & (np.append(~is_word[1:], True) | edge[1:])
    starts_word = is_word & (np.concatenate([[True], ~is_word[:-1]]) | edge[:-1])[:len(data)]
    # Each word keeps its bytes and is followed by one space.
    first, last = np.flatnonzero(starts_word), np.flatnonzero(ends_word)
    joined = np.full(int(is_word.sum()) + len(first), 32, np.uint8)
    # A word's own bytes lie behind as many spaces as there are words before it.
    inside = np.flatnonzero(is_word)
    number = np.cumsum(starts_word)[inside] - 1
    joined[np.arange(len(inside)) + number] = data[inside]
    sizes = last - first + 1
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    doc = np.searchsorted(offsets, first, "right") - 1
    count = np.bincount(doc, minlength=len(offsets) - 1)
    # The first word of a shingle, and its last: texts of fewer words have one shingle.
    word = np.arange(len(first))
    rest = (np.cumsum(count) - 1)[doc] - word
    head = (rest >= n - 1) | ((count[doc] < n) & (rest == count[doc] - 1))
    end = np.minimum(word + n - 1, word + rest)
    return joined, starts[head], ends[end[head]], doc[head]


def majority(hashes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """For each text the bits set in over half of its hashes; zero for a text without any. ``doc`` is in order."""
    out = np.zeros(docs, np.uint64)
    if not len(hashes):
        return out
    number = np.bincount(doc, minlength=docs)
    filled = np.flatnonzero(number)
    begins = (np.cumsum(number) - number)[filled]
    # Runs of at most 255 hashes of one text: eight counters fit the bytes of one number.
    index = np.arange(len(hashes)) - np.repeat(begins, number[filled])
    runs = np.flatnonzero(index % 255 == 0)
    owner = np.searchsorted(begins, runs, "right") - 1
    of = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    half = number[filled]
    found = np.zeros(len(filled), np.uint64)
    for low in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(low)) & _BYTE_LANES, runs)
        for byte in range(8):
            sums = np.add.reduceat(((lanes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64), of)
            found |= (2 * sums > half).astype(np.uint64) << np.uint64(8 * byte + low)
    out[filled] = found
    return out


def _signs(n: int, seed: int):
    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches, "text"):
            joined, starts, ends, doc = shingle_spans(*utf8(part["text"]), n)
            long = ends - starts > LONG
            hashes = np.zeros(len(starts), np.uint64)
            hashes[~long] = xxh64(joined, starts[~long], ends[~long], seed)
            for k in np.flatnonzero(long):
                hashes[k] = xxhash.xxh64_intdigest(joined[starts[k]:ends[k]].tobytes(), seed)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(majority(hashes, doc, part.num_rows).view(np.int64))], ["doc_id", "bits"])

    return signs


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, bits``: the fingerprint of each text as a signed 64-bit number."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_signs(shingle_words, seed), "doc_id long, bits long")


def position_sets(size: int, bits: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions, one of which avoids any ``bits`` positions; found greedily."""
    chosen, open_ = [], set(combinations(range(8), bits))
    options = list(combinations(range(8), size))
    while open_:
        best = max(options, key=lambda s: sum(not set(s) & set(bad) for bad in open_))
        chosen.append(best)
        open_ = {bad for bad in open_ if set(best) & set(bad)}
    return chosen


def _lists(rows: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """``list, bytes, bits``: a row for each list that a fingerprint is in."""
    masks = [sum(255 << (8 * p) for p in s) for s in sets]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    cells = F.array(*[F.struct(F.lit(k).alias("list"), F.col("bits").bitwiseAND(F.lit(signed(m)).cast("long")).alias("bytes"))
                      for k, m in enumerate(masks)])
    return rows.select("bits", F.inline(cells)).select("list", "bytes", "bits")


def _flips(free: np.ndarray, bits: int) -> list[np.ndarray]:
    """Numbers with 1 to ``bits`` of the free bits set."""
    return [np.bitwise_or.reduce(np.array(c, np.uint64)) for n in range(1, bits + 1) for c in combinations(free, n)]


def list_links(members: np.ndarray, shared: np.uint64, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``bits`` bits among the different members of one list, which share the bytes of a mask."""
    members = np.sort(members)
    if len(members) <= PAIRWISE:
        differ = members[:, None] ^ members[None, :]
        # The tally of shared bytes: a byte of the difference that is zero is a match.
        matches = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(2)
        a, b = np.nonzero(np.triu(matches >= 8 - bits, 1))
        near = np.bitwise_count(differ[a, b]) <= bits
        a, b = a[near], b[near]
    else:
        # Each member looks up the values that differ in the bytes it does not share.
        free = [np.uint64(1 << k) for k in range(64) if not int(shared) >> k & 1]
        a, b = [], []
        for flip in _flips(free, bits):
            wanted = members ^ flip
            place = np.minimum(np.searchsorted(members, wanted), len(members) - 1)
            hit = np.flatnonzero((members[place] == wanted) & (wanted > members))
            a.append(hit)
            b.append(place[hit])
        a, b = np.concatenate(a), np.concatenate(b)
    # Only a forest of the links leaves the task.
    root = np.arange(len(members))
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    tied = np.flatnonzero(root != np.arange(len(members)))
    return members[tied], members[root[tied]]


def _links(sets: list[tuple[int, ...]], bits: int):
    masks = [np.uint64(sum(255 << (8 * p) for p in s)) for s in sets]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by list and bytes; a list may go on in the next batch."""
        key, held = None, []

        def closed():
            members = np.concatenate(held) if held else np.zeros(0, np.uint64)
            if len(members) < 2:
                return None
            return list_links(members, masks[key[0]], bits)

        def out(found):
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            names, own = batch["list"].to_numpy(), batch["bytes"].to_numpy()
            values = batch["bits"].to_numpy().view(np.uint64)
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (own[1:] != own[:-1])) + 1
            found = []
            for start, end in zip(np.concatenate([[0], cuts]), np.append(cuts, len(names)), strict=True):
                if start == end:
                    continue
                name = (int(names[start]), int(own[start]))
                if name != key:
                    if (pair := closed()) is not None:
                        found.append(pair)
                    key, held = name, []
                held.append(values[start:end])
            if found:
                yield out(found)
        if held and (pair := closed()) is not None:
            yield out([pair])

    return links


def near_links(entries: DataFrame, bits: int) -> DataFrame:
    """Links ``a, b`` between different fingerprints ``bits`` that connect all pairs within so many bits."""
    coarse, fine = position_sets(4, bits), position_sets(8 - bits, bits)
    lists = _lists(entries, coarse)
    # Lists of one member are dropped before anything else is sent: only counts and hashes travel.
    many = lists.groupBy("list", "bytes").agg(F.count("*").alias("n")).where("n > 1").select("list", "bytes")
    candidates = cut_lineage(lists.join(many, ["list", "bytes"]).select("bits").distinct())
    dealt = _lists(candidates, fine).repartition("list", "bytes").sortWithinPartitions("list", "bytes")
    return dealt.mapInArrow(_links(fine, bits), "a long, b long")


def hex_digits(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def simhash_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint, component_id``: a row for each row of ``docs``.

    Documents are linked whose fingerprints differ in at most ``bits`` bits (0 to 3).
    """
    if not 0 <= bits <= 3:
        raise ValueError("bits must be from 0 to 3")
    signed = written(fingerprints(docs, shingle_words, seed))
    entries = cut_lineage(signed.groupBy("bits").agg(F.min("doc_id").alias("least")))
    if bits:
        parts = connected_components(near_links(entries.select("bits"), bits))
        placed = entries.join(parts, entries["bits"] == parts["node"], "left").select(
            "bits", "least", F.coalesce("component", "bits").alias("part"))
        least = placed.groupBy("part").agg(F.min("least").alias("component_id"))
        entries = cut_lineage(placed.select("bits", "part").join(least, "part").select("bits", "component_id"))
    else:
        entries = entries.withColumnRenamed("least", "component_id")
    return signed.join(entries, "bits").select("doc_id", hex_digits(F.col("bits")).alias("fingerprint"), "component_id")


@query("op13_simhash")
def op13(spark, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
