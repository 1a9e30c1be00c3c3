"""Exact repeats of long byte strings, by sampled suffixes sorted outside memory.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller id, or in the same document
further left. Sorting all suffixes by external induced sorting keeps twenty bytes and more on disk for each byte of text; here, as in
induced sorting, only a sample of suffixes is sorted, and the rest follow from their sampled neighbours:

1. In each window of 100 bytes the 24-byte string of the smallest hash is the window's anchor (equal windows have equal anchors at
   equal places). Windows with the same anchor form a run of starts. The sample is one tuple for each run: the anchor's
   hash, the hash of all bytes the run touches, short hashes of the 81 bytes that the windows of each quarter have in common, document,
   place.
2. Tuples are dealt by the anchor's hash and sorted. Of equal runs all but the first go. Runs with the same anchor but other
   neighbours have a common prefix and suffix with it: the quarters' hashes tell which of their windows can be equal at all.
3. Only these few windows are hashed whole and compared one by one.

Each task first folds what it holds: it sends on the first of equal runs or windows only. An anchor that many unequal runs of a task
share is not dealt by its hash, but goes to step 3 at once, so no key gathers more than a few rows from each task.

Defined results: a null text is empty, and nothing is removed from it. A row without an id keeps its text and is compared with nothing.
Rows that share an id are taken for one document: they do not remove each other's bytes, and what is removed of one is removed of
all. An empty table gives no rows. Other columns are left out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tillsight.llm.catalogue import query, table, written
from tillsight.llm.text import SpanHash, bound_batches, mix64, slices, utf8
from tillsight.session import ship_with_tasks

ship_with_tasks(__name__)

LENGTH, ANCHOR = 100, 24
#: The starts of an anchor's windows fall into four quarters; all windows of a quarter share so many bytes.
QUARTER = (LENGTH - ANCHOR) // 4
COMMON = LENGTH - QUARTER
#: Runs that a task folds at a time, and unequal runs of one anchor in a fold from which on it is compared window by window.
FOLD_ROWS, HOT_RUNS = 2_000_000, 64
#: Bytes of text for each partition of tuples.
PART_BYTES = 32 << 20
RUN, WINDOW, GONE, OPEN, HOT = 0, 1, 2, 3, 4
WINDOWS = "kind int, key long, doc_id long, at long"
SCHEMA = "kind int, key long, run long, sides long, doc_id long, at long"
_PLACE, _NONE, _BIG = np.uint64(0xFFFFFF), np.uint64(2**64 - 1), 0x9E3779B97F4A7C15


def anchors(data: np.ndarray, offsets: np.ndarray, span: SpanHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first start, number of starts and anchor (places in the slice) of each run of windows with one anchor."""
    m = len(data) - ANCHOR + 1
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    place = np.arange(m)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][doc]
    least = span(place, place + ANCHOR) & ~_PLACE | place.astype(np.uint64) & _PLACE
    least[place + ANCHOR > end[:m]] = _NONE
    width, have = LENGTH - ANCHOR + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:have - width], least[width - have:])
    start = np.flatnonzero(place[:len(least)] + LENGTH <= end[:len(least)])
    # The low bits name a place at or after the start, less than a window away.
    anchor = start + ((least[start] - start.astype(np.uint64)) & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))[:len(start)]
    number = np.diff(np.append(new, len(start)))
    return doc[start[new]], start[new], number, anchor[new]


def sides(span: SpanHash, data_end: np.ndarray, data_start: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """16 bits for each quarter of the starts: a hash of the bytes that all windows of the quarter share."""
    found = np.zeros(len(anchor), np.uint64)
    for k in range(4):
        start = np.maximum(anchor - k * QUARTER, data_start)
        common = span(start, np.minimum(anchor - k * QUARTER + COMMON, data_end))
        found |= (common >> np.uint64(48)) << np.uint64(16 * k)
    return found


def pack(start: np.ndarray, number: np.ndarray, anchor: np.ndarray | int = 0) -> np.ndarray:
    """First start, number of starts (below 128), and how far behind the first start the anchor lies."""
    return start << 14 | anchor << 7 | number


def batch(kind, key=None, run=None, side=None, doc=None, at=None) -> pa.RecordBatch:
    n = len(doc)
    column = lambda x: pa.array(np.zeros(n, np.int64) if x is None else x.view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.broadcast_to(np.int32(kind), n)), column(key), column(run), column(side), column(doc), column(at)],
        ["kind", "key", "run", "sides", "doc_id", "at"])


def first_of(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first row of each key, and of the rows that come strictly later."""
    order = np.lexsort((at, doc))
    order = order[np.argsort(key[order], kind="stable")]
    if not len(order):
        return order, order
    new = np.append(True, key[order][1:] != key[order][:-1])
    lead = order[new][np.cumsum(new) - 1]
    later = (doc[order] != doc[lead]) | (at[order] >> 14 != at[lead] >> 14)
    return order[new], order[~new & later]


def _fold(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    if held:
        key, run, side, doc, at = (np.concatenate(c) for c in zip(*held, strict=True))
        first, later = first_of(mix64(key + run * np.uint64(3)), doc, at)
        if len(later):
            yield batch(GONE, doc=doc[later], at=at[later])
        key, run, side, doc, at = (c[first] for c in (key, run, side, doc, at))
        _, which, number = np.unique(key, return_inverse=True, return_counts=True)
        hot = number[which] > HOT_RUNS
        if hot.any():
            names = np.unique(key[hot])
            # One row tells whoever gets this key that other runs of it are compared by windows.
            yield batch(HOT, key=names, doc=np.zeros(len(names), np.int64))
            yield batch(OPEN, doc=doc[hot], at=at[hot])
        cold = ~hot
        yield batch(RUN, key[cold], run[cold], side[cold], doc[cold], at[cold])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in slices(batches, "text", 1 << 20):
        data, offsets = utf8(part["text"])
        span = SpanHash(data)
        doc, start, number, anchor = anchors(data, offsets, span)
        if not len(doc):
            continue
        ids = part["doc_id"].to_numpy(zero_copy_only=False)
        begin, end = offsets[:-1][doc], offsets[1:][doc]
        run = mix64(span(start, start + number - 1 + LENGTH) + (anchor - start).astype(np.uint64) * np.uint64(_BIG))
        held.append((span(anchor, anchor + ANCHOR), run, sides(span, end, begin, anchor), ids[doc],
                     pack(start - begin, number, anchor - start)))
        size += len(doc)
        if size >= FOLD_ROWS:
            yield from _fold(held)
            held, size = [], 0
    yield from _fold(held)


def _resolve_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of the tuples: equal runs but the first are gone, runs with a neighbour in common stay open."""
    parts: dict[int, list[tuple[np.ndarray, ...]]] = {RUN: [], HOT: []}
    for part in batches:
        kind = part["kind"].to_numpy()
        for k in (GONE, OPEN):
            if (kind == k).any():
                yield part.filter(pa.array(kind == k))
        columns = [part[c].to_numpy() for c in ("key", "run", "sides", "doc_id", "at")]
        for k in (RUN, HOT):
            if (kind == k).any():
                parts[k].append(tuple(c[kind == k] for c in columns))
    if not parts[RUN]:
        return
    key, run, side, doc, at = (np.concatenate(c) for c in zip(*parts[RUN], strict=True))
    key, run, side = key.view(np.uint64), run.view(np.uint64), side.view(np.uint64)
    first, later = first_of(mix64(key + run * np.uint64(3)), doc, at)
    if len(later):
        yield batch(GONE, doc=doc[later], at=at[later])
    key, side, doc, at = key[first], side[first], doc[first], at[first]
    hot = np.concatenate([p[0] for p in parts[HOT]]).view(np.uint64) if parts[HOT] else np.zeros(0, np.uint64)
    # A window can only be equal to another if the bytes are that all windows of its quarter share.
    start, number, anchor = at >> 14, at & 127, (at >> 14) + (at >> 7 & 127)
    hot = np.isin(key, hot)
    for k in range(4):
        quarter = side >> np.uint64(16 * k) & np.uint64(0xFFFF)
        _, which, count = np.unique(mix64(key + quarter * np.uint64(_BIG)), return_inverse=True, return_counts=True)
        low = np.maximum(start, anchor - k * QUARTER - (QUARTER if k == 3 else QUARTER - 1))
        high = np.minimum(start + number - 1, anchor - k * QUARTER)
        shared = ((count[which] > 1) | hot) & (low <= high)
        if shared.any():
            yield batch(OPEN, doc=doc[shared], at=pack(low, high - low + 1)[shared])


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each window of the open runs; of equal ones in a task only the first is sent on."""
    held, size, names = [], 0, ["kind", "key", "doc_id", "at"]

    def fold():
        key, doc, at = (np.concatenate(c) for c in zip(*held, strict=True))
        first, later = first_of(key, doc, at)
        yield batch(WINDOW, key[first], doc=doc[first], at=at[first]).select(names)
        if len(later):
            yield batch(GONE, doc=doc[later], at=at[later]).select(names)

    for part in slices(batches, "text", 1 << 20):
        data, offsets = utf8(part["text"])
        span = SpanHash(data)
        runs = part["runs"]
        owner = np.repeat(np.arange(part.num_rows), np.diff(runs.offsets.to_numpy()))
        packed = runs.flatten().to_numpy()
        number = packed & 127
        row = np.repeat(np.arange(len(packed)), number)
        within = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        start, owner = (packed >> 14)[row] + within, owner[row]
        place = offsets[owner] + start
        held.append((span(place, place + LENGTH), part["doc_id"].to_numpy()[owner], pack(start, np.int64(1))))
        size += len(row)
        if size >= FOLD_ROWS:
            yield from fold()
            held, size = [], 0
    if held:
        yield from fold()


def _resolve_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for part in batches:
        kind = part["kind"].to_numpy()
        if (kind == GONE).any():
            yield part.filter(pa.array(kind == GONE)).select(["doc_id", "at"])
        held.append(tuple(part[c].to_numpy()[kind == WINDOW] for c in ("key", "doc_id", "at")))
    if held:
        key, doc, at = (np.concatenate(c) for c in zip(*held, strict=True))
        _, later = first_of(key, doc, at)
        yield pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array(at[later])], ["doc_id", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 1 << 20):
        data, offsets = utf8(part["text"])
        gone = part["gone"]
        counts = np.diff(gone.offsets.to_numpy())
        packed = gone.flatten().to_numpy()
        start = offsets[np.repeat(np.arange(part.num_rows), counts)] + (packed >> 14)
        cover = np.zeros(len(data) + LENGTH + 128, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + (packed & 127) - 1 + LENGTH, -1)
        removed = np.cumsum(cover)[:len(data)] > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = removed & (np.append(True, ~removed[:-1]) | edge[:-1]) if len(data) else removed
        sums = lambda mask: np.append(0, np.cumsum(mask))
        n_removed, n_spans = (np.diff(sums(m)[offsets]) for m in (removed, begins))
        kept = data[~removed].tobytes()
        bounds = offsets - sums(removed)[offsets]
        texts = [kept[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part["doc_id"], pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(n_spans),
             pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that stay) of every document."""
    bound_batches(docs.sparkSession)
    # No cast where none is needed: an alias would keep the two reads of the texts from being seen as one.
    doc_id = F.col("doc_id") if docs.schema["doc_id"].dataType == LongType() else F.col("doc_id").cast("long")
    docs = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    volume = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), volume // PART_BYTES)
    spread = F.when(F.col("kind").isin(RUN, HOT), F.col("key")).otherwise(F.xxhash64("doc_id", "at"))
    runs = written(known.mapInArrow(_sample, SCHEMA).repartition(parts, spread).mapInArrow(_resolve_runs, SCHEMA).select(
        "kind", "doc_id", "at"))
    lists = runs.where(F.col("kind") == OPEN).groupBy("doc_id").agg(F.collect_list("at").alias("runs"))
    # The open runs and what is gone meet the same texts: both joins read one exchange of them.
    opened = known.join(lists, "doc_id").mapInArrow(_open_windows, WINDOWS)
    spread = F.when(F.col("kind") == WINDOW, F.col("key")).otherwise(F.xxhash64("doc_id", "at"))
    later = opened.repartition(parts, spread).mapInArrow(_resolve_windows, "doc_id long, at long")
    gone = runs.where(F.col("kind") == GONE).select("doc_id", "at").unionAll(later)
    gone = gone.groupBy("doc_id").agg(F.collect_list("at").alias("gone"))
    none = F.array().cast("array<bigint>")
    rows = known.join(gone, "doc_id", "left").select("doc_id", "text", F.coalesce("gone", none).alias("gone")).unionAll(
        docs.where("doc_id IS NULL").select("doc_id", "text", none.alias("gone")))
    return rows.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


@query("op6_suffixes")
def op6(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")
