"""Words, lines and their hashes over Arrow batches of texts, with numpy.

A batch is worked on in slices of about ``SLICE_BYTES`` bytes of text, so that memory does not depend on the batch size; a
longer text is a slice of its own. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from tillsight.session import ship_with_tasks

ship_with_tasks(__name__)

SLICE_BYTES = 1 << 20

# White space as the word pattern [^\x20\x09-\x0D]+ has it.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
#: Primes of 31 bits and bases of the span hashes.
_FIELDS = ((2_147_483_647, 1_207_513_691), (2_147_483_629, 733_140_419))
_powers: dict[tuple[int, int], np.ndarray] = {}


#: Rows of an Arrow batch at most: texts are long, and a batch is held by the executor and by its Python worker.
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to so many rows; a smaller setting stays as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA3B195354A39B70D)
    x ^= x >> np.uint64(32)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, one after the other, and where each text starts (one entry more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``limit`` bytes of text."""
    limit = limit or SLICE_BYTES
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _power(prime: int, base: int, n: int) -> np.ndarray:
    """Powers 0 ... n - 1 of the base, modulo the prime."""
    have = _powers.get((prime, base))
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, SLICE_BYTES + 1):
            have = np.concatenate([have, _modulo(have * np.uint64(pow(base, len(have), prime)), prime)])
        if n <= 4 * SLICE_BYTES:
            _powers[prime, base] = have
    return have[:n]


def _modulo(x: np.ndarray, prime: int) -> np.ndarray:
    return x - x // np.uint64(prime) * np.uint64(prime)


class SpanHash:
    """Hashes of any spans of the bytes: equal bytes have equal hashes.

    Two polynomials modulo two primes of 31 bits: modulo a power of two, texts exist (Thue-Morse words) that agree for every base.
    """

    def __init__(self, data: np.ndarray):
        self.sums = []
        for prime, base in _FIELDS:
            terms = (data.astype(np.uint64) + np.uint64(1)) * _power(prime, base, len(data))
            # Terms have 40 bits; so many of them fit 64 bits without taking the modulus.
            if len(data) > 1 << 23:
                terms = _modulo(terms, prime)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        both = []
        for (prime, base), sums in zip(_FIELDS, self.sums, strict=True):
            inverse = _power(prime, pow(base, -1, prime), len(sums))
            both.append(_modulo(_modulo(sums[ends] - sums[starts], prime) * inverse[starts], prime))
        return mix64(mix64(both[0] << np.uint64(32) | both[1]) + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


class Words:
    """Words of all texts of a slice: ``starts``, ``ends`` (bytes), ``doc`` (index of the text), ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        self.data = FOLD[data] if fold else data
        self.offsets = offsets
        n = len(data)
        is_word = ~SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        edge = edge[:n]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1] | edge[1:]
        stops = is_word.copy()
        stops[:-1] &= ~is_word[1:] | edge[1:]
        self.is_word = is_word
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.spans = SpanHash(self.data)
        self.hash = self.spans(self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask has."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def run_hashes(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n entries of one text, and the position of each run's first entry."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor, total = _ODD, np.zeros(m, np.uint64)
    for k in range(n):
        total += hashes[k:m + k] * np.uint64(factor)
        factor = factor * _BASE % (1 << 64)
    first = np.flatnonzero(doc[:m] == doc[n - 1:])
    return mix64(total[first]), first


def in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of one text."""
    return mix64(hashes + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur more than once, and did it occur before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later
