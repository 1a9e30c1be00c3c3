"""Whitening of embeddings: incremental eigendecomposition by rank-one updates, merged spectra, Rayleigh-Ritz refinement.

Entries become whole numbers x = floor(64 c) + 1,000,000 first, so counts and sums are exact and everything that follows is centred
without loss: n x - S is a whole number, and only its quotient by n is a double.

1. Each partition keeps a spectrum (rows, exact sums, eigenvalues, eigenvectors of its scatter) and applies centred rank-one
   updates: the eigenvalues of diag(d) + z z' are the roots of the secular equation 1 + sum z_i^2 / (d_i - t) = 0, found for
   all roots at once; entries without weight and equal eigenvalues are deflated first; eigenvectors come from a vector z that
   belongs exactly to the roots found. Equal vectors of a batch are one update of their weight, and a batch of more different vectors than
   dimensions is condensed by an orthogonal factorisation to as many rows of the same scatter: a vector costs no update of its own then.
2. Spectra of two partitions are combined by the same updates, one for each eigenvector of the other and one for the distance of the
   means. Combining goes on in rounds of ``FAN`` spectra until one is left: a spectrum has d^2 + 2 d numbers, however many rows it stands for.
3. Rayleigh-Ritz: with the exact sums of all rows, every partition projects its centred rows on the final basis and sums their
   products; the small matrix of these is diagonalised and turns the basis. What the updates left of rounding is gone, eigenvalues and
   vectors are those of the covariance to double precision.
4. Rows are projected on the leading components and divided by the roots of the eigenvalues; a pass over the result measures how far
   their covariance is from the identity.

The driver holds d x d numbers at most, so the dimension is bounded (``MAX_DIMENSIONS``); it holds no rows.

Defined results: rows whose vector is null, or has a null or non-finite entry, are dropped. Vectors of another length than the most
frequent one (ties: the longest) and vectors without entries are dropped, too. Repeated rows and rows that share an id or have none count
each. Components whose eigenvalue is zero to double precision have no whitened values and no rows: equal vectors, or a single one, give no rows. An
empty table gives no rows. An entry that no long can hold, or a deviation beyond a long, stops the job with an error: there is no exact
result to return. Other columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.catalogue import query, table, written
from tillsight.session import ship_with_tasks

ship_with_tasks(__name__)

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Spectra combined in one task of a round.
FAN = 8
MAX_DIMENSIONS = 4096
#: Rows of a batch that are worked on at once.
ROWS = 4096
_EPS = np.finfo(float).eps

SPECTRUM = "n long, sums array<long>, values array<double>, vectors binary"


# -- one spectrum

def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_i^2 / (d_i - t): d rises strictly, no z is zero. Returns the roots, the index of the end of its interval that each
    root is nearest to, and its distance from there (exact where the root itself is rounded)."""
    m = len(d)
    square = z * z
    upper = np.append(d[1:], d[-1] + square.sum())
    gap = upper - d
    # The sign in the middle tells which end is nearer; distances are counted from there.
    middle = 1 + (square / (d[None, :] - (d + gap / 2)[:, None])).sum(1)
    left = (middle >= 0) | (np.arange(m) == m - 1)
    origin = np.where(left, np.arange(m), np.minimum(np.arange(m) + 1, m - 1))
    delta = d[None, :] - d[origin][:, None]
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1]
    t = (low + high) / 2
    rows = np.arange(m)
    for _ in range(100):
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = square / (delta - t[:, None])
            value = 1 + parts.sum(1)
            # No double is nearer to the root than rounding in the equation tells.
            settled = np.abs(value) <= 16 * _EPS * (1 + np.abs(parts).sum(1))
            if settled.all():
                break
            low, high = np.where(value < 0, t, low), np.where(value >= 0, t, high)
            slope = parts / (delta - t[:, None])
            # A rational step: the pole at the origin is kept, the others are a line.
            own, own_slope = parts[rows, origin], slope[rows, origin]
            rest, rest_slope = value - own, slope.sum(1) - own_slope
            # weight / (0 - s) + rest + rest_slope (s - t) = 0
            weight = square[origin]
            b = rest - rest_slope * t
            root = np.sqrt(np.maximum(b * b + 4 * rest_slope * weight, 0))
            one = np.where(b >= 0, 2 * weight / (b + root), (root - b) / (2 * rest_slope))
            two = np.where(b >= 0, -(b + root) / (2 * rest_slope), 2 * weight / (b - root))
            step = np.where((one > low) & (one < high), one, two)
        outside = ~np.isfinite(step) | (step <= low) | (step >= high)
        step[outside] = (low[outside] + high[outside]) / 2
        t = np.where(settled, t, step)
    return d[origin] + t, origin, t


def _fitting(d: np.ndarray, z: np.ndarray, origin: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The vector whose secular equation has exactly these roots (signs as ``z``), so eigenvectors are orthogonal."""
    m = len(d)
    # root_j - d_i, without loss
    far = (d[origin] - d[:, None]) + distance[None, :]
    logs = np.log(np.abs(far)).sum(1)
    apart = d[None, :] - d[:, None]
    np.fill_diagonal(apart, 1.0)
    return np.copysign(np.exp((logs - np.log(np.abs(apart)).sum(1)) / 2), z) if m else z


def rank_one_update(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of vectors diag(values) vectors' + x x'."""
    z = vectors.T @ x
    scale = max(np.abs(values).max(initial=0.0), float(z @ z))
    if scale == 0.0:
        return values, vectors
    small = 8 * _EPS * scale
    norm = np.sqrt(z @ z)
    # Deflation: entries without weight stay as they are.
    on = np.abs(z) * norm > small
    values, vectors = values.copy(), vectors.copy()
    # Of equal eigenvalues only one keeps weight: a rotation in their plane moves it there.
    index = np.flatnonzero(on)
    for p, q in zip(index[:-1], index[1:], strict=True):
        r = np.hypot(z[p], z[q])
        c, s = z[q] / r, z[p] / r
        if abs((values[q] - values[p]) * c * s) <= small:
            vectors[:, [p, q]] = np.stack([c * vectors[:, p] - s * vectors[:, q], s * vectors[:, p] + c * vectors[:, q]], 1)
            values[p], values[q] = values[p] * c * c + values[q] * s * s, values[p] * s * s + values[q] * c * c
            z[p], z[q], on[p] = 0.0, r, False
    index = np.flatnonzero(on)
    if len(index):
        order = index[np.argsort(values[index], kind="stable")]
        d, w = values[order], z[order]
        roots, origin, distance = secular_roots(d, w)
        w = _fitting(d, w, origin, distance)
        far = (d[:, None] - d[origin][None, :]) - distance[None, :]
        turned = w[:, None] / far
        turned /= np.sqrt((turned * turned).sum(0))
        vectors[:, order] = vectors[:, order] @ turned
        values[order] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Rows, exact sums of their whole numbers, and the eigenpairs of their scatter about the mean."""

    def __init__(self, size: int):
        self.n, self.sums = 0, np.zeros(size, np.int64)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def update(self, x: np.ndarray) -> None:
        self.values, self.vectors = rank_one_update(self.values, self.vectors, x)

    def _meet(self, n: int, sums: np.ndarray) -> None:
        """The part of the scatter that the distance of two means makes."""
        if self.n and n:
            # (n S' - n' S) / (n n') is the distance; whole numbers up to the division.
            apart = exact_difference(self.n, sums, n, self.sums) / (float(self.n) * n)
            self.update(apart * np.sqrt(self.n / (self.n + n) * n))
        self.n, self.sums = self.n + n, self.sums + sums

    def add(self, rows: np.ndarray) -> None:
        """Adds rows of whole numbers."""
        different, times = np.unique(rows, axis=0, return_counts=True)
        n, sums = len(rows), rows.sum(0)
        if len(different) == 1:
            self._meet(n, sums)
            return
        centred = (different * n - sums) / n * np.sqrt(times)[:, None]
        if len(centred) > rows.shape[1]:
            centred = np.linalg.qr(centred, "r")
        for x in centred:
            self.update(x)
        self._meet(n, sums)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(np.sqrt(value) * vector)
        self._meet(other.n, other.sums)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([self.n]), pa.array([self.sums]), pa.array([self.values]), pa.array([self.vectors.tobytes()], pa.binary())],
            ["n", "sums", "values", "vectors"])

    @staticmethod
    def of(row: dict) -> Spectrum:
        out = Spectrum(len(row["sums"]))
        out.n, out.sums = row["n"], np.array(row["sums"], np.int64)
        out.values = np.array(row["values"], float)
        out.vectors = np.frombuffer(row["vectors"], float).reshape(len(out.sums), -1)
        return out


def exact_difference(n: int, x: np.ndarray, m: int, y: np.ndarray) -> np.ndarray:
    """n x - m y of whole numbers as doubles, rounded once."""
    top = max(n * (int(np.abs(x).max(initial=0)) + 1), m * (int(np.abs(y).max(initial=0)) + 1))
    if top < 1 << 62:
        return (x * n - y * m).astype(float)
    return np.array([float(n * int(a) - m * int(b)) for a, b in zip(x, y, strict=True)])


# -- rows of whole numbers

def _numbers(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    values = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    for k in range(0, len(values), ROWS):
        yield values[k:k + ROWS]


def whole_vectors(frame: DataFrame) -> DataFrame:
    """``vec_id, x``: vectors as whole numbers, without the rows that are dropped for their entries."""
    entry = F.col("embedding")
    number = lambda c: c.cast("double")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(number(c)) < float("inf")))
    # A long holds the scaled entry, or the job stops.
    whole = lambda c: F.when(F.abs(number(c)) < 2.0 ** 53, F.floor(number(c) * SCALE) + SHIFT).otherwise(
        F.raise_error(F.lit("op12: an entry is too large for whole numbers")).cast("long"))
    return frame.where(entry.isNotNull() & (F.size(entry) > 0)).where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(entry, whole).alias("x"))


def _spectra(size: int):
    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(size)
        for batch in batches:
            for rows in _numbers(batch, size):
                if len(rows):
                    own.add(rows)
        if own.n:
            yield own.batch()

    return spectra


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; each group becomes one spectrum."""
    group, own = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["slot"] != group:
                if own is not None:
                    yield own.batch()
                group, own = row["slot"], Spectrum.of(row)
            else:
                own.merge(Spectrum.of(row))
    if own is not None:
        yield own.batch()


def combined_spectrum(vectors: DataFrame, size: int) -> Spectrum | None:
    """The spectrum of all rows: one for each partition, then rounds of ``FAN`` until one is left."""
    spectra = written(vectors.select("x").mapInArrow(_spectra(size), SPECTRUM))
    number = spectra.count()
    while number > 1:
        groups = -(-number // FAN)
        # Slots of about FAN spectra each; which spectra meet does not matter.
        slot = F.pmod(F.xxhash64("n", "sums", "values"), F.lit(groups)).alias("slot")
        dealt = spectra.select(slot, "*").repartition(groups, "slot").sortWithinPartitions("slot")
        spectra = written(dealt.mapInArrow(_merge, SPECTRUM))
        left = spectra.count()
        if left == number:
            raise RuntimeError("spectra were not combined")
        number = left
    rows = spectra.collect()
    return Spectrum.of(rows[0].asDict()) if rows else None


def _products(n: int, sums: np.ndarray, basis: np.ndarray):
    """Sums of products of the projected centred rows: one row for each task and row of the matrix."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            for rows in _numbers(batch, basis.shape[0]):
                p = centred(rows, n, sums) @ basis
                total += p.T @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], ["i", "row"])

    return products


def centred(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, from whole numbers where they fit a long."""
    if n * (int(np.abs(rows).max(initial=0)) + 1) < 1 << 62:
        return (rows * n - sums) / n
    whole, rest = np.divmod(sums, n)
    return (rows - whole) - rest / n


def summed_products(vectors: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The matrix of products over all rows, summed in Spark entry by entry."""
    parts = vectors.select("x").mapInArrow(_products(n, sums, basis), "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((basis.shape[1], basis.shape[1]))
    for row in cells.collect():
        out[row["i"], row["j"]] = row["v"]
    return (out + out.T) / 2


def _whitened(n: int, sums: np.ndarray, maps: np.ndarray, explained: np.ndarray, error: float):
    k = maps.shape[1]

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for rows in _numbers(batch, maps.shape[0]):
                projected = centred(rows, n, sums) @ maps
                deviation = exact_deviation(rows, n, sums)
                ids = batch["vec_id"].slice(done, len(rows)).take(pa.array(np.repeat(np.arange(len(rows)), k)))
                done += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(ids), n)),
                     pa.array(np.repeat(deviation, k)), pa.array(projected.reshape(-1)), pa.array(np.tile(explained, len(rows))),
                     pa.array(np.full(len(ids), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whitened


def exact_deviation(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum of (n x - S)^2 of each row, exact; an error where a long does not hold it."""
    about = centred(rows, n, sums) * n
    most = np.abs(about).max(initial=0.0)
    if most < 2.0 ** 31 and (about * about).sum(1).max(initial=0.0) < 2.0 ** 62 and n * (int(np.abs(rows).max(initial=0)) + 1) < 1 << 62:
        whole = rows * n - sums
        return (whole * whole).sum(1)
    exact = [sum((n * int(x) - int(s)) ** 2 for x, s in zip(row, sums, strict=True)) for row in rows]
    if max(exact) >= 1 << 63:
        raise OverflowError("op12: a deviation is beyond a 64-bit number")
    return np.array(exact, np.int64)


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(frame: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row of ``frame`` (``vec_id, embedding``) and component; columns as in ``RESULT``."""
    spark = frame.sparkSession
    vectors = written(whole_vectors(frame))
    lengths = vectors.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], RESULT)
    size = lengths[0]["size"]
    if size > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {size} entries; {MAX_DIMENSIONS} is the most")
    vectors = vectors.where(F.size("x") == size)
    found = combined_spectrum(vectors, size)
    # Rayleigh-Ritz on the basis of the updates, all dimensions.
    basis, _ = np.linalg.qr(found.vectors)
    values, turn = np.linalg.eigh(summed_products(vectors, found.n, found.sums, basis) / found.n)
    order = np.argsort(-values, kind="stable")
    values, axes = values[order], basis @ turn[:, order]
    trace = values.sum()
    k = int((values[:components] > size * _EPS * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    if not k:
        return spark.createDataFrame([], RESULT)
    maps = axes[:, :k] / np.sqrt(values[:k])
    # The mean of the whitened rows is zero by the exact centring, so their products are their covariance.
    error = float(np.abs(summed_products(vectors, found.n, found.sums, maps) / found.n - np.eye(k)).max())
    return vectors.mapInArrow(_whitened(found.n, found.sums, maps, values[:k] / trace, error), RESULT)


@query("op12_whitening")
def op12(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
