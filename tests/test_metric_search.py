"""Range and nearest-n search for any distance against all pairs, and the refusal of what is no metric."""

import random

import numpy as np
import pytest

from tillsight.operators import metric_search as ms

BOX = "key long, x_start double, x_end double, y_start double, y_end double"


def boxes(count):
    rng = random.Random(1)
    made = []
    for k in range(count):
        own = random.Random(0 if k % 3 == 0 else k)
        x, y = own.gauss(0, 100), own.gauss(0, 100)
        made.append((k, x, x + own.expovariate(0.5), y, y + own.expovariate(0.5)))
    rng.shuffle(made)
    return made


def codes(count):
    rng = random.Random(2)
    return [(k, rng.choice("abc"), rng.randrange(4) or None, rng.choice(("x", "y", None)), rng.randrange(3)) for k in range(count)]


CASES = [(boxes, BOX, ms.box_gaps(["x", "y"]), 12.0), (boxes, BOX, ms.euclidean(["x_start", "y_start"]), 9.0),
         (codes, "key long, a string, b int, c string, d int", ms.weighted_hamming(["a", "b", "c", "d"], [1, 2, 0.5, 1]), 1.5)]


@pytest.mark.parametrize("make,schema,distance,radius", CASES)
def test_against_all_pairs(spark, make, schema, distance, radius):
    rows = make(240)
    frame = spark.createDataFrame(rows, schema)
    table = frame.toPandas().sort_values("key").reset_index(drop=True)
    scores = np.round(distance.block(table, table), 9)
    compared = spark.sparkContext.accumulator(0)
    found = {(r["key"], r["other"]): r["distance"] for r in ms.range_pairs(frame, "key", distance, radius, 20, compared).collect()}
    assert found == {(int(a), int(b)): scores[a, b] for a, b in zip(*np.nonzero(scores <= radius), strict=True)}
    for own in (True, False):
        near = ms.nearest_n(frame, "key", distance, 6, exclude_self=own, pivots=12).collect()
        got = {k: [] for k in range(240)}
        for r in sorted(near, key=lambda r: r["rank"]):
            got[r["key"]].append((r["distance"], r["other"]))
        assert got == {k: sorted((scores[k, o], o) for o in range(240) if o != k or not own)[:6] for k in range(240)}


def test_cells_are_ruled_out(spark):
    frame = spark.createDataFrame([r for r in boxes(2000) if r[0] % 3], BOX)
    for distance in (ms.box_gaps(["x", "y"]), ms.euclidean(["x_start", "y_start"])):
        compared = spark.sparkContext.accumulator(0)
        ms.range_pairs(frame, "key", distance, 5.0, 60, compared).count()
        assert compared.value < 0.3 * 1333 ** 2


def test_no_metric_is_refused(spark):
    frame = spark.createDataFrame(boxes(60), BOX)
    gaps = ms.box_gaps(["x", "y"])
    squared = ms.Distance("squared", ("x_start",), lambda a, b: ms.euclidean(["x_start"]).block(a, b) ** 2)
    skew = ms.Distance("one-sided", ("x_start",), lambda a, b: np.maximum(a["x_start"].to_numpy()[:, None] - b["x_start"].to_numpy()[None, :], 0))
    bare = ms.Distance("bare gap", gaps.columns, gaps.block)
    tight = ms.Distance("tight gap", gaps.columns, gaps.block, gaps.metric, lambda o: np.zeros(len(o)))
    for wrong in (squared, skew, bare, tight):
        with pytest.raises(ValueError, match="metric"):
            ms.range_pairs(frame, "key", wrong, 1.0)


def test_odd_tables(spark):
    none = spark.createDataFrame([], BOX)
    assert ms.range_pairs(none, "key", ms.box_gaps(["x", "y"]), 1.0).count() == 0
    assert ms.nearest_n(none, "key", ms.box_gaps(["x", "y"]), 3).count() == 0
    one = spark.createDataFrame(boxes(1), BOX)
    assert ms.nearest_n(one, "key", ms.euclidean(["x_start"]), 3).count() == 0
    assert ms.range_pairs(one, "key", ms.euclidean(["x_start"]), 0.0).count() == 1
