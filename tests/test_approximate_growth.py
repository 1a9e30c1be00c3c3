"""What the approximate search works out, compares and sends."""

import numpy as np
import pandas as pd
import pytest

from tillsight.operators import nearest_approx
from tillsight.operators.neighbours import nearest_customers, unit_profiles

SCHEMA = "masked_customer_id long, family string, key string, weight double"


def rows_of(count, own=6):
    rng = np.random.default_rng(5)
    return [(c, "business", str(b), float(w)) for c in range(count)
            for b, w in zip(rng.choice(20, own, False), rng.integers(1, 5, own), strict=True)]


def test_features_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = rows_of(60)
    features = spark.createDataFrame(rows, SCHEMA).mapInArrow(counted, SCHEMA)
    near = nearest_customers(features, 3, 2, search=nearest_approx.approximate(2, 1))
    assert near.count() == 180 and seen.value == len(rows)


def test_the_norm_is_not_worked_out_for_each_entry(spark):
    rows = [(1, "day", str(k), 0.1 * (k + 1)) for k in range(40)]
    found = unit_profiles(spark.createDataFrame(rows, SCHEMA), 0)
    assert "sqrt(aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    weights = np.array([r[3] for r in rows])
    assert sorted(found.first()["weights"]) == pytest.approx(sorted(weights / np.sqrt((weights ** 2).sum())), abs=1e-15)


def batch_of(count, able=3):
    rng = np.random.default_rng(7)
    features = [np.sort(rng.choice(15, 5, False)) for _ in range(count)]
    weights = [rng.integers(1, 3, 5) / 4 for _ in range(count)]
    first = pd.Series([None if k % able == 0 else 1000 - k for k in range(count)], dtype="float64")
    return pd.DataFrame({"profile": np.arange(count), "first_id": first, "reach": None, "features": features, "weights": weights})


@pytest.mark.parametrize("cells,reach", [(10 ** 6, None), (0, None), (10 ** 6, 0.5), (0, 0.5)])
def test_groups_of_a_batch(monkeypatch, cells, reach):
    """Dense matrices and blocks, ties by first id, nothing below the reach; the second group of a batch."""
    monkeypatch.setattr(nearest_approx, "_DENSE_CELLS", cells)
    batch, start, end, wanted = batch_of(40).assign(reach=reach), 11, 37, 4
    matrix = np.zeros((40, 15))
    for k in range(40):
        matrix[k, batch["features"][k]] = batch["weights"][k]
    expected = set()
    for k in range(start, end):
        others = [o for o in range(start, end) if o % 3]
        score = {o: round(float(matrix[k] @ matrix[o]), 9) for o in others}
        best = sorted(others, key=lambda o: (-score[o], 1000 - o))[:wanted]
        expected |= {(k, o, 1000 - o, score[o]) for o in best if reach is None or score[o] >= reach}
    found = [tuple(x) for part in nearest_approx.Groups(batch).best(start, end, wanted) for x in zip(*part, strict=True)]
    assert len(found) == len(expected) and {(int(p), int(o), int(f), round(float(s), 9)) for p, o, f, s in found} == expected


def test_a_round_sends_only_what_reaches_the_list(spark):
    rows = [(k, k, [1, 2 + k % 2], [0.6, 0.8]) for k in range(20)]
    folded = spark.createDataFrame(rows, "profile long, first_id long, features array<long>, weights array<double>")
    groups = spark.range(20).selectExpr("id div 10 AS key", "0 AS slot", "id AS profile")
    every = nearest_approx.group_search(groups, folded, 10)
    assert every.count() == 200
    near = nearest_approx._best_of(every, 5)
    again = nearest_approx.group_search(groups, folded.join(nearest_approx.reached(near, 5), "profile", "left"), 10)
    assert again.count() == 100 and {r["similarity"] for r in again.collect()} == {1.0}


def test_two_profiles_with_one_number(spark):
    rows = [("0123456789abcdef" + x, k, [k], [1.0]) for k, x in enumerate("ab")]
    folded = spark.createDataFrame(rows, "profile string, first_id long, features array<long>, weights array<double>")
    with pytest.raises(ValueError):
        nearest_approx.approximate(2, 0)(folded, 1)
