import random

import numpy as np
import pytest

from tillsight.operators.neighbours import nearest_customers

COUNT, K, MIN_BUSINESSES = 240, 4, 3


@pytest.fixture(scope="module")
def rows():
    """A third of the customers are copies of one profile, some more are copies of a few."""
    found = []
    for c in range(COUNT):
        own = random.Random(0 if c % 3 == 0 else c % 20 if c % 5 == 0 else c)
        shift = (c % 4) * 50 if c % 3 else 0
        for family, size in (("business", 40), ("day", 7), ("x", 3)):
            keys = sorted({own.randrange(size) + shift for _ in range(own.choice([2, 8]))})
            found += [(c, family, str(k), 1 / len(keys)) for k in keys]
    return found


def brute_force(rows, exclude_self):
    vocabulary, matrix, businesses = {}, np.zeros((COUNT, 1000)), np.zeros(COUNT)
    for c, family, key, weight in rows:
        matrix[c, vocabulary.setdefault((family, key), len(vocabulary))] = weight
        businesses[c] += family == "business"
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    scores = np.round(matrix @ matrix.T, 9)
    able = [o for o in range(COUNT) if businesses[o] > MIN_BUSINESSES]
    return {c: [o for _, o in sorted((-scores[c, o], o) for o in able if o != c or not exclude_self)[:K]]
            for c in range(COUNT)}


@pytest.mark.parametrize("pivots", [1, 6, 40])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_against_brute_force(spark, rows, pivots, exclude_self):
    features = spark.createDataFrame(rows, "masked_customer_id long, family string, key string, weight double")
    near = nearest_customers(features, K, MIN_BUSINESSES, exclude_self, pivots).collect()
    got = {c: [] for c in range(COUNT)}
    for r in sorted(near, key=lambda r: r["rank"]):
        got[r["masked_customer_id"]].append(r["neighbour"])
    assert got == brute_force(rows, exclude_self)


def test_fewer_candidates_than_asked_for(spark, rows):
    few = [r for r in rows if r[0] < 3]
    features = spark.createDataFrame(few, "masked_customer_id long, family string, key string, weight double")
    assert nearest_customers(features, 10, 0).count() == 6
