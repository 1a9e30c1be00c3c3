"""The approximate and the exact search for nearest profiles against brute force, with the pairs they compare."""

import random

import numpy as np
import pandas as pd
import pytest

from tillsight.operators import profile_blocks
from tillsight.operators.nearest_approx import MAX_GROUP, approximate, bucketed, recall
from tillsight.operators.nearest_exact import exact_lists
from tillsight.operators.neighbours import nearest_customers
from tillsight.session import cut_lineage

K = 4
SCHEMA = "masked_customer_id long, family string, key string, weight double"


def unstructured(count, seed=1, keys=6000, own=10):
    """A few dense keys in few mixtures, and sparse keys drawn from very many."""
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        visits = [rng.randrange(3) for _ in range(3)]
        rows += [(c, "day", str(d), visits.count(d) / 3) for d in set(visits)]
        rows += [(c, "business", str(b), 1 / own) for b in rng.sample(range(keys), own)]
    return rows


def clustered(count, seed=2):
    """Clusters of near profiles, one with a third of the customers, and some copies."""
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        group = 0 if c % 3 == 0 else 1 + c % 12
        own = random.Random(c if c % 7 else 3 * (c % 4))
        rows += [(c, "day", str((group + d) % 7), 1 / 7 + own.random() / 20) for d in range(1 + group % 7)]
        rows += [(c, "business", f"{group}/{b}", (0.05 + own.random() / 10) * (1 + group % 3)) for b in rng.sample(range(30), 8)]
    return rows


def brute_force(rows, k=K, least=3):
    count = 1 + max(r[0] for r in rows)
    vocabulary, businesses = {}, np.zeros(count)
    matrix = np.zeros((count, len({r[1:3] for r in rows})))
    for c, family, key, weight in rows:
        matrix[c, vocabulary.setdefault((family, key), len(vocabulary))] = weight
        businesses[c] += family == "business"
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    scores = np.round(matrix @ matrix.T, 9)
    np.fill_diagonal(scores, -1)
    scores[:, businesses <= least] = -1
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return scores, order


def found_of(near, count, k=K):
    out = np.full((count, k), -1)
    for r in near.collect():
        out[r["masked_customer_id"], r["rank"] - 1] = r["neighbour"]
    return out


@pytest.mark.parametrize("make,share", [(unstructured, 1 / 16), (clustered, 1 / 16), (clustered, 1.0), (clustered, 0.0)])
def test_exact_lists(spark, make, share):
    rows = make(400)
    features = spark.createDataFrame(rows, SCHEMA)
    near = nearest_customers(features, K, 3, search=exact_lists(approximate(2, 0), share=share, pivots=9))
    assert (found_of(near, 400) == brute_force(rows)[1]).all()


def test_exact_lists_compare_few_pairs(spark):
    count, rows = 4000, unstructured(4000)
    compared = spark.sparkContext.accumulator(0)
    near = nearest_customers(spark.createDataFrame(rows, SCHEMA), K, 3, search=exact_lists(compared=compared))
    assert (found_of(near, count) == brute_force(rows)[1]).all()
    assert compared.value < 0.4 * count ** 2


def test_approximate_is_near_linear_on_unstructured_data(spark):
    pairs = {}
    for count in (1000, 4000):
        compared = spark.sparkContext.accumulator(0)
        nearest_customers(spark.createDataFrame(unstructured(count), SCHEMA), K, 3, search=approximate(compared=compared)).collect()
        pairs[count] = compared.value
    assert pairs[4000] < 5 * pairs[1000]


def test_recall_on_clusters(spark):
    count, rows = 1200, clustered(1200)
    features = spark.createDataFrame(rows, SCHEMA)
    near = cut_lineage(nearest_customers(features, K, 3, search=approximate()))
    scores, order = brute_force(rows)
    found = found_of(near, count)
    # Scores are exact, and nearly as good as the best.
    for r in near.collect():
        assert r["similarity"] == pytest.approx(scores[r["masked_customer_id"], r["neighbour"]], abs=1e-9)
    assert np.mean([len(set(a) & set(b)) / K for a, b in zip(found.tolist(), order.tolist(), strict=True)]) > 0.9
    one = recall(near, near).first()
    assert one["queries"] == 24 and one["wanted"] == one["found"] == 24 * K


def test_groups_are_bounded(spark):
    """A third of the profiles on one side of all hyperplanes."""
    rows = [(f"p{k}", b, 0 if k % 3 == 0 else hash((k, b)) % (1 << 30)) for k in range(6000) for b in range(2)]
    groups = bucketed(spark.createDataFrame(rows, "profile string, band int, bits long"), 6000)
    sizes = [r["count"] for r in groups.groupBy("key", "slot").count().collect()]
    assert sum(sizes) == 12000 and max(sizes) <= MAX_GROUP


def test_odd_tables(spark):
    rows = clustered(30)
    empty = spark.createDataFrame([], SCHEMA)
    for search in (approximate(), exact_lists()):
        assert nearest_customers(empty, K, 3, search=search).count() == 0
        few = spark.createDataFrame([r for r in rows if r[0] < 3], SCHEMA)
        assert nearest_customers(few, 10, 0, search=search).count() == 6
        assert nearest_customers(few, 10, 99, search=search).count() == 0
    with pytest.raises(ValueError):
        approximate(0)


def crowded(count, seed=3):
    """Nearly all keys are dense, as in a table of few businesses; many similarities are equal."""
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        rows += [(c, "day", str(d), rng.choice((1, 2, 3)) / 7) for d in range(7)]
        rows += [(c, "business", str(b), 1 / 8) for b in rng.sample(range(16), 8)]
    return rows


def test_dense_profiles_are_sent_to_few_blocks(spark, monkeypatch):
    """All pairs by large blocks: rows sent grow with the table, not with the cells that each profile has to visit."""
    count, rows = 2500, crowded(2500)
    monkeypatch.setattr(profile_blocks, "_CHUNK_ROWS", 64)
    compared = spark.sparkContext.accumulator(0)
    near = cut_lineage(nearest_customers(spark.createDataFrame(rows, SCHEMA), K, 3, search=exact_lists(compared=compared)))
    assert (found_of(near, count) == brute_force(rows)[1]).all()
    assert compared.value == count ** 2


@pytest.mark.parametrize("levels,wanted", [(3, 1), (3, 5), (10 ** 9, 5), (1, 7), (2, 200)])
def test_best_of_block(monkeypatch, levels, wanted):
    """Ties go to earlier rows, over the borders of chunks as well."""
    monkeypatch.setattr(profile_blocks, "_CHUNK_ROWS", 24)
    rng = np.random.default_rng(4)
    left, right = (rng.integers(1, levels + 1, (n, 6)) / levels for n in (50, 130))
    features = lambda m: [np.arange(6, dtype=np.int64)] * len(m)
    row, column, value = profile_blocks.best_of_block(
        pd.DataFrame({"features": features(left), "weights": list(left)}),
        pd.DataFrame({"r_features": features(right), "r_weights": list(right)}), wanted)
    score = np.round(left @ right.T, 9)
    order = np.argsort(-score, axis=1, kind="stable")[:, :wanted]
    assert (row == np.repeat(np.arange(50), min(wanted, 130))).all() and (column == order.ravel()).all()
    assert (value == np.take_along_axis(score, order, axis=1).ravel()).all()
