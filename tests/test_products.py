"""The best items by inner product against all products and against the solver's own search."""

import numpy as np
import pytest
from pyspark.ml.recommendation import ALS

from tillsight.operators.recommend import products


def frames(spark, users, items, known):
    mine = spark.createDataFrame([(k, [float(x) for x in u], known.get(k, [])) for k, u in enumerate(users)],
                                 "user int, features array<float>, known array<int>")
    theirs = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(items)], "id int, features array<float>")
    return mine, theirs


def brute_force(users, items, known, n):
    scores = np.round(users.astype(np.float32).astype(float) @ items.astype(np.float32).astype(float).T, 9)
    for k, own in known.items():
        scores[k, own] = -np.inf
    return {k: [int(i) for i in np.lexsort((np.arange(len(items)), -row))[:n] if np.isfinite(row[i])] for k, row in enumerate(scores)}


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["user"], []).append(r["item"])
    return out


@pytest.mark.parametrize("first_slice", [16, 4096])
def test_top_products(spark, monkeypatch, first_slice):
    monkeypatch.setattr(products, "FIRST_SLICE", first_slice)
    monkeypatch.setattr(products, "BLOCK_ITEMS", 8)
    rng = np.random.default_rng(1)
    # Lengths that fall off, copies (ties) and a user and an item of nothing but zeros.
    items = rng.normal(size=(700, 5)) * rng.pareto(1.5, size=(700, 1))
    items[20:40] = items[20]
    items[50] = 0
    users = rng.normal(size=(300, 5))
    users[3] = 0
    known = {k: rng.choice(700, int(rng.integers(0, 60)), replace=False).tolist() for k in range(0, 300, 3)}
    known[7] = list(range(695))
    compared = spark.sparkContext.accumulator(0)
    found = products.top_products(*frames(spark, users, items, known), 9, compared)
    assert lists(found) == brute_force(users, items, known, 9)
    assert compared.value < 0.5 * 300 * 700


def test_odd_tables(spark):
    users, items = np.ones((2, 3)), np.ones((4, 3))
    mine, theirs = frames(spark, users, items, {1: [0, 1, 2, 3]})
    assert lists(products.top_products(mine, theirs, 9)) == {0: [0, 1, 2, 3]}
    assert products.top_products(mine, theirs.limit(0), 9).count() == 0
    assert products.top_products(mine.limit(0), theirs, 9).count() == 0


def test_same_lists_as_the_solver(spark):
    rng = np.random.default_rng(2)
    rows = [(int(u), int(i), float(r)) for u, i, r in zip(rng.integers(0, 60, 900), rng.zipf(1.4, 900) % 200, rng.integers(1, 5, 900), strict=True)]
    ratings = spark.createDataFrame(rows, "user int, item int, rating float").groupBy("user", "item").sum("rating").toDF("user", "item", "rating")
    model = ALS(rank=6, maxIter=3, implicitPrefs=True, seed=1, userCol="user", itemCol="item", ratingCol="rating").fit(ratings)
    theirs = {r["user"]: [(x["item"], x["rating"]) for x in r["recommendations"]] for r in model.recommendForAllUsers(8).collect()}
    none = model.userFactors.selectExpr("id AS user", "features", "CAST(array() AS array<int>) AS known")
    own = products.top_products(none, model.itemFactors, 8).collect()
    mine = {u: sorted(((r["rank"], r["item"], r["score"]) for r in own if r["user"] == u)) for u in theirs}
    for user, best in theirs.items():
        assert [s for _, _, s in mine[user]] == pytest.approx([s for _, s in best], abs=1e-5)
        # Lists differ only where two scores are equal in single precision.
        assert {i for _, i, s in mine[user] if s > best[-1][1] + 1e-5} == {i for i, s in best if s > best[-1][1] + 1e-5}
