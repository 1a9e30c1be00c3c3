"""Raking against plain numpy, targets as tables, and targets that cannot be met together."""

from random import Random

import numpy as np
import pytest

from tillsight.llm import mixing


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, tokens long")


def marginals(rows, key, value):
    sums: dict[str, float] = {}
    for r in rows:
        sums[r[key]] = sums.get(r[key], 0.0) + value(r)
    return sums


def test_sparse_cells_settle(spark):
    """Twenty sources in few of twenty languages each: more sweeps than thirty, and every marginal is met."""
    random = Random(3)
    rows = [(f"s{i}", f"l{j}", random.randrange(1, 1000)) for i in range(20) for j in range(20) if (j - i) % 20 < 6]
    cells = cells_of(spark, rows)
    # Targets that weights can meet: the marginals of other weights of the same cells.
    other = [(a, b, n * random.uniform(0.3, 3)) for a, b, n in rows]
    total, own = sum(n for *_, n in other), sum(n for *_, n in rows)
    goals = {d: {} for d in "ab"}
    for a, b, n in other:
        goals["a"][a] = goals["a"].get(a, 0) + n / total * own
        goals["b"][b] = goals["b"].get(b, 0) + n / total * own
    found = mixing.rake(cells, {d: spark.createDataFrame(list(g.items()), f"{d} string, goal double") for d, g in goals.items()}).collect()
    for d, goal in goals.items():
        for name, value in marginals(found, d, lambda r: r["tokens"] * r["factor"]).items():
            assert value == pytest.approx(goal[name], rel=1e-6)
    # Plain raking gives the same weights.
    table, keep = np.zeros((20, 20)), np.ones((20, 20))
    for a, b, n in rows:
        table[int(a[1:]), int(b[1:])] = n
    for _ in range(5000):
        keep *= (np.array([goals["a"][f"s{i}"] for i in range(20)]) / (table * keep).sum(1))[:, None]
        keep *= np.array([goals["b"][f"l{i}"] for i in range(20)]) / (table * keep).sum(0)
    for r in found:
        assert r["tokens"] * r["factor"] == pytest.approx(table[int(r["a"][1:]), int(r["b"][1:])] * keep[int(r["a"][1:]), int(r["b"][1:])], rel=1e-5)


def test_targets_that_contradict_each_other(spark):
    cells = cells_of(spark, [("s", "x", 10), ("t", "y", 30)])
    goals = {"a": spark.createDataFrame([("s", 20.0), ("t", 20.0)], "a string, goal double"),
             "b": spark.createDataFrame([("x", 15.0), ("y", 25.0)], "b string, goal double")}
    with pytest.raises(mixing.Unsettled):
        mixing.rake(cells, goals)
    with pytest.warns(UserWarning, match="targets of b are left out"):
        found = {r["a"]: r["tokens"] * r["factor"] for r in mixing.rake_in_order(cells, goals).collect()}
    assert found == pytest.approx({"s": 20, "t": 20})


def test_targets_as_tables(spark):
    docs = spark.createDataFrame(
        [(k, "word " * (k % 5 + 1), ["web", "book", None][k % 3], "en", k) for k in range(60)],
        "doc_id long, text string, source string, lang string, own long")
    shares = spark.createDataFrame([("web", 1.0), (None, 3.0), ("unseen", 9.0)], "category string, share double")
    found = mixing.mix(docs, shares={"source": shares}, budget=0.5).collect()
    kept = marginals(found, "_source", lambda r: r["_tokens"] * r["_weight"])
    assert kept == pytest.approx({"web": 45.0, "(none)": 135.0, "book": 0.0})
    clashing = docs.withColumnRenamed("own", "_prob")
    sample = mixing.sample_documents(clashing, shares={"source": shares})
    assert sample.columns == clashing.columns and {r["source"] for r in sample.collect()} == {"web", None}
    # Texts read once or twice: the same weights.
    key = lambda r: r["doc_id"]
    once = sorted(mixing.mix(docs, texts=False).select("doc_id", "_weight", "_kept").collect(), key=key)
    assert once == sorted(mixing.mix(docs).select("doc_id", "_weight", "_kept").collect(), key=key)
    with pytest.raises(ValueError, match="source"):
        mixing.mix(docs, shares={"source": shares.where("category = 'unseen'")})
