import random

import pytest
from pyspark.sql import functions as F

from tillsight.operators import ranking, statistics


def one(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def points(df):
    return [r["value"] for r in df.orderBy("point").collect()]


def test_hundred_bins_of_one_to_hundred(spark):
    values = [float(i) for i in range(1, 101)]
    assert points(ranking.percentile_bins(one(spark, values), "v", 100)) == values


@pytest.mark.parametrize("bins", [1, 3, 7, 250])
def test_bins_against_sorted_list(spark, bins):
    draw = random.Random(bins)
    # A third of the values is the same one, the tail is heavy.
    values = [1.25 if i % 3 == 0 else draw.choice([-1, 1]) * 10 ** draw.uniform(-3, 8) for i in range(997)]
    ordered, step = sorted(values), len(values) / bins
    assert points(ranking.percentile_bins(one(spark, values), "v", bins)) == [ordered[int(i * step)] for i in range(bins)]


@pytest.mark.parametrize("count", [1, 2, 5, 400])
def test_nearest_rank(spark, count):
    draw = random.Random(count)
    values = sorted(draw.choice([3, 3, 3, -draw.randrange(10 ** 6), draw.randrange(10 ** 12)]) for _ in range(count))
    got = points(ranking.order_statistics(one(spark, values, "long"), "v", 101, ranking.nearest_rank(101)))
    assert got == [values[max(1, -(-i * count // 100)) - 1] for i in range(101)]


@pytest.mark.parametrize("values", [[4.0], [1.0, 2.0], [5.0, 1.0, 9.0], [2.0, 2.0, 2.0, 8.5]])
def test_median(spark, values):
    ordered = sorted(values)
    middle = (ordered[(len(values) - 1) // 2] + ordered[len(values) // 2]) / 2
    assert ranking.exact_median(one(spark, values), "v").first()["median"] == middle


def test_top_n_settles_ties_by_key(spark):
    rows = [("c", "x", 1.0), ("c", "b", 2.0), ("c", "a", 2.0 + 1e-13), ("d", "z", 0.0)]
    top = ranking.top_n(spark.createDataFrame(rows, "c string, k string, s double"), ["c"], "s", 2, ["k"])
    assert sorted((r["c"], r["rank"], r["k"]) for r in top.collect()) == [("c", 1, "a"), ("c", 2, "b"), ("d", 1, "z")]


def test_extremes_with_and_without_ties(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "w", 3), ("b", "z", 2)], "k string, i string, v int")
    assert sorted(r["i"] for r in ranking.max_rows(df, ["k"], "v").collect()) == ["w", "y", "z"]
    assert sorted(r["i"] for r in ranking.min_rows(df, ["k"], "v").collect()) == ["x", "z"]
    assert sorted(r["i"] for r in ranking.max_rows(df, [], "v").collect()) == ["w", "y"]
    assert {r["k"]: r["i"] for r in ranking.arg_max(df, ["k"], "i", "v").collect()} == {"a": "w", "b": "z"}


def test_buckets_keep_the_order(spark):
    values = sorted({s * (2 ** b + d) for b in range(0, 62, 3) for d in (-1, 0, 1) for s in (-1, 1)})
    rows = one(spark, values, "long").select("v", ranking.magnitude_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    buckets = [r["b"] for r in rows]
    assert buckets == sorted(buckets)


def test_statistics_of_one_row_and_many(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0)], "k string, v double")
    got = {r["k"]: r for r in statistics.stat_counter(df, "v", ["k"]).collect()}
    assert got["a"]["variance"] != got["a"]["variance"] and got["a"]["mean"] == 2.0
    assert (got["b"]["count"], got["b"]["sum"], got["b"]["variance"], got["b"]["min"], got["b"]["max"]) == (2, 4.0, 2.0, 1.0, 3.0)
    assert got["b"]["stderr"] == pytest.approx(1.0)


def test_statistics_of_small_values_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", 0.001)] * 1000 + [("b", None)], "k string, v double")
    got = {r["k"]: r for r in statistics.stat_counter(df, "v", ["k"]).collect()}
    assert got["a"]["sum"] == pytest.approx(1.0) and got["a"]["mean"] == pytest.approx(0.001)
    assert (got["b"]["count"], got["b"]["sum"]) == (0, 0.0)
    assert all(got["b"][c] != got["b"][c] for c in ("mean", "variance", "stdev", "stderr", "min", "max"))
    assert statistics.stat_counter(df.limit(0), "v").first()["count"] == 0


def test_nan_is_the_largest_value(spark):
    df = one(spark, [1.0, 2.0, float("nan"), 3.0], "double")
    assert ranking.exact_median(df, "v").first()[0] == 2.5
    bins = [r["value"] for r in ranking.percentile_bins(df, "v", 4).orderBy("point").collect()]
    assert bins[:3] == [1.0, 2.0, 3.0] and bins[3] != bins[3]


def test_close_doubles_fall_into_many_buckets(spark, monkeypatch):
    df = spark.range(100_000).select((1 + F.col("id") / 5e8).alias("v"))
    bucket = ranking.even_bucket(df, "v")
    rows = df.select(bucket(F.col("v")).alias("b"), "v").groupBy("b").agg(F.count("*").alias("n"), F.min("v").alias("v")).orderBy("b").collect()
    assert len(rows) == 5 and max(r["n"] for r in rows) < 30_000
    assert [r["v"] for r in rows] == sorted(r["v"] for r in rows)
    assert ranking.exact_median(df, "v").first()[0] == pytest.approx(1 + 49_999.5 / 5e8)
