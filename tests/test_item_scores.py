"""Scores of unseen items: a small matrix goes to every task, and the joined rows are added up without being sent."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tillsight.operators.recommend.items import score_unseen


@pytest.mark.parametrize("distinct", [False, True])
def test_small_matrix(spark, distinct):
    rng = random.Random(7)
    own = spark.createDataFrame(
        [(c, i, 1.0) for c in range(60) for i in rng.sample(range(20), c % 9)], "masked_customer_id long, item long, weight double")
    matrix = spark.createDataFrame(
        [(a, b, rng.randrange(1, 5) / 4) for a in range(18) for b in range(18) if a != b and (a + b) % 5], "item long, other long, score double")
    total = F.sum_distinct("part") if distinct else F.sum("part")
    best = lambda rows: score_unseen(own, matrix, own.select("masked_customer_id", "item"), 4, total, rows)
    sent, spread = best(None), best(0)
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, spread.collect())) != []
    by_pair = r"Exchange hashpartitioning\(masked_customer_id#\d+L?, item#"
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert re.search(by_pair, plan(spread)) and not re.search(by_pair, plan(sent))


def test_empty_tables(spark):
    own = spark.createDataFrame([], "masked_customer_id long, item long, weight double")
    matrix = spark.createDataFrame([], "item long, other long, score double")
    assert score_unseen(own, matrix, own.select("masked_customer_id", "item"), 4, F.sum("part")).count() == 0
