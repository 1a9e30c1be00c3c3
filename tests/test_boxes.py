import random

import pytest
from pyspark.sql import functions as F

from tests.test_anonymise import customers
from tillsight.operators import boxes
from tillsight.sources.schema import BUCKET_FIELDS, NUMERIC_FIELDS, RAW_CUSTOMER

SCHEMA = "group_id string, balance long, age long, income long, gross_income long"


def ranges(spark, points, k=3):
    numbers = spark.createDataFrame([("g", *p) for p in points], SCHEMA)
    return [
        tuple((r["numerical_group"][f]["start"], r["numerical_group"][f]["end"]) for f in NUMERIC_FIELDS)
        + (r["numerical_group"]["group_size"],) for r in boxes.numeric_boxes(numbers, k).collect()]


def test_one_point(spark):
    assert ranges(spark, [(10, 25, 10000, 40000)]) == [((10, 10), (25, 25), (10000, 10000), (40000, 40000), 1)]


def test_three_points(spark):
    points = [(10, 25, 10, 40), (12, 20, 10, 20), (6, 20, 10, 30)]
    assert ranges(spark, points) == [((6, 12), (20, 25), (10, 10), (20, 40), 3)]


def test_four_points(spark):
    points = [(10, 25, 10, 40), (12, 20, 10, 20), (6, 20, 10, 30), (8, 20, 10, 80)]
    assert ranges(spark, points) == [((6, 12), (20, 25), (10, 10), (20, 80), 4)]


def points_table(spark, rows=600):
    draw = random.Random(5)
    # A third of the rows is one point, and one group holds most of the rest.
    data = [("a", 5, 30, 100, 100) if i % 3 == 0 else
            (draw.choice("aaab"), draw.randrange(-3000, 3000), draw.randrange(18, 80), draw.randrange(10 ** draw.randrange(1, 7)),
             draw.choice([-3, -2, 0, 7, 9])) for i in range(rows)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("axis_choice", ["unbalanced", "balanced"])
def test_levels_on_spark_equal_local_halving(spark, axis_choice):
    points = boxes.distinct_points(points_table(spark))
    local = boxes.halve_points(points, 4, axis_choice=axis_choice)
    spread = boxes.halve_points(points, 4, axis_choice=axis_choice, local_points=40)
    assert sorted(local.collect()) == sorted(spread.collect())
    assert local.select("part").distinct().count() > 2


def test_inner_limit(spark):
    points = boxes.distinct_points(points_table(spark))
    sizes = lambda **o: boxes.halve_points(points, 3, axis_choice="balanced", **o).groupBy("group_id", "part").count()
    assert sizes(inner_k=40).agg(F.min("count")).first()[0] >= 3
    assert sizes(inner_k=40).count() < sizes().count()


def test_middle_is_cut_toward_zero():
    import numpy as np
    middle = lambda *v: boxes._middle(np.array(v))
    assert [middle(1, 2), middle(-2, -1), middle(-3, 2), middle(1, 5, 9), middle(-7, 0)] == [1, -1, 0, 5, -3]


def test_generalise_covers_each_customer_once(spark):
    draw = random.Random(3)
    maybe = lambda v: None if draw.random() < 0.2 else v
    rows = [(i, maybe(draw.uniform(-500, 500)), maybe(draw.randrange(18, 90)), draw.random() < 0.5,
             maybe(draw.uniform(0, 9e4)), draw.uniform(0, 9e4), None, draw.randrange(3), draw.choice("FM"), 2, None)
            for i in range(300)]
    table = spark.createDataFrame(rows, RAW_CUSTOMER)
    done = boxes.generalise(table, k1=10, k2=3).join(table, "customer_id").collect()
    assert sorted(r["customer_id"] for r in done) == list(range(300))
    found = {}
    for r in done:
        found.setdefault((str(r["categorical_group"]), str(r["numerical_group"])), []).append(r)
        for field in NUMERIC_FIELDS:
            box = r["numerical_group"][field]
            if r[field] is not None:
                assert box["start"] <= r[field] + 0.5 and r[field] - 0.5 <= box["end"]
        bucket = tuple(r[f] for f in BUCKET_FIELDS)
        assert bucket in [tuple(b) for b in r["categorical_group"]["group"]]
    for members in found.values():
        assert len(members) == members[0]["numerical_group"]["group_size"]


def test_group_without_any_value_stops(spark):
    table = customers(spark, [2, 3, 10])  # none has an income
    with pytest.raises(Exception, match="no income"):
        boxes.generalise(table, k1=3, k2=1).collect()
