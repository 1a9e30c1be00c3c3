"""The fat table is worked out once for all that is taken from it, and its wide group goes through no exchange."""

import random

from pyspark.sql import functions as F

from tillsight.operators import relational
from tillsight.plans import exploration
from tillsight.sources.schema import FAT_COLUMNS


def fat_rows(spark, rows=400):
    rng = random.Random(7)
    bucket = lambda: (rng.random() < 0.5, rng.randrange(4), rng.choice("FM"), rng.choice((None, 1)), rng.choice((None, 4)))
    groups = [([bucket() for _ in range(3)], k + 1) for k in range(4)]
    data = [(k % 40, groups[k % 40 % 4] if k % 40 else groups[k % 3], rng.randrange(10_000) / 100, rng.randrange(1, 8), rng.choice("abc"), f"b{rng.randrange(9)}",
             f"t{rng.randrange(3)}", rng.choice((None, "AB1 2CD"))) for k in range(rows)]
    schema = ("masked_customer_id long, categorical_group struct<group: array<struct<online_active: boolean, acorn_type_id: int, "
              "gender: string, marital_status_id: int, occupation_id: int>>, group_size: int>, amount double, day_of_week int, "
              "merchant_category_code string, business_name string, business_town string, business_postcode string")
    return spark.createDataFrame(data, schema).select(*FAT_COLUMNS)


def test_exploration_works_the_table_out_once(spark):
    fat = fat_rows(spark)
    read = spark.sparkContext.accumulator(0)

    def step(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    numbers = ["x05", "x07", "x17"]
    found = exploration.explore(fat.mapInArrow(step, fat.schema), numbers).collect()
    assert read.value == 400
    assert sorted(map(str, found)) == sorted(
        str(r) for n in numbers for r in exploration.statistic(fat, n).collect())


def test_groups_go_through_no_aggregate_by_customer(spark):
    fat = fat_rows(spark)
    rolled = relational.customer_business_rollup(fat)
    # Only the few different groups are sorted and joined: the aggregates by customer hold numbers in their place.
    plan = rolled._jdf.queryExecution().optimizedPlan().toString()
    assert "min(categorical_group" not in plan and "min(_place" in plan
    keys = ["masked_customer_id", "business_name", "business_town"]
    want = fat.groupBy(*keys).agg(F.min("categorical_group").alias("g"), F.count("*").cast("int").alias("v"))
    assert sorted(str(tuple(r)) for r in rolled.select(*keys, "categorical_group", "visits").collect()) == sorted(
        str(tuple(r)) for r in want.collect())
