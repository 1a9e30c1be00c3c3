import random

import pytest
from pyspark.sql import functions as F

from tillsight.operators import anonymise
from tillsight.sources.schema import BUCKET_FIELDS, RAW_CUSTOMER

# The thirteen sample customers.
CUSTOMERS = {
    1: (1523869, None, 102, False, 0.0, 3692.0, "IG75", 8, "F", 5, None),
    2: (1521962, 0.0, 84, False, None, 0.0, "IG50", 28, "F", 2, None),
    3: (1510221, 0.0, 61, False, None, 26000.0, "IG62", 29, "M", 2, None),
    4: (1513282, 8.0, 60, False, 25769.8, 12000.0, "IG76", 26, "M", 2, 4),
    5: (1513283, 9.0, 60, False, 25769.8, 12000.0, "IG76", 26, "M", 2, 4),
    6: (1513284, 10.0, 60, False, 25769.8, 12000.0, "IG76", 26, "M", 2, 4),
    7: (1513285, 11.0, 60, False, 25769.8, 12000.0, "IG76", 26, "M", 2, 4),
    8: (1513274, 0.0, 50, False, None, 0.0, "IG14", 25, "M", None, 12),
    9: (1512441, 1593.0, 47, False, 0.0, 0.0, "IG45", 25, "F", 2, None),
    10: (1517788, 0.0, 44, False, None, 0.0, "IG14", 53, "F", 2, 15),
    11: (1518794, 6034.0, 86, True, 132447.0, 23000.0, "SL97", 3, "M", 5, None),
    12: (1512615, 0.0, 44, False, None, 0.0, "IG39", 25, "F", 2, None),
}


def text_of(number):
    c = CUSTOMERS[number]
    some = lambda v: "None" if v is None else f"Some({v})"
    return f"{str(c[3]).lower()},{c[7]},{c[8]},{some(c[9])},{some(c[10])}"


SEEDS = [text_of(n) for n in (3, 1, 2, 8, 9, 10, 11)]


def customers(spark, numbers):
    return spark.createDataFrame([CUSTOMERS[n] for n in numbers], RAW_CUSTOMER)


def groups(spark, numbers, k=3, **options):
    numbered = spark.createDataFrame([(CUSTOMERS[n][0], n) for n in numbers], "customer_id long, no int")
    done = anonymise.generalise_categories(customers(spark, numbers), k, strategy="greedy", seed_order=SEEDS, **options)
    rows = done.join(numbered, "customer_id").groupBy("group_id", "categorical_group.group_size").agg(
        F.sort_array(F.collect_list("no")).alias("no")).collect()
    return sorted((tuple(r["no"]), r["group_size"]) for r in rows)


def test_no_customers(spark):
    empty = spark.createDataFrame([], RAW_CUSTOMER)
    assert anonymise.generalise_categories(empty, 3).count() == 0


@pytest.mark.parametrize("numbers", [[1], [1, 2]])
def test_too_few(spark, numbers):
    with pytest.raises(ValueError):
        groups(spark, numbers)
    with pytest.raises(Exception, match="cannot be generalised"):
        anonymise.categorical_groups(customers(spark, numbers), 3, "rounds").collect()


def test_three(spark):
    assert groups(spark, [1, 2, 3]) == [((1, 2, 3), 3)]


def test_ten(spark):
    assert groups(spark, range(1, 11)) == [((1, 8, 10), 3), ((2, 3, 9), 3), ((4, 5, 6, 7), 4)]


def test_twelve(spark):
    assert groups(spark, range(1, 13)) == [((1, 2, 10), 3), ((3, 8, 9, 11, 12), 5), ((4, 5, 6, 7), 4)]


@pytest.mark.parametrize("strategy", ["greedy", "rounds"])
@pytest.mark.parametrize("k", [2, 5, 25])
def test_every_group_reaches_k(spark, strategy, k):
    draw = random.Random(k)
    rows = [(i, None, None, draw.random() < .5, None, 0.0, None, draw.choice([1, 1, 1, 2, 3, 9]), draw.choice("FM"),
             draw.choice([None, 1, 2]), draw.choice([None, 4, 5, 6, 7])) for i in range(400)]
    table = spark.createDataFrame(rows, RAW_CUSTOMER)
    placed = anonymise.categorical_groups(table, k, strategy)
    buckets = placed.collect()
    assert len({r["bucket"] for r in buckets}) == len(buckets) == table.select(*BUCKET_FIELDS).distinct().count()
    sizes = {r["group_id"]: r["categorical_group"]["group_size"] for r in buckets}
    assert min(sizes.values()) >= k and sum(sizes.values()) == 400
    members = {r["group_id"]: len(r["categorical_group"]["group"]) for r in buckets}
    assert sum(members.values()) == len(buckets)
    assert anonymise.undersized_groups(placed, k).count() == 0


def test_rounds_is_the_default_at_every_size(spark):
    table = customers(spark, range(1, 13))
    default = anonymise.categorical_groups(table, 3)
    rounds = anonymise.categorical_groups(table, 3, "rounds")
    assert sorted(default.collect()) == sorted(rounds.collect())
    with pytest.raises(ValueError):
        anonymise.categorical_groups(table, 3, "greedy", max_buckets=2)


def test_masked_ids_are_dense(spark):
    ids = anonymise.mask_ids(spark.createDataFrame([(i % 500 * 10 ** 10,) for i in range(2000)], "customer_id long"))
    assert sorted(r["masked_customer_id"] for r in ids.collect()) == list(range(500))
