import random
from collections import Counter
from itertools import combinations

import pytest

from tillsight.operators import similarity
from tillsight.operators.relational import CUSTOMER


@pytest.mark.parametrize("block", [2, 5, 256])
def test_co_occurrence_with_a_hot_customer(spark, block):
    draw = random.Random(block)
    # Customer 0 knows every item; the others know a few.
    pairs = {(0, i) for i in range(40)} | {(c, draw.randrange(40)) for c in range(1, 30) for _ in range(4)}
    expected = Counter()
    for c in range(30):
        expected.update(combinations(sorted(i for cc, i in pairs if cc == c), 2))
    table = spark.createDataFrame(sorted(pairs), f"{CUSTOMER} long, item long")
    got = similarity.co_occurrence(table, block).collect()
    assert {(r["item"], r["other"]): r["n12"] for r in got} == dict(expected) and len(got) == len(expected)


def test_both_directions_of_a_metric(spark):
    pairs = spark.createDataFrame(
        [(1, "a", "t"), (2, "a", "t"), (3, "a", "t"), (1, "b", "t"), (4, "c", "t")],
        f"{CUSTOMER} long, business_name string, business_town string")
    matrix = lambda m: {(r["business_name"], r["similar_name"]): r["score"]
                        for r in similarity.item_matrix(pairs, m).collect()}
    assert matrix(similarity.tanimoto) == {("a", "b"): 1 / 3, ("b", "a"): 1 / 3}
    assert matrix(similarity.conditional) == {("a", "b"): 1.0, ("b", "a"): 1 / 3}


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
def test_hamming_range(spark, radius):
    draw = random.Random(radius)
    fields = ["a", "b", "c", "d", "e"]
    rows = sorted({tuple(draw.choice([None, "x", "y"]) for _ in fields) for _ in range(60)}, key=str)
    keyed = [(i, *r) for i, r in enumerate(rows)]
    table = spark.createDataFrame(keyed, "k int, " + ", ".join(f"{f} string" for f in fields))
    expected = sorted(
        (i, j, d) for i, *x in keyed for j, *y in keyed if (d := sum(p != q for p, q in zip(x, y))) <= radius)
    assert sorted(map(tuple, similarity.hamming_range_pairs(table, fields, "k", radius).collect())) == expected


def test_radius_of_all_fields_is_all_pairs(spark):
    df = spark.createDataFrame([(k, k % 2, None if k % 3 else k % 5) for k in range(30)], "id int, a int, b int")
    assert similarity.hamming_range_pairs(df, ["a", "b"], "id", 2).count() == 900
    with pytest.raises(ValueError):
        similarity.hamming_range_pairs(df, ["a", "b"], "id", 3)
