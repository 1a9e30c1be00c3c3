import pytest

from tillsight.operators import relational
from tillsight.operators.cleaning import drop_bad_towns, keep_active


@pytest.mark.parametrize("hot_rows", [3, 40, 1000])
def test_salted_join_equals_the_plain_join(spark, hot_rows):
    many = spark.createDataFrame([(0 if i % 3 else i % 7, i) for i in range(200)], "k int, c int")
    few = spark.createDataFrame([(k, f"{k}/{i}") for k in range(8) for i in range(k + 1)], "k int, v string")
    salted = relational.salted_join(many, few, "k", "c", hot_rows)
    assert sorted(salted.select("k", "c", "v").collect()) == sorted(many.join(few, "k").select("k", "c", "v").collect())


def test_recommenders_do_not_change_with_salts(spark, monkeypatch):
    from tests.test_recommend import VISITS, fat, lists, wanted
    from tillsight.operators.recommend import ItemToItem, NearestCustomers, NeighbourToItem

    makers = [lambda: ItemToItem(min_visits=1), lambda: NearestCustomers(min_businesses=0, k=2),
              lambda: NeighbourToItem(min_businesses=0, k=2)]
    answers = lambda: [lists(m().fit(fat(spark, VISITS)).recommend(wanted(spark, 1, 2, 3, 4), 4)) for m in makers]
    plain = answers()
    monkeypatch.setattr(relational, "HOT_ROWS", 1)
    assert answers() == plain


def test_activity_is_counted_once_after_the_towns(spark):
    rows = [(1, "a", "BATH"), (1, "a", "BATH"), (2, "a", "BATH"), (2, "b", "LONDON SW"), (2, "b", "london")]
    df = spark.createDataFrame(rows, "masked_customer_id long, business_name string, business_town string")
    good = drop_bad_towns(df)
    assert good.count() == 4
    # Customer 2 keeps two rows, one of them at a business that falls out; the customer still counts as active.
    kept = keep_active(good, min_per_business=1, min_per_customer=1)
    assert sorted((r[0], r[1]) for r in kept.collect()) == [(1, "a"), (1, "a"), (2, "a")]


def test_differences_of_bags(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    right = spark.createDataFrame([(1,), (3,)], "v int")
    assert sorted(map(tuple, relational.same_rows(left, right).collect())) == [(1, "left"), (2, "left"), (3, "right")]


def test_salts_follow_the_joined_rows(spark):
    many = spark.createDataFrame([(k % 2, k) for k in range(200)], "key int, row int")
    few = spark.createDataFrame([(k % 3, k) for k in range(90)], "key int, other int")
    plain = sorted(map(tuple, many.join(few, "key").select("key", "row", "other").collect()))
    salted = relational.salted_join(many, few, "key", "row", hot_rows=1000, hot_result=100)
    assert sorted(map(tuple, salted.select("key", "row", "other").collect())) == plain


def test_clean_rollup_is_the_rollup_of_the_cleaned_rows(spark):
    from tillsight.plans.cleaning import clean, clean_rollup

    rows = [(k % 7, f"b{k % 5}", "LONDON" if k % 11 == 0 else "T", "P", float(k % 3), 1, "c") for k in range(300)]
    fat = spark.createDataFrame(rows, "masked_customer_id int, business_name string, business_town string, business_postcode string, "
                                      "amount double, day_of_week int, merchant_category_code string")
    for low, high in ((10, 5), (54, 38)):
        expected = relational.customer_business_rollup(clean(fat, low, high))
        assert sorted(map(tuple, clean_rollup(fat, low, high).collect())) == sorted(map(tuple, expected.collect()))
