import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillsight.operators.recommend import (Ensemble, ImplicitFactors, ItemToItem, NearestCustomers, NeighbourToItem,
                                           Popular, RandomOrder)
from tillsight.operators.recommend import products
from tillsight.operators.recommend.base import fill_up, pair_counts, popular_list
from tillsight.operators.recommend.ensemble import merge_ranks
from tillsight.operators.relational import CUSTOMER
from tillsight.operators.similarity import conditional, tanimoto
from tillsight.plans import evaluation

TX = f"{CUSTOMER} long, business_name string, business_town string"
REC = f"{CUSTOMER} long, rank int, business_name string, business_town string, score double"


def transactions(spark, rows):
    return spark.createDataFrame([(c, b, "t") for c, b in rows], TX)


def lists(recs):
    found = defaultdict(list)
    for r in sorted(recs.collect(), key=lambda r: (r[CUSTOMER], r["rank"])):
        found[r[CUSTOMER]].append(r["business_name"])
        assert r["rank"] == len(found[r[CUSTOMER]])
    return dict(found)


def wanted(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], f"{CUSTOMER} long")


VISITS = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "c"), (4, "d"), (4, "e")]


def test_filling_up_keeps_order_and_repeats_nothing(spark):
    tx = transactions(spark, VISITS)
    own = spark.createDataFrame([(1, 1, "c", "t", 2.0), (1, 2, "d", "t", 1.0)], REC)
    recs = fill_up(own, wanted(spark, 1, 9), popular_list(pair_counts(tx), 3), 4)
    # popular: a (3), b (2), c (2)
    assert lists(recs) == {1: ["c", "d", "a", "b"], 9: ["a", "b", "c"]}
    assert {r["score"] for r in recs.collect() if r["business_name"] == "a"} == {None}


def test_popular(spark):
    assert lists(Popular().fit(transactions(spark, VISITS * 2)).recommend(wanted(spark, 1, 9), 2)) == {1: ["a", "b"], 9: ["a", "b"]}


def test_random_leaves_out_known_businesses(spark):
    hot = [(0, f"b{i}") for i in range(57)]
    tx = transactions(spark, hot + [(1, f"b{i}") for i in range(0, 60, 7)] + [(2, "b58"), (2, "b59"), (2, "b57")])
    found = lists(RandomOrder("s").fit(tx).recommend(wanted(spark, 0, 1, 2, 3), 5))
    assert sorted(found[0]) == ["b57", "b58", "b59"] and all(len(found[c]) == 5 for c in (1, 2, 3))
    assert not set(found[1]) & {f"b{i}" for i in range(0, 60, 7)}
    order = lists(RandomOrder("s").fit(tx).recommend(wanted(spark, 3), 60))[3]
    assert found[2] == [b for b in order if b not in ("b57", "b58", "b59")][:5]


def brute_item_scores(rows, metric):
    by_item, by_customer = defaultdict(set), defaultdict(set)
    for c, b in rows:
        by_item[b].add(c)
        by_customer[c].add(b)
    scores = defaultdict(dict)
    for c, own in by_customer.items():
        for candidate in set(by_item) - own:
            parts = []
            for b in own:
                both = len(by_item[b] & by_item[candidate])
                if both:
                    parts.append(metric(len(by_item[b]), len(by_item[candidate]), both))
            if parts:
                scores[c][candidate] = parts
    return scores


@pytest.mark.parametrize("metric", [tanimoto, conditional])
@pytest.mark.parametrize("once", [False, True])
def test_item_to_item_against_brute_force(spark, metric, once):
    draw = random.Random(2)
    rows = sorted({(c, f"b{draw.randrange(12)}") for c in range(30) for _ in range(4)})
    model = ItemToItem(metric, 1, dedupe_equal_scores=once).fit(transactions(spark, rows))
    recs = model.recommend(wanted(spark, *range(30)), 4).filter("score is not null").collect()
    expected = brute_item_scores(rows, metric)
    for r in recs:
        parts = expected[r[CUSTOMER]][r["business_name"]]
        assert r["score"] == pytest.approx(sum(set(parts) if once else parts))
    for c, scores in expected.items():
        best = sorted((sum(set(p) if once else p) for p in scores.values()), reverse=True)[:4]
        assert sorted((r["score"] for r in recs if r[CUSTOMER] == c), reverse=True) == pytest.approx(best)


def test_min_visits_and_cold_start(spark):
    tx = transactions(spark, VISITS + [v for v in VISITS if v[0] < 3])
    found = lists(ItemToItem(tanimoto, 2).fit(tx).recommend(wanted(spark, 1, 3), 3))
    assert found == {1: ["c", "a", "b"], 3: ["a", "b", "c"]}  # 3 has no pair left and gets the popular ones


def test_rank_merge(spark):
    one = spark.createDataFrame([(1, 1, "a", "t", None), (1, 2, "b", "t", None), (1, 3, "c", "t", None)], REC)
    two = spark.createDataFrame([(1, 1, "c", "t", None), (1, 2, "d", "t", None), (1, 3, "a", "t", None)], REC)
    # a and c: 2 votes, 4 points each; b and d: 1 vote, 2 points each
    assert lists(merge_ranks([one, two], 3)) == {1: ["a", "c", "b"]}


def fat(spark, rows):
    group = F.expr("named_struct('group', array(named_struct('online_active', true, 'acorn_type_id', 1, 'gender', "
                   "if(masked_customer_id % 2 = 0, 'F', 'M'), 'marital_status_id', cast(null as int), 'occupation_id', 4)), 'group_size', 3)")
    return transactions(spark, rows).withColumns({
        "categorical_group": group, "day_of_week": F.lit(1), "merchant_category_code": F.lit("m"),
        "business_postcode": F.lit(None).cast("string")})


def test_nearest_customers_takes_over_the_neighbours_businesses(spark):
    rows = [(0, "a"), (0, "b"), (0, "x"), (2, "a"), (2, "b"), (2, "y"), (1, "p"), (1, "q"), (3, "p"), (3, "q"), (3, "z")]
    options = dict(min_businesses=1, max_businesses=10, precomputed=5, k=1)
    found = lists(NearestCustomers(**options).fit(fat(spark, rows)).recommend(wanted(spark, 0, 1, 2, 3), 1))
    assert found == {0: ["y"], 2: ["x"], 1: ["z"], 3: ["a"]}  # 3 knows all of 1's and falls back to the popular list
    literal = NearestCustomers(**options, compat=True).fit(fat(spark, rows)).recommend(wanted(spark, 0), 2)
    assert lists(literal) == {0: ["a", "b"]}


def test_neighbour_to_item_answers_everybody(spark):
    draw = random.Random(4)
    rows = sorted({(c, f"b{draw.randrange(15)}") for c in range(25) for _ in range(5)})
    model = NeighbourToItem(min_businesses=1, k=3).fit(fat(spark, rows))
    found = lists(model.recommend(wanted(spark, *range(26)), 6))
    assert all(len(found[c]) == 6 == len(set(found[c])) for c in range(26))


def test_factors_leave_out_known_businesses(spark, monkeypatch):
    monkeypatch.setattr(products, "FIRST_SLICE", 2)
    monkeypatch.setattr(products, "SLICE_GROWTH", 2)
    draw = random.Random(6)
    rows = sorted({(c * 10 ** 10, f"b{draw.randrange(30)}") for c in range(20) for _ in range(1 + c)})
    tx = transactions(spark, rows)
    recs = ImplicitFactors(rank=3, iterations=2, blocks=2).fit(tx).recommend(wanted(spark, 7, *{c for c, _ in rows}), 5)
    known = defaultdict(set)
    for c, b in rows:
        known[c].add(b)
    found = lists(recs)
    assert len(found) == 21 and all(len(b) == 5 for b in found.values())
    scored = recs.filter("score is not null").collect()
    assert len(scored) == 100 and all(r["business_name"] not in known[r[CUSTOMER]] for r in scored)


def test_average_precision_by_hand(spark):
    recs = spark.createDataFrame(
        [(1, i + 1, b, "t", None) for i, b in enumerate("abcd")] + [(2, 1, "z", "t", None), (3, 1, "a", "t", None)], REC)
    truth = transactions(spark, [(1, "a"), (1, "c"), (1, "c"), (1, "q"), (2, "y"), (4, "a")])
    got = {r[CUSTOMER]: r["average_precision"] for r in evaluation.average_precision(recs, truth, 4).collect()}
    assert got == {1: pytest.approx((1 + 2 / 3) / 3), 2: 0.0}
    assert evaluation.mean_average_precision(recs, truth, 2).first()["map"] == pytest.approx((1 / 2 + 0) / 2)
    assert evaluation.mean_average_precision(recs, truth.limit(0), 2).first()["map"] == 0.0


def test_split_keeps_pairs_together(spark):
    tx = transactions(spark, [(c, f"b{i}") for c in range(40) for i in range(10)] * 2)
    train, test = evaluation.split(tx, 0.8)
    pairs = lambda df: {(r[0], r[1]) for r in df.collect()}
    assert not pairs(train) & pairs(test) and train.count() + test.count() == 800
    assert 40 < len(pairs(test)) < 130


def test_checks_raise(spark):
    tx = transactions(spark, VISITS)
    with pytest.raises(ValueError, match="wrong number"):
        evaluation.evaluate(Popular(), tx, tx, n=50)
    scored = evaluation.evaluation_job(tx, "popular", n=2, training_fraction=0.5, partitions=1, recommenders={"popular": Popular()})
    assert scored.first()["recommender"] == "popular"
    problems = evaluation.output_problems(
        spark.createDataFrame([(1, 1, "a", "t", None), (5, 1, "a", "t", None)], REC), wanted(spark, 1, 2), 1)
    assert {(r[0], r[1]) for r in problems.collect()} == {(2, "no recommendations"), (5, "not requested")}


def test_standard_recommenders():
    assert list(evaluation.standard_recommenders()) == [
        "random", "conditional", "tanimoto", "nearest_customers", "neighbour_to_item", "factors", "ensemble"]


def test_ensemble_of_models(spark):
    tx = transactions(spark, VISITS)
    found = lists(Ensemble([Popular(), ItemToItem(conditional, 1)]).fit(tx).recommend(wanted(spark, 1, 9), 2))
    assert found[9] == ["a", "b"] and found[1][0] == "a"
