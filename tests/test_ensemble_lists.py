"""The ensemble merges lists where they differ, and counts what its members share once."""

from pyspark.sql import functions as F

from tillsight.operators.recommend import Ensemble, ItemToItem, Popular, RandomOrder
from tillsight.operators.recommend import ensemble as module
from tillsight.operators.recommend.ensemble import merge_ranks
from tillsight.operators.similarity import conditional, tanimoto


def fat(spark):
    rows = [(c, f"b{(c * k) % 11}", f"t{(c * k) % 3}") for c in range(12) for k in range(1, 6) for _ in range(1 + (c + k) % 3)]
    return spark.createDataFrame(rows, "masked_customer_id long, business_name string, business_town string")


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_lists_are_those_of_merged_tables(spark):
    """Customers with places of their own, one without transactions, and a member that gives no popular list."""
    wanted = fat(spark).select("masked_customer_id").union(spark.range(100, 140).toDF("masked_customer_id"))
    members = [ItemToItem(conditional, 2), ItemToItem(tanimoto, 2), Popular()]
    for some in (members, [*members, RandomOrder("1")], [Popular()]):
        tables = [m.fit(fat(spark)).recommend(wanted, 4) for m in some]
        assert rows(Ensemble(some).fit(fat(spark)).recommend(wanted, 4)) == rows(merge_ranks(tables, 4).select(*tables[0].columns))


def test_customers_without_places_are_not_merged_one_by_one(spark, monkeypatch):
    merged, merge = [], module.merge_places
    monkeypatch.setattr(module, "merge_places", lambda places, n: merged.append(places) or merge(places, n))
    wanted = fat(spark).select("masked_customer_id").union(spark.range(100, 1100).toDF("masked_customer_id"))
    model = Ensemble([ItemToItem(conditional, 2), ItemToItem(tanimoto, 2), Popular()]).fit(fat(spark))
    assert model.recommend(wanted, 4).select("masked_customer_id").distinct().count() == 1012
    assert sum(p.count() for p in merged) <= 13 * 3 * 4
    # One pass over the transactions, one pairing of items.
    first, second = (m for m in model.models if hasattr(m, "matrix"))
    assert first.pairs is second.pairs and first.dictionary is second.dictionary
