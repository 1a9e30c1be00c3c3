"""The layout by customer saves exchanges; the town list as a table gives what ``contains`` gives."""

import random
import re

from tillsight.operators import profiles
from tillsight.operators.cleaning import drop_listed_towns
from tillsight.operators.relational import customer_business_pairs, customer_business_rollup
from tillsight.plans import evaluation
from tillsight.plans.layout import staged_by_customer


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_layout_by_customer(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40) ** 2, rng.randrange(7), rng.choice("abc"), f"b{rng.randrange(9)}", f"t{rng.randrange(3)}",
             rng.choice((None, "AB1 2CD")), rng.random() * 9) for _ in range(2000)]
    schema = ("masked_customer_id long, day_of_week int, merchant_category_code string, business_name string, business_town string, "
              "business_postcode string, amount double")
    fat = spark.createDataFrame(rows, schema)
    stored = staged_by_customer(fat, 6)
    steps = [profiles.wallets, customer_business_rollup, customer_business_pairs, lambda t: evaluation.split(t)[1]]
    for step in steps:
        assert sorted(map(str, step(stored).collect())) == sorted(map(str, step(fat).collect()))
        assert not re.search(r"Exchange hashpartitioning\(masked_customer_id", plan_of(step(stored)))
    assert re.search(r"Exchange hashpartitioning\(masked_customer_id", plan_of(profiles.wallets(fat)))
    # Joined with a table of a customer each, only that table moves.
    train, test = evaluation.split(stored)
    recs = customer_business_pairs(train)
    joined = recs.join(customer_business_pairs(test).withColumnRenamed("business_name", "_n"), "masked_customer_id")
    assert not re.search(r"Exchange hashpartitioning\(masked_customer_id", plan_of(joined.hint("merge")))


def test_ten_thousand_literals(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ABCDEFGHIJ") for _ in range(n))
    towns = [word(rng.randint(0, 14)) for _ in range(1500)] + [None, "", "ÄÖ日本", "A%_"]
    literals = [word(rng.randint(5, 9)) for _ in range(10_000)] + ["%_", "日本", None, "Z"]
    frame = spark.createDataFrame([(t, k) for k, t in enumerate(towns)], "business_town string, k long")
    table = spark.createDataFrame([(x,) for x in literals], "literal string")
    kept = drop_listed_towns(frame, table)
    want = [k for k, t in enumerate(towns) if t is None or not any(x in t for x in literals if x is not None)]
    assert kept.columns == frame.columns and sorted(r["k"] for r in kept.collect()) == want
    assert len(want) < len(towns) - 20
    assert "NestedLoop" not in plan_of(kept) and "Cartesian" not in plan_of(kept)
    assert [r["k"] for r in drop_listed_towns(frame, spark.createDataFrame([("",)], "literal string")).collect()] == [1500]
    assert drop_listed_towns(frame, table.limit(0)).count() == len(towns)
