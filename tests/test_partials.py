"""Stored partial results and the placing of points, against plain computations over all rows."""

import math
import random
from fractions import Fraction

import pytest

from tillsight.operators import boxes, partials


@pytest.mark.parametrize("centre,spread", [(0.0, 5.0), (1e9, 1e-3), (-3e12, 0.5)])
def test_states_merge(spark, centre, spread):
    rng = random.Random(4)
    rows = [(k % 5, centre + rng.gauss(0, 1) * spread if k % 11 else None) for k in range(3000)] + [(9, None), (8, centre)]
    parts = [spark.createDataFrame(rows[i::4], "k int, v double") for i in range(4)]
    states = [partials.stat_states(p, "v", ["k"]) for p in parts]
    # In two steps and another order: merging may be repeated.
    first = partials.merge_states(states[2].unionByName(states[0]), ["k"])
    merged = partials.merge_states(states[3].unionByName(first).unionByName(states[1]), ["k"])
    found = {r["k"]: r for r in partials.state_statistics(merged, ["k"]).collect()}
    for k in (0, 1, 2, 3, 4, 8, 9):
        values = [Fraction(v) for c, v in rows if c == k and v is not None]
        r = found[k]
        assert r["count"] == len(values)
        if not values:
            assert math.isnan(r["mean"]) and math.isnan(r["min"]) and r["sum"] == 0
            continue
        mean = sum(values) / len(values)
        assert r["mean"] == pytest.approx(float(mean), rel=1e-15, abs=1e-12)
        assert (r["min"], r["max"]) == (float(min(values)), float(max(values)))
        if len(values) > 1:
            assert r["variance"] == pytest.approx(float(sum((v - mean) ** 2 for v in values) / (len(values) - 1)), rel=1e-6)
        else:
            assert math.isnan(r["variance"])


def test_states_without_keys_or_rows(spark):
    table = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    whole = partials.merge_states(partials.stat_states(table, "v").unionByName(partials.stat_states(table.limit(0), "v")))
    row = partials.state_statistics(whole).first()
    assert (row["count"], row["mean"], row["variance"]) == (2, 2.0, 2.0)
    none = partials.state_statistics(partials.merge_states(partials.stat_states(table.limit(0), "v"))).first()
    assert none["count"] == 0 and math.isnan(none["mean"])


def test_distinct_sketches_merge(spark):
    rows = [(k % 3, (k * 7919) % 4000) for k in range(20_000)] + [(5, None)]
    parts = [spark.createDataFrame(rows[i::3], "k int, v int") for i in range(3)]
    stored = [partials.distinct_states(p, [p["k"]], {"n": p["v"]}) for p in parts]
    merged = partials.merge_distinct(stored[0].unionByName(stored[1]).unionByName(stored[2]), ["n"])
    found = {r["_k0"]: r["n"] for r in partials.distinct_estimates(merged, ["n"]).collect()}
    for k in (0, 1, 2, 5):
        exact = len({v for c, v in rows if c == k and v is not None})
        assert abs(found[k] - exact) <= partials.sketch_error() * exact


def test_place_points(spark):
    rng = random.Random(7)
    point = lambda c: (c, f"g{c % 3 if c % 4 else 0}", *(int(rng.paretovariate(0.6)) * rng.choice((-1, 1)) for _ in range(4)))
    schema = "customer_id long, group_id string, balance long, age long, income long, gross_income long"
    customers = [point(c) for c in range(900)]
    fitted = spark.createDataFrame(customers[:450], schema)
    made = boxes.numeric_boxes(fitted, 7).cache()
    found = {r["customer_id"]: r for r in boxes.place_points(spark.createDataFrame(customers, schema), made).collect()}
    assert len(found) == 900
    held = [(r["group_id"], r["part"], [r["numerical_group"][f] for f in ("balance", "age", "income", "gross_income")]) for r in made.collect()]
    placed = 0
    for c, group, *values in customers:
        want = sorted(part for g, part, ranges in held if g == group and all(e["start"] <= v <= e["end"] for v, e in zip(values, ranges, strict=True)))
        assert found[c]["part"] == (want[0] if want else None)
        placed += bool(want)
    assert 450 <= placed < 900
    assert boxes.place_points(fitted.limit(0), made).count() == 0
    assert boxes.place_points(fitted, made.limit(0)).filter("part IS NULL").count() == 450
