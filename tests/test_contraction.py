"""The nearest-group merge against the same rounds in plain Python, and what it promises."""

import hashlib
import random

import pytest

from tillsight.operators.anonymise import categorical_groups
from tillsight.operators.contraction import contract

FIELDS = ["online_active", "acorn_type_id", "gender", "marital_status_id", "occupation_id"]
SCHEMA = "bucket string, online_active boolean, acorn_type_id int, gender string, marital_status_id int, occupation_id int, n long"


def buckets(count, seed=1):
    rng = random.Random(seed)
    made = {}
    while len(made) < count:
        values = (rng.random() < 0.5, rng.randrange(6), rng.choice("MFX"), rng.choice((None, 1, 2, 3)), rng.choice((None, *range(7))))
        made[values] = rng.randint(1, 6)
    return [(f"b{i:03d}", *v, n) for i, (v, n) in enumerate(made.items())]


def heads(name, number):
    return hashlib.md5(f"{number}|{name}".encode()).hexdigest()[0] < "8"


def plain(rows, k):
    group = {r[0]: r[0] for r in rows}
    for number in range(200):
        size = {}
        for r in rows:
            size[group[r[0]]] = size.get(group[r[0]], 0) + r[6]
        if len(size) <= 1 or all(n >= k for n in size.values()):
            return group
        proposals = {}
        for g in sorted(size):
            if size[g] >= k:
                continue
            options = {}
            for a in rows:
                for b in rows:
                    if group[a[0]] == g != group[b[0]]:
                        away = max(1, sum(x != y for x, y in zip(a[1:6], b[1:6], strict=True)))
                        options[group[b[0]]] = min(away, options.get(group[b[0]], 9))
            away, _, target = min((d, size[t] >= k, t) for t, d in options.items())
            if not heads(g, number) and (size[target] >= k or heads(target, number)):
                proposals.setdefault(target, []).append((away, g))
        joins = {}
        for target, asking in proposals.items():
            reached = size[target]
            for _, g in sorted(asking):
                if size[target] >= k or reached < k:
                    joins[g] = target
                reached += size[g]
        group = {b: joins.get(g, g) for b, g in group.items()}
    raise AssertionError


@pytest.mark.parametrize("count,k", [(40, 5), (7, 100), (1, 3)])
def test_same_groups_as_in_plain_python(spark, count, k):
    rows = buckets(count)
    found = {r["bucket"]: r["grp"] for r in contract(spark.createDataFrame(rows, SCHEMA).repartition(3), FIELDS, k).collect()}
    assert found == plain(rows, k)
    if sum(r[6] for r in rows) >= k:
        sizes = {}
        for r in rows:
            sizes[found[r[0]]] = sizes.get(found[r[0]], 0) + r[6]
        assert min(sizes.values()) >= k


def customers(spark):
    rng = random.Random(3)
    rows = [(rng.random() < 0.8, min(int(rng.expovariate(0.7)), 5), rng.choice("MF"), rng.choice((None, 1, 2)),
             rng.choice((None, None, 1, 2, 3, 4))) for _ in range(400)]
    return spark.createDataFrame(rows, SCHEMA.split(", ", 1)[1].rsplit(", ", 1)[0])


def test_too_few_customers(spark):
    with pytest.raises(Exception, match="cannot be generalised"):
        categorical_groups(customers(spark).limit(5), 25, "nearest").collect()
    assert categorical_groups(customers(spark).limit(0), 25, "nearest").count() == 0
