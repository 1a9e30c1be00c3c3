"""Every named query against its SQL on the smallest tables, and what no plan may contain."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check_queries import compare, connect  # noqa: E402
from tillsight.catalogue.all import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    good, note = compare(spark, con, name, SF)
    assert good, note


# The factor model's own top-n search compares blocks of users and items with each other inside the library.
@pytest.mark.parametrize("name", [
    "fat_table", "cleaned_transactions", "item_tanimoto", "knn_customers", "rec_random", "rec_tanimoto",
    "range_similarity_hamming", "eda_x03", "customer_features"])
def test_no_cross_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
