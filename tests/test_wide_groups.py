"""The wide group goes into no sort by customer."""

import re

from pyspark.sql import functions as F

from tillsight.operators import profiles
from tillsight.plans.layout import staged_by_customer
from tillsight.sources import testtables as tt

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_layout_keeps_the_group_by_number(spark):
    fat = tt.event_fat(spark, SF)
    stored = staged_by_customer(fat, 3)
    text = lambda frame: sorted(map(str, frame.withColumn("ts", F.lit(0)).collect()))
    assert stored.columns == fat.columns and text(stored) == text(fat)
    written = re.search(r"fat_[0-9a-f]{32}", plan_of(stored)).group()
    assert "categorical_group" not in spark.table(written).columns


def test_pdfs_count_pairs_before_the_minimum(spark):
    """The first aggregate over the rows is a hash aggregate, with a count that the optimiser can't leave out."""
    first = plan_of(profiles.customer_pdfs(tt.event_fat(spark, SF)))
    assert "partial_min(group" in first and "partial_count(1)" in first
    assert re.search(r"HashAggregate\(keys=\[masked_customer_id#\d+L?, (_groupingexpression|group)#\d+\], functions=\[partial_count\(1\)", first)
