"""Shuffle files of written tables go."""

import os

from pyspark.sql import functions as F

from tillsight.llm.catalogue import written


def test_written_leaves_no_shuffle_files(spark):
    folders = [p for p in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for p in folders for _, _, names in os.walk(p) for f in names if f.startswith("shuffle_")}
    before, counted = files(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = written(counted)
    assert not files() - before and table.count() == 7
