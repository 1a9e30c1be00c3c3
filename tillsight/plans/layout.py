"""The fat table stored by customer: what is worked out per customer then needs no exchange."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from tillsight.operators.ranking import numbered_in_order
from tillsight.operators.relational import CUSTOMER
from tillsight.session import stage_path, stage_table

BUCKETS = 200
GROUP = "categorical_group"


def store_by_customer(fat: DataFrame, name: str, path: str | None = None, buckets: int = BUCKETS, mode: str = "error") -> DataFrame:
    """Write the table in ``buckets`` files by the customer's hash, sorted by customer, and return it as it is read again.

    Rows are dealt by the same hash first, so each bucket is one file and not one for each task. Wallets, the split, the roll-up and
    average precision group and join by customer: on this table they start without moving a row. Take as many buckets as tasks
    are wanted for it; a bucket should fit the memory of a task.
    """
    dealt = fat.repartition(buckets, CUSTOMER)
    writer = dealt.write.format("parquet").mode(mode).bucketBy(buckets, CUSTOMER).sortBy(CUSTOMER)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return fat.sparkSession.table(name)


def staged_by_customer(fat: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The same in the checkpoint folder, under a name of its own. The wide group, of which there are few, is stored once and joined to
    its number as the table is read, so no bucket is sorted with it."""
    name, path = f"fat_{uuid4().hex}", stage_path(fat.sparkSession)
    if GROUP not in fat.columns:
        return store_by_customer(fat, name, path, buckets)
    groups = stage_table(numbered_in_order(fat.select(GROUP).distinct(), [F.col(GROUP)], "_place"))
    numbered = fat.join(groups.withColumnRenamed(GROUP, "_group"), F.col(GROUP).eqNullSafe(F.col("_group"))).drop(GROUP, "_group")
    return store_by_customer(numbered, name, path, buckets).join(groups, "_place").select(*fat.columns)
