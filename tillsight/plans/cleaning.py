"""Cleaning of the fat table and its roll-up by customer and business."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillsight.operators.cleaning import BAD_TOWNS, drop_bad_towns, keep_active
from tillsight.operators.relational import CUSTOMER, rollup_of_parts, rollup_parts, semi_join
from tillsight.session import cut_lineage
from tillsight.sources.delimited import write_fat, write_rollup
from tillsight.sources.schema import BUSINESS_KEY


def clean(fat: DataFrame, min_per_business: int = 10, min_per_customer: int = 5,
          towns: Sequence[str] = BAD_TOWNS) -> DataFrame:
    """Rows outside the bad towns, of customers and businesses that are active on what is left."""
    return keep_active(drop_bad_towns(fat, towns), min_per_business, min_per_customer)


def clean_rollup(fat: DataFrame, min_per_business: int = 10, min_per_customer: int = 5,
                 towns: Sequence[str] = BAD_TOWNS) -> DataFrame:
    """The roll-up of the cleaned rows, with the filters after the aggregate.

    Both activity counts are sums over the roll-up's first aggregate, so the rows are shuffled once, by customer and business; the joins
    that follow have about one row per pair and no aggregate above them that would tie a hot key to one task.
    """
    parts, groups = rollup_parts(drop_bad_towns(fat, towns))
    # With groups the first aggregate is written already.
    parts = cut_lineage(parts) if groups is None else parts
    rows = F.sum("_n").alias("n")
    customers = parts.groupBy(CUSTOMER).agg(rows).filter(F.col("n") > min_per_customer)
    businesses = parts.groupBy(*BUSINESS_KEY).agg(rows).filter(F.col("n") > min_per_business)
    kept = semi_join(semi_join(parts, customers, [CUSTOMER]), businesses, BUSINESS_KEY).select(*parts.columns)
    return rollup_of_parts(kept, groups)


def cleaning_job(fat: DataFrame, output: str, rollup_output: str | None = None, min_per_business: int = 10,
                 min_per_customer: int = 5, towns: Sequence[str] = BAD_TOWNS, sep: str = "\t") -> None:
    cleaned = clean(fat, min_per_business, min_per_customer, towns)
    write_fat(cleaned, output, sep=sep)
    if rollup_output:
        write_rollup(clean_rollup(fat, min_per_business, min_per_customer, towns), rollup_output, sep=sep)
