"""Item-to-item recommender with any similarity of (customers, customers, shared customers)."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tillsight.operators.ranking import top_n
from tillsight.operators.recommend.base import RECOMMENDATION, fill_up, popular_list, requested, visit_counts
from tillsight.operators.relational import CUSTOMER, salted_join
from tillsight.operators.similarity import Metric, item_dictionary, scored_both_ways, shared_customers, tanimoto, with_item_ids
from tillsight.session import cut_lineage, stage_table
from tillsight.sources.schema import BUSINESS_KEY


# A matrix of at most so many rows goes to every task, and a task then joins about so many rows.
MATRIX_ROWS, TASK_ROWS = 500_000, 20_000_000


def score_unseen(sources: DataFrame, matrix: DataFrame, seen: DataFrame, n: int, total: Column,
                 matrix_rows: int | None = None) -> DataFrame:
    """Best ``n`` items per customer by the total of ``weight * score`` over the customer's source items.

    ``sources`` is ``(customer, item, weight)``, ``matrix`` is ``(item, other, score)``. The seen items go into the
    same aggregate as a marker, so leaving them out costs no join of its own. With a matrix of at most ``matrix_rows`` rows customers are
    dealt over tasks before the join, and its rows, far more than the sources, are added up where they arise.
    """
    size = matrix.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("item").alias("items")).first()
    small = size["rows"] <= (MATRIX_ROWS if matrix_rows is None else matrix_rows)
    if small:
        joined = sources.count() * size["rows"] / max(size["items"], 1)
        tasks = max(sources.sparkSession.sparkContext.defaultParallelism, math.ceil(joined / TASK_ROWS))
        sources, seen = sources.repartition(tasks, CUSTOMER), seen.repartition(tasks, CUSTOMER)
    pairs = sources.join(F.broadcast(matrix), "item") if small else salted_join(sources, matrix, "item", CUSTOMER)
    part = pairs.select(
        CUSTOMER, F.col("other").alias("item"), (F.col("weight") * F.col("score")).alias("part"),
        F.lit(False).alias("seen"))
    marker = seen.select(CUSTOMER, "item", F.lit(None).cast("double").alias("part"), F.lit(True).alias("seen"))
    scored = part.unionByName(marker).groupBy(CUSTOMER, "item").agg(total.alias("score"), F.max("seen").alias("seen"))
    return top_n(scored.filter(~F.col("seen")).drop("seen"), [CUSTOMER], "score", n, ["item"])


def name_items(ranked: DataFrame, dictionary: DataFrame) -> DataFrame:
    return ranked.join(dictionary.select("item", *BUSINESS_KEY), "item").select(*RECOMMENDATION)


class ItemCounts(NamedTuple):
    """What item recommenders of one ``min_visits`` share: pairs, businesses with their customers, and ``shared_customers``."""

    pairs: DataFrame
    dictionary: DataFrame
    shared: DataFrame


def item_counts(visits: DataFrame, min_visits: int) -> ItemCounts:
    # Everything below reads the pairs, so they are taken from the transactions once and kept.
    pairs = cut_lineage(with_item_ids(visits.filter(F.col("visits") >= min_visits).select(CUSTOMER, *BUSINESS_KEY)))
    dictionary = cut_lineage(item_dictionary(pairs))
    return ItemCounts(pairs, dictionary, shared_customers(pairs, dictionary))


class ItemToItem:
    """Sum of the similarities between the customer's businesses and a candidate.

    ``min_visits`` rows make a pair count. With ``dedupe_equal_scores`` equal similarities from different own businesses
    count once.
    """

    def __init__(self, metric: Metric = tanimoto, min_visits: int = 5, dedupe_equal_scores: bool = False):
        self.metric, self.min_visits, self.dedupe_equal_scores = metric, min_visits, dedupe_equal_scores

    def fit(self, transactions: DataFrame) -> ItemToItemModel:
        return self.fit_visits(visit_counts(transactions))

    def fit_visits(self, visits: DataFrame) -> ItemToItemModel:
        return self.fit_counts(item_counts(visits, self.min_visits))

    def fit_counts(self, counts: ItemCounts) -> ItemToItemModel:
        # The matrix is the model: written once, it is counted and joined without pairing the items again.
        matrix = stage_table(scored_both_ways(counts.shared, self.metric))
        return ItemToItemModel(counts.pairs, counts.dictionary, matrix, self.dedupe_equal_scores)


class ItemToItemModel:
    """``matrix`` is ``(item, other, score)``."""

    def __init__(self, pairs: DataFrame, dictionary: DataFrame, matrix: DataFrame, dedupe_equal_scores: bool):
        self.pairs, self.dictionary, self.matrix = pairs, dictionary, matrix
        self.dedupe_equal_scores = dedupe_equal_scores

    def recommend(self, customers: DataFrame, n: int) -> DataFrame:
        own, popular = self.own_and_popular(customers, n)
        return fill_up(own, customers, popular, n)

    def own_and_popular(self, customers: DataFrame, n: int) -> tuple[DataFrame, Column]:
        own = self.pairs.select(CUSTOMER, "item").join(requested(customers), CUSTOMER, "left_semi")
        total = F.sum_distinct("part") if self.dedupe_equal_scores else F.sum("part")
        ranked = score_unseen(own.withColumn("weight", F.lit(1.0)), self.matrix, own, n, total)
        return name_items(ranked, self.dictionary), popular_list(self.dictionary, n)
