"""Recommenders built on the nearest customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillsight.operators.neighbours import nearest_customers
from tillsight.operators.profile_blocks import ProfileSearch
from tillsight.operators.profiles import BUSINESS_FAMILY, KEY_SEPARATOR, customer_features
from tillsight.operators.ranking import top_n
from tillsight.operators.recommend.base import fill_up, popular_list, requested
from tillsight.operators.recommend.items import name_items, score_unseen
from tillsight.operators.relational import CUSTOMER, customer_business_pairs, salted_join
from tillsight.operators.similarity import (item_dictionary, item_id, item_similarity, row_normalised, tanimoto,
                                            with_item_ids)
from tillsight.session import cut_lineage, stage_table


def _business_wallets(features: DataFrame) -> DataFrame:
    parts = F.split("key", KEY_SEPARATOR, -1)
    return features.filter(F.col("family") == BUSINESS_FAMILY).select(
        CUSTOMER, parts[0].alias("business_name"), parts[1].alias("business_town"), "weight")


def neighbour_scores(wallets: DataFrame, near: DataFrame, compat: bool) -> DataFrame:
    """``(customer, item, score)``: shares of the neighbours, weighted by similarity over the sum of similarities,
    for businesses outside the customer's own wallet. With ``compat`` the test looks at the neighbour's own wallet
    instead, as the original does, which leaves nothing."""
    items = wallets.select(CUSTOMER, item_id().alias("item"), "weight")
    sums = near.groupBy(CUSTOMER).agg(F.sum("similarity").alias("_sum"))
    # Similarities that sum to 0 give no scores; such a customer is served by the back-fill.
    weighted = near.join(sums.filter(F.col("_sum") != 0), CUSTOMER).select(
        CUSTOMER, "neighbour", (F.col("similarity") / F.col("_sum")).alias("_w"))
    theirs = items.withColumnRenamed(CUSTOMER, "neighbour")
    # One customer may be the neighbour of very many.
    part = salted_join(weighted, theirs, "neighbour", CUSTOMER).select(
        CUSTOMER, "item", (F.col("weight") * F.col("_w")).alias("part"), F.lit(compat).alias("seen"))
    marker = items.select(CUSTOMER, "item", F.lit(None).cast("double").alias("part"), F.lit(True).alias("seen"))
    scored = part.unionByName(marker).groupBy(CUSTOMER, "item").agg(
        F.sum("part").alias("score"), F.max("seen").alias("seen"))
    return scored.filter(~F.col("seen")).drop("seen")


class _NeighbourBase:
    def __init__(self, min_businesses: int = 5, max_businesses: int = 100, precomputed: int = 20, k: int = 15,
                 exclude_self: bool = True, compat: bool = False, pivots: int | None = None,
                 search: ProfileSearch | None = None):
        self.min_businesses, self.max_businesses = min_businesses, max_businesses
        self.precomputed, self.k = precomputed, k
        self.exclude_self, self.compat, self.pivots, self.search = exclude_self, compat, pivots, search

    def _prepare(self, transactions: DataFrame):
        features = cut_lineage(customer_features(transactions, self.max_businesses))
        wallets = _business_wallets(features)
        near = nearest_customers(features, self.k, self.min_businesses, self.exclude_self, self.pivots,
                                 self.search)
        return wallets, neighbour_scores(wallets, cut_lineage(near), self.compat)


class NearestCustomers(_NeighbourBase):
    def fit(self, transactions: DataFrame) -> PrecomputedModel:
        dictionary = item_dictionary(customer_business_pairs(transactions))
        _, scores = self._prepare(transactions)
        ranked = top_n(scores, [CUSTOMER], "score", self.precomputed, ["item"])
        return PrecomputedModel(ranked, dictionary, self.max_businesses)


class NeighbourToItem(_NeighbourBase):
    """Neighbour scores and the own wallet, carried on through the row-normalised Tanimoto table."""

    def fit(self, transactions: DataFrame) -> PrecomputedModel:
        pairs = cut_lineage(with_item_ids(customer_business_pairs(transactions)))
        dictionary = cut_lineage(item_dictionary(pairs))
        wallets, scores = self._prepare(transactions)
        own = wallets.select(CUSTOMER, item_id().alias("item"), "weight")
        sources = cut_lineage(own.unionByName(scores.withColumnRenamed("score", "weight")))
        matrix = stage_table(row_normalised(stage_table(item_similarity(pairs, tanimoto, dictionary))))
        ranked = score_unseen(sources, matrix, own, self.precomputed, F.sum("part"))
        return PrecomputedModel(ranked, dictionary, self.max_businesses)


class PrecomputedModel:
    """Stored lists; the popular list answers for unknown customers and fills short lists up."""

    def __init__(self, ranked: DataFrame, dictionary: DataFrame, max_popular: int):
        self.dictionary, self.max_popular = cut_lineage(dictionary), max_popular
        self.ranked = cut_lineage(name_items(ranked, self.dictionary))

    def recommend(self, customers: DataFrame, n: int) -> DataFrame:
        wanted = self.ranked.filter(F.col("rank") <= n).join(requested(customers), CUSTOMER, "left_semi")
        return fill_up(wanted, customers, popular_list(self.dictionary, min(n, self.max_popular)), n)
