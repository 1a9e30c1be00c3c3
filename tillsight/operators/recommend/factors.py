"""Implicit-feedback matrix factorisation."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, functions as F

from tillsight.operators.ranking import number_rows
from tillsight.operators.recommend.base import RECOMMENDATION, fill_up, pair_counts, popular_list, requested, visit_counts
from tillsight.operators.recommend.products import top_products
from tillsight.operators.relational import CUSTOMER
from tillsight.session import cut_lineage, ensure_checkpoint_dir
from tillsight.sources.schema import BUSINESS_KEY


class ImplicitFactors:
    """Visit counts as implicit ratings; candidates go by the dot product of the factors."""

    def __init__(self, rank: int = 10, iterations: int = 10, alpha: float = 0.01, blocks: int = 30,
                 regularisation: float = 0.01, seed: int = 1):
        self.rank, self.iterations, self.alpha = rank, iterations, alpha
        self.blocks, self.regularisation, self.seed = blocks, regularisation, seed

    def fit(self, transactions: DataFrame) -> ImplicitFactorsModel:
        return self.fit_visits(visit_counts(transactions))

    def fit_visits(self, visits: DataFrame) -> ImplicitFactorsModel:
        ensure_checkpoint_dir(visits.sparkSession)
        # Dense ids: the solver takes 32-bit ids, and raw customer ids are wider than that.
        users = cut_lineage(number_rows(visits, [CUSTOMER], "user", "user"))
        items = cut_lineage(number_rows(visits, BUSINESS_KEY, "item", "item"))
        ratings = cut_lineage(
            visits.join(users, CUSTOMER).join(items, list(BUSINESS_KEY)).select(
                CUSTOMER, *BUSINESS_KEY, F.col("user").cast("int"), F.col("item").cast("int"),
                F.col("visits").cast("float").alias("rating")))
        model = ALS(
            rank=self.rank, maxIter=self.iterations, alpha=self.alpha, regParam=self.regularisation,
            numUserBlocks=self.blocks, numItemBlocks=self.blocks, implicitPrefs=True, seed=self.seed,
            userCol="user", itemCol="item", ratingCol="rating").fit(ratings)
        return ImplicitFactorsModel(model, ratings, users, items)


class ImplicitFactorsModel:
    def __init__(self, model, ratings: DataFrame, users: DataFrame, items: DataFrame):
        self.model, self.ratings, self.users, self.items = model, ratings, users, items

    def recommend(self, customers: DataFrame, n: int) -> DataFrame:
        own, popular = self.own_and_popular(customers, n)
        return fill_up(own, customers, popular, n)

    def own_and_popular(self, customers: DataFrame, n: int) -> tuple[DataFrame, Column]:
        """The unseen items of the greatest product of factors; known items are left out inside the search."""
        wanted = self.ratings.join(requested(customers), CUSTOMER, "left_semi")
        known = wanted.groupBy("user").agg(F.collect_list("item").alias("known"))
        users = self.model.userFactors.withColumnRenamed("id", "user").join(known, "user")
        best = top_products(users, self.model.itemFactors, n)
        ranked = best.join(self.users, "user").join(self.items, "item").select(*RECOMMENDATION)
        return ranked, popular_list(pair_counts(self.ratings), n)
