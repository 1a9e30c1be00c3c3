"""Rank merge of several recommenders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillsight.operators.recommend.base import (OWN_LIST, POPULAR_LIST, RECOMMENDATION, Model, Recommender, own_lists, requested,
                                                visit_counts, with_places)
from tillsight.operators.recommend.items import ItemToItem, item_counts
from tillsight.operators.relational import CUSTOMER, union_all
from tillsight.session import stage_table
from tillsight.sources.schema import BUSINESS_KEY


def merge_ranks(tables: Sequence[DataFrame], n: int) -> DataFrame:
    """Place r of a list gives n - r + 1 points. Businesses go by votes, then points; the score is the points."""
    return merge_places(union_all([t.select(CUSTOMER, "rank", *BUSINESS_KEY) for t in tables]), n)


def merge_places(places: DataFrame, n: int) -> DataFrame:
    """The same of all lists' places in one table."""
    votes = places.groupBy(CUSTOMER, *BUSINESS_KEY).agg(
        F.count(F.lit(1)).alias("votes"), F.sum(F.lit(n + 1) - F.col("rank")).alias("points"))
    order = Window.partitionBy(CUSTOMER).orderBy(F.desc("votes"), F.desc("points"), *BUSINESS_KEY)
    return votes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(
        CUSTOMER, "rank", *BUSINESS_KEY, F.col("points").cast("double").alias("score"))


class Ensemble:
    def __init__(self, recommenders: Sequence[Recommender]):
        self.recommenders = list(recommenders)

    def fit(self, transactions: DataFrame) -> EnsembleModel:
        """The transactions are counted once for all members that can be fitted on counts, items are paired once for each ``min_visits``."""
        visits, counts = None, {}
        models = []
        for member in self.recommenders:
            if not hasattr(member, "fit_visits"):
                models.append(member.fit(transactions))
                continue
            visits = visits if visits is not None else stage_table(visit_counts(transactions))
            if not isinstance(member, ItemToItem):
                models.append(member.fit_visits(visits))
                continue
            if member.min_visits not in counts:
                found = item_counts(visits, member.min_visits)
                counts[member.min_visits] = found._replace(shared=stage_table(found.shared))
            models.append(member.fit_counts(counts[member.min_visits]))
        return EnsembleModel(models)


class EnsembleModel:
    def __init__(self, models: Sequence[Model]):
        self.models = models

    def recommend(self, customers: DataFrame, n: int) -> DataFrame:
        """Lists are merged for customers whom a member gives places of their own. All others have the same popular lists: these are
        merged once and handed to them."""
        own, popular = zip(*[self._parts(m, customers, n) for m in self.models], strict=True)
        names = [f"_own{k}" for k in range(len(own))]
        # Each written by itself: a task then sorts the scores of one member, not of all.
        lists = [stage_table(own_lists(ranked, name)) for ranked, name in zip(own, names, strict=True) if ranked is not None]
        some = customers.select(CUSTOMER).limit(0) if not lists else stage_table(
            reduce(lambda left, right: left.join(right, CUSTOMER, "full"), lists))
        nobody = customers.sparkSession.range(1).select(F.lit(None).cast(customers.schema[CUSTOMER].dataType).alias(CUSTOMER))
        entry = F.struct("rank", *BUSINESS_KEY, "score")
        same = self._merged(nobody, names, popular, n).agg(F.array_sort(F.collect_list(entry)).alias("e")).scalar()
        others = requested(customers).join(some.select(CUSTOMER), CUSTOMER, "left_anti").withColumn("_same", same)
        return self._merged(some, names, popular, n).unionByName(
            others.select(CUSTOMER, F.explode("_same").alias("_e")).select(CUSTOMER, "_e.*").select(*RECOMMENDATION))

    @staticmethod
    def _parts(model: Model, customers: DataFrame, n: int) -> tuple[DataFrame | None, Column]:
        """Places of the customers' own, and the businesses that fill up the list of anybody."""
        if hasattr(model, "own_and_popular"):
            return model.own_and_popular(customers, n)
        return model.recommend(customers, n), F.lit(None).cast(POPULAR_LIST)

    @staticmethod
    def _merged(lists: DataFrame, names: Sequence[str], popular: Sequence[Column], n: int) -> DataFrame:
        filled = lists.withColumns({name: F.lit(None).cast(OWN_LIST) for name in names if name not in lists.columns})
        filled = filled.withColumns({f"_popular{k}": column for k, column in enumerate(popular)})
        for k, name in enumerate(names):
            filled = with_places(filled, name, f"_popular{k}", f"_places{k}", n)
        placed = [F.transform(f"_places{k}", lambda p, at: F.struct((at + 1).alias("rank"), *[p[b].alias(b) for b in BUSINESS_KEY]))
                  for k in range(len(names))]
        places = filled.select(CUSTOMER, F.explode(F.flatten(F.array(*placed))).alias("_e")).select(CUSTOMER, "_e.*")
        return merge_places(places, n).select(*RECOMMENDATION)
