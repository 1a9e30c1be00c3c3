"""What all recommenders share: the contract, the popular list, filling up, and the two baselines."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from tillsight.operators.ranking import number_rows, top_n, top_rows
from tillsight.operators.relational import CUSTOMER, count_by, customer_business_pairs, salted_join
from tillsight.session import cut_lineage
from tillsight.sources.schema import BUSINESS_KEY

RECOMMENDATION = (CUSTOMER, "rank", *BUSINESS_KEY, "score")


class Model(Protocol):
    def recommend(self, customers: DataFrame, n: int) -> DataFrame: ...


class Recommender(Protocol):
    def fit(self, transactions: DataFrame) -> Model: ...


def requested(customers: DataFrame) -> DataFrame:
    return customers.select(CUSTOMER).distinct()


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Customers per business, of pairs that are distinct already."""
    return count_by(pairs, BUSINESS_KEY, "customers")


def popular_list(counted: DataFrame, n: int) -> Column:
    """The ``n`` most popular businesses as one array value: worked out once per plan, and ``n`` entries long.
    ``counted`` holds each business with its number of ``customers``."""
    best = top_rows(counted, "customers", n, BUSINESS_KEY)
    entry = F.struct((-F.col("customers")).alias("order"), *BUSINESS_KEY)
    listed = best.agg(F.array_sort(F.collect_list(entry)).alias("entries")).select(
        F.transform("entries", lambda e: F.struct(*[e[k].alias(k) for k in BUSINESS_KEY])))
    return listed.scalar()


OWN_LIST = "array<struct<rank:int,business_name:string,business_town:string,score:double>>"
POPULAR_LIST = "array<struct<business_name:string,business_town:string>>"


def own_lists(ranked: DataFrame, name: str = "_own") -> DataFrame:
    """Each customer's ranked list in one row."""
    entry = F.struct("rank", *BUSINESS_KEY, "score")
    return ranked.groupBy(CUSTOMER).agg(F.array_sort(F.collect_list(entry)).cast(OWN_LIST).alias(name))


def with_places(lists: DataFrame, own: str, popular: str, name: str, n: int) -> DataFrame:
    """The first ``n`` places in a column ``name``: the own ranked list, then the popular businesses that are not yet in it."""
    listed = F.transform(
        F.coalesce(own, F.expr("array()").cast(OWN_LIST)),
        lambda r: F.struct(*[r[k].alias(k) for k in BUSINESS_KEY], r["score"].alias("score")))
    known = lambda p: F.exists(
        F.col("_list"), lambda r: (r["business_name"] == p["business_name"]) & (r["business_town"] == p["business_town"]))
    fill = F.transform(
        F.filter(F.coalesce(popular, F.expr("array()").cast(POPULAR_LIST)), lambda p: ~known(p)),
        lambda p: F.struct(*[p[k].alias(k) for k in BUSINESS_KEY], F.lit(None).cast("double").alias("score")))
    return lists.withColumn("_list", listed).withColumn(name, F.slice(F.concat(F.col("_list"), fill), 1, n)).drop("_list")


def fill_up(ranked: DataFrame, customers: DataFrame, popular: Column, n: int) -> DataFrame:
    """Exactly the requested customers with up to ``n`` places each: their own ranked list, then the popular ones not
    yet in it. A popular business fills a place even if the customer knows it."""
    joined = requested(customers).join(own_lists(ranked), CUSTOMER, "left").withColumn("_popular", popular)
    return (
        with_places(joined, "_own", "_popular", "_places", n)
        .select(CUSTOMER, F.posexplode("_places").alias("_pos", "_place"))
        .select(CUSTOMER, (F.col("_pos") + 1).alias("rank"), "_place.*")
        .select(*RECOMMENDATION)
    )


def visit_counts(transactions: DataFrame) -> DataFrame:
    """``visits`` of each customer and business: what several recommenders are fitted on."""
    return count_by(transactions, [CUSTOMER, *BUSINESS_KEY], "visits")


class Popular:
    """The most popular businesses for everybody."""

    def fit(self, transactions: DataFrame) -> PopularModel:
        return PopularModel(customer_business_pairs(transactions))

    def fit_visits(self, visits: DataFrame) -> PopularModel:
        return PopularModel(visits.select(CUSTOMER, *BUSINESS_KEY))


class PopularModel:
    def __init__(self, pairs: DataFrame):
        self.pairs = pairs

    def own_and_popular(self, customers: DataFrame, n: int) -> tuple[None, Column]:
        return None, popular_list(pair_counts(self.pairs), n)

    def recommend(self, customers: DataFrame, n: int) -> DataFrame:
        listed = requested(customers).withColumn("_popular", popular_list(pair_counts(self.pairs), n))
        return listed.select(CUSTOMER, F.posexplode("_popular").alias("_pos", "_place")).select(
            CUSTOMER, (F.col("_pos") + 1).alias("rank"), "_place.*", F.lit(None).cast("double").alias("score"))


class RandomOrder:
    """Businesses in one arbitrary but reproducible order, without those the customer knows."""

    def __init__(self, seed: str = "1"):
        self.seed = seed

    def fit(self, transactions: DataFrame) -> RandomOrderModel:
        return RandomOrderModel(cut_lineage(customer_business_pairs(transactions)), self.seed)


class RandomOrderModel:
    def __init__(self, pairs: DataFrame, seed: str):
        self.pairs = pairs
        self.order = number_rows(pairs, BUSINESS_KEY, seed, "position")

    def recommend(self, customers: DataFrame, n: int) -> DataFrame:
        """A customer who knows m businesses finds n new ones among the first n + m of the order, so the work follows
        the pairs, not customers times businesses."""
        wanted = requested(customers)
        seen = self.pairs.join(wanted, CUSTOMER, "left_semi").join(self.order, list(BUSINESS_KEY)).select(
            CUSTOMER, "position")
        known = seen.groupBy(CUSTOMER).agg(F.count(F.lit(1)).alias("_m"))
        reach = F.coalesce("_m", F.lit(0)) + F.lit(n - 1)
        places = wanted.join(known, CUSTOMER, "left").select(
            CUSTOMER, F.explode(F.sequence(F.lit(0).cast("bigint"), reach.cast("bigint"))).alias("position"))
        unseen = places.join(seen, [CUSTOMER, "position"], "left_anti")
        chosen = top_n(unseen, [CUSTOMER], F.lit(0.0), n, ["position"])
        # Nearly all customers hold the first places of the order.
        return salted_join(chosen, self.order, "position", CUSTOMER).withColumn("score", F.lit(None).cast("double")).select(
            *RECOMMENDATION)
