"""Hold-out split, checks of the output, mean average precision, and the evaluation of a recommender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillsight.operators.recommend import (Ensemble, ImplicitFactors, ItemToItem, NearestCustomers, NeighbourToItem,
                                           RandomOrder, Recommender)
from tillsight.operators.relational import CUSTOMER
from tillsight.operators.similarity import conditional, tanimoto
from tillsight.session import cut_lineage
from tillsight.sources.schema import BUSINESS_KEY


def draw(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only, so no row needs to see another."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def is_test(fraction: float = 0.8, seed: str = "1") -> Column:
    """True for the pairs held out; all rows of a customer at a business fall on one side."""
    return draw(seed, F.col(CUSTOMER), *[F.col(c) for c in BUSINESS_KEY]) > fraction


def split_label(df: DataFrame, fraction: float = 0.8, seed: str = "1") -> DataFrame:
    return df.withColumn("is_test", is_test(fraction, seed))


def split(df: DataFrame, fraction: float = 0.8, seed: str = "1") -> tuple[DataFrame, DataFrame]:
    """``(training, test)``: two filters on the same scan, no shuffle and nothing collected."""
    return df.filter(~is_test(fraction, seed)), df.filter(is_test(fraction, seed))


def sample_customers(df: DataFrame, fraction: float, seed: str = "1") -> DataFrame:
    customers = df.select(CUSTOMER).distinct()
    return customers if fraction >= 1.0 else customers.filter(draw(seed, F.col(CUSTOMER)) < fraction)


def output_problems(recommendations: DataFrame, customers: DataFrame, n: int) -> DataFrame:
    """``(masked_customer_id, problem)``: customers without or beyond the request, and lists not n long."""
    sizes = recommendations.groupBy(CUSTOMER).agg(F.count(F.lit(1)).alias("places"))
    both = customers.select(CUSTOMER).distinct().withColumn("wanted", F.lit(True)).join(sizes, CUSTOMER, "full")
    problem = (
        F.when(F.col("places").isNull(), F.lit("no recommendations"))
        .when(F.col("wanted").isNull(), F.lit("not requested"))
        .when(F.col("places") != n, F.lit("wrong number of places")))
    return both.select(CUSTOMER, problem.alias("problem")).filter(F.col("problem").isNotNull())


def average_precision(recommendations: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """``(masked_customer_id, average_precision)`` for customers in both tables: sum over hits of hits so far by
    place, over the smaller of n and the number of true businesses."""
    truth = truth.select(CUSTOMER, *BUSINESS_KEY).distinct()
    sizes = truth.groupBy(CUSTOMER).agg(F.count(F.lit(1)).alias("liked"))
    hits = (
        recommendations.filter(F.col("rank") <= n).select(CUSTOMER, "rank", *BUSINESS_KEY)
        .join(truth.withColumn("hit", F.lit(1)), [CUSTOMER, *BUSINESS_KEY], "left")
        .withColumn("hit", F.coalesce("hit", F.lit(0))))
    so_far = F.sum("hit").over(Window.partitionBy(CUSTOMER).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    precision = hits.withColumn("p", F.when(F.col("hit") == 1, so_far / F.col("rank")).otherwise(0.0)).groupBy(
        CUSTOMER).agg(F.sum("p").alias("p"))
    return precision.join(sizes, CUSTOMER).select(
        CUSTOMER, (F.col("p") / F.least(F.col("liked"), F.lit(n))).alias("average_precision"))


def mean_average_precision(recommendations: DataFrame, truth: DataFrame, n: int = 100) -> DataFrame:
    """One row ``map``; zero when no customer is in both tables."""
    return average_precision(recommendations, truth, n).agg(
        F.coalesce(F.avg("average_precision"), F.lit(0.0)).alias("map"))


def evaluate(recommender: Recommender, training: DataFrame, test: DataFrame, n: int = 100,
             sampling_fraction: float = 1.0, seed: str = "1", check: bool = True) -> DataFrame:
    """MAP at n over a sample of the test customers. With ``check`` a wrong or short list raises."""
    customers = sample_customers(test, sampling_fraction, seed)
    recommendations = recommender.fit(training).recommend(customers, n)
    if check:
        recommendations = cut_lineage(recommendations)
        problems = output_problems(recommendations, customers, n).groupBy("problem").count().collect()
        if problems:
            raise ValueError("; ".join(f"{r['count']} customers: {r['problem']}" for r in problems))
    return mean_average_precision(recommendations, test, n)


# The seven recommenders with their usual parameters.
def standard_recommenders(min_visits: int = 5, **neighbour_options) -> dict[str, Recommender]:
    by_probability, by_tanimoto = ItemToItem(conditional, min_visits), ItemToItem(tanimoto, min_visits)
    return {
        "random": RandomOrder(),
        "conditional": by_probability,
        "tanimoto": by_tanimoto,
        "nearest_customers": NearestCustomers(**neighbour_options),
        "neighbour_to_item": NeighbourToItem(**neighbour_options),
        "factors": ImplicitFactors(),
        "ensemble": Ensemble([by_probability, by_tanimoto, ImplicitFactors()]),
    }


def evaluation_job(fat: DataFrame, name: str, n: int = 20, training_fraction: float = 0.8,
                   sampling_fraction: float = 1.0, partitions: int | None = None, seed: str = "1", check: bool = True,
                   recommenders: dict[str, Recommender] | None = None) -> DataFrame:
    """``(recommender, n, map)`` for one recommender: split, train, recommend, check, score."""
    if partitions is not None:
        fat = fat.coalesce(partitions)
    training, test = split(fat, training_fraction, seed)
    recommender = (recommenders or standard_recommenders())[name]
    scored = evaluate(recommender, training, test, n, sampling_fraction, seed, check)
    return scored.select(F.lit(name).alias("recommender"), F.lit(n).alias("n"), "map")
