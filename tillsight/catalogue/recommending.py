"""Profiles, similarities, neighbours, recommenders and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tillsight.catalogue.base import EVENT_FAT, query
from tillsight.operators import profiles, similarity
from tillsight.operators.nearest_approx import approximate, recall
from tillsight.operators.nearest_exact import exact_lists
from tillsight.operators.neighbours import nearest_customers, unit_profiles
from tillsight.operators.recommend import (Ensemble, ImplicitFactors, ItemToItem, NearestCustomers, NeighbourToItem,
                                           Popular, RandomOrder)
from tillsight.operators.relational import CUSTOMER, customer_business_pairs, min_visit_pairs
from tillsight.operators.similarity import conditional, tanimoto
from tillsight.plans import evaluation
from tillsight.plans.layout import staged_by_customer
from tillsight.session import cut_lineage
from tillsight.sources import testtables as tt
from tillsight.sources.schema import BUSINESS_KEY

N, VISITS, K, MIN_BUSINESSES, MAX_BUSINESSES, PRECOMPUTED = 10, 2, 15, 5, 30, 20
ITEM = "CAST('0x' || substr(md5(bname || chr(1) || btown), 1, 15) AS BIGINT)"
NAMES = "c AS masked_customer_id, bname AS business_name, btown AS business_town"


# SQL pieces. ``src`` is the table of fat rows a recommender is trained on. ----------------------------


def _pairs_sql(src: str, visits: int, tag: str) -> str:
    return f"""
pairs{tag} AS (SELECT c, bname, btown, {ITEM} AS item FROM {src} GROUP BY c, bname, btown HAVING count(*) >= {visits}),
dict{tag} AS (SELECT item, bname, btown, count(*) AS n FROM pairs{tag} GROUP BY ALL)"""


def _similarity_sql(metric: str, tag: str) -> str:
    formula = {"tanimoto": "n12 / (a.n + b.n - n12)", "conditional": "n12 / b.n"}[metric]
    return f"""
co{tag} AS (SELECT a.item, b.item AS other, CAST(count(*) AS DOUBLE) AS n12
            FROM pairs{tag} a JOIN pairs{tag} b ON a.c = b.c AND a.item <> b.item GROUP BY ALL),
sim{tag} AS (SELECT co.item, co.other, {formula} AS score
             FROM co{tag} co JOIN dict{tag} a ON a.item = co.item JOIN dict{tag} b ON b.item = co.other)"""


def _own_sql(scored: str, tag: str, n: int) -> str:
    return f"""
own{tag} AS (SELECT c, item, score, row_number() OVER (PARTITION BY c ORDER BY round(score, 9) DESC, item) AS r
             FROM {scored} QUALIFY r <= {n})"""


def _fill_sql(customers: str, tag: str, popular_pairs: str, n: int) -> str:
    """Ranked own lists, filled up with the popular businesses: rec<tag>(c, rank, bname, btown, score)."""
    return f"""
pop{tag} AS (SELECT item, bname, btown, row_number() OVER (ORDER BY count(*) DESC, bname, btown) AS r
             FROM {popular_pairs} GROUP BY item, bname, btown QUALIFY r <= {n}),
fill{tag} AS (
  SELECT c, item, score, 0 AS src, r FROM own{tag} WHERE r <= {n} AND c IN (SELECT c FROM {customers})
  UNION ALL SELECT w.c, p.item, NULL, 1, p.r FROM {customers} w, pop{tag} p
  WHERE NOT EXISTS (SELECT 1 FROM own{tag} o WHERE o.c = w.c AND o.item = p.item AND o.r <= {n})),
rec{tag} AS (SELECT c, CAST(row_number() OVER (PARTITION BY c ORDER BY src, f.r) AS INT) AS rank, d.bname, d.btown, score
             FROM fill{tag} f JOIN (SELECT DISTINCT item, bname, btown FROM {popular_pairs}) d USING (item)
             QUALIFY rank <= {n})"""


def _item_rec_sql(src: str, metric: str, customers: str, tag: str, total: str = "sum(score)") -> str:
    return ",".join([
        _pairs_sql(src, VISITS, tag), _similarity_sql(metric, tag), f"""
scored{tag} AS (SELECT p.c, s.other AS item, {total} AS score FROM pairs{tag} p JOIN sim{tag} s ON s.item = p.item
                WHERE NOT EXISTS (SELECT 1 FROM pairs{tag} q WHERE q.c = p.c AND q.item = s.other) GROUP BY ALL)""",
        _own_sql(f"scored{tag}", tag, N), _fill_sql(customers, tag, f"pairs{tag}", N)])


def _popular_rec_sql(src: str, customers: str, tag: str) -> str:
    return f"""{_pairs_sql(src, 1, tag)},
own{tag} AS (SELECT c, item, CAST(0 AS DOUBLE) AS score, 1 AS r FROM pairs{tag} WHERE false), {_fill_sql(customers, tag, f'pairs{tag}', N)}"""


def _random_rec_sql(src: str, customers: str, tag: str) -> str:
    return f"""{_pairs_sql(src, 1, tag)},
ord{tag} AS (SELECT item, bname, btown, row_number() OVER (ORDER BY md5('1|' || bname || '|' || btown), bname, btown) AS pos
               FROM dict{tag}),
rec{tag} AS (SELECT w.c, CAST(row_number() OVER (PARTITION BY w.c ORDER BY pos) AS INT) AS rank, bname, btown,
                    CAST(NULL AS DOUBLE) AS score
             FROM {customers} w, ord{tag} o
             WHERE NOT EXISTS (SELECT 1 FROM pairs{tag} p WHERE p.c = w.c AND p.item = o.item) QUALIFY rank <= {N})"""


def _share_sql(family: str, key: str, src: str, where: str = "true") -> str:
    return f"""SELECT c, '{family}' AS family, key, n / sum(n) OVER (PARTITION BY c) AS weight
  FROM (SELECT c, CAST({key} AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS n FROM {src} WHERE {where} GROUP BY ALL)"""


def _pdf_sql(field: str) -> str:
    return f"""SELECT acorn_type_id, online_active, '{field}' AS family, CAST(v AS VARCHAR) AS key,
    n / sum(n) OVER (PARTITION BY acorn_type_id, online_active) AS weight
  FROM (SELECT acorn_type_id, online_active, {field} AS v, CAST(count(*) AS DOUBLE) AS n FROM members
        WHERE {field} IS NOT NULL GROUP BY ALL)"""


SECTOR = "substr(postcode, 1, length(postcode) - 2)"
BKEY = "bname || chr(1) || btown"


def _features_sql(src: str, max_businesses: int, tag: str) -> str:
    pdfs = " UNION ALL ".join(_pdf_sql(f) for f in profiles.BUCKET_FIELDS)
    return f"""
pdf{tag} AS ({pdfs}),
bw{tag} AS (SELECT * FROM ({_share_sql('business', BKEY, src)})
            QUALIFY row_number() OVER (PARTITION BY c ORDER BY round(weight, 9) DESC, key) <= {max_businesses}),
feat{tag} AS ({_share_sql('day', 'day', src)} UNION ALL {_share_sql('category', 'code', src)}
  UNION ALL {_share_sql('postcode', SECTOR, src, 'postcode IS NOT NULL')} UNION ALL SELECT * FROM bw{tag}
  UNION ALL SELECT c, family, key, weight FROM (SELECT DISTINCT c, acorn_type_id, online_active FROM {src})
            JOIN pdf{tag} USING (acorn_type_id, online_active))"""


def _knn_sql(tag: str, k: int, self_too: bool = False) -> str:
    return f"""
norm{tag} AS (SELECT c, sqrt(sum(weight * weight)) AS w FROM feat{tag} GROUP BY c),
able{tag} AS (SELECT c FROM bw{tag} GROUP BY c HAVING count(*) > {MIN_BUSINESSES}),
cos{tag} AS (SELECT a.c, b.c AS o, sum(a.weight * b.weight) AS dot FROM feat{tag} a JOIN feat{tag} b
             ON a.family = b.family AND a.key = b.key WHERE b.c IN (SELECT c FROM able{tag}) GROUP BY ALL),
near{tag} AS (SELECT cos.c, o, round(dot / (a.w * b.w), 9) AS s,
                     CAST(row_number() OVER (PARTITION BY cos.c ORDER BY round(dot / (a.w * b.w), 9) DESC, o) AS INT) AS r
              FROM cos{tag} cos JOIN norm{tag} a ON a.c = cos.c JOIN norm{tag} b ON b.c = o
              WHERE {'true' if self_too else 'cos.c <> o'} QUALIFY r <= {k})"""


def _neighbour_scores_sql(tag: str) -> str:
    item = "CAST('0x' || substr(md5(key), 1, 15) AS BIGINT)"
    return f"""
wallet{tag} AS (SELECT c, {item} AS item, weight FROM bw{tag}),
nscore{tag} AS (SELECT n.c, w.item, sum(w.weight * n.s / t.total) AS score
  FROM near{tag} n JOIN (SELECT c, sum(s) AS total FROM near{tag} GROUP BY c) t ON t.c = n.c
  JOIN wallet{tag} w ON w.c = n.o
  WHERE NOT EXISTS (SELECT 1 FROM wallet{tag} m WHERE m.c = n.c AND m.item = w.item) GROUP BY ALL)"""


def _knn_rec_sql(src: str, customers: str, tag: str) -> str:
    return ",".join([
        _features_sql(src, MAX_BUSINESSES, tag), _knn_sql(tag, K), _neighbour_scores_sql(tag), _pairs_sql(src, 1, tag),
        _own_sql(f"nscore{tag}", tag, PRECOMPUTED), _fill_sql(customers, tag, f"pairs{tag}", N)])


def _n2i_rec_sql(src: str, customers: str, tag: str) -> str:
    return ",".join([
        _features_sql(src, MAX_BUSINESSES, tag), _knn_sql(tag, K), _neighbour_scores_sql(tag), _pairs_sql(src, 1, tag),
        _similarity_sql("tanimoto", tag), f"""
prob{tag} AS (SELECT c, item, score AS p FROM nscore{tag} UNION ALL SELECT c, item, weight FROM wallet{tag}),
rows{tag} AS (SELECT item, sum(score) AS total FROM sim{tag} GROUP BY item),
scored{tag} AS (SELECT p.c, s.other AS item, sum(p.p * s.score / r.total) AS score
  FROM prob{tag} p JOIN sim{tag} s ON s.item = p.item JOIN rows{tag} r ON r.item = p.item
  WHERE NOT EXISTS (SELECT 1 FROM wallet{tag} w WHERE w.c = p.c AND w.item = s.other) GROUP BY ALL)""",
        _own_sql(f"scored{tag}", tag, PRECOMPUTED), _fill_sql(customers, tag, f"pairs{tag}", N)])


def _ensemble_sql(recs: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT c, rank AS pos, bname, btown FROM {r}" for r in recs)
    return f"""
rec AS (SELECT c, CAST(row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, sum({N} + 1 - pos) DESC, bname, btown) AS INT)
               AS rank, bname, btown, CAST(sum({N} + 1 - pos) AS DOUBLE) AS score
        FROM ({union}) GROUP BY c, bname, btown QUALIFY rank <= {N})"""


WANTED = "wanted AS (SELECT c_custkey AS c FROM customer)"
REC = "SELECT c AS masked_customer_id, rank, bname AS business_name, btown AS business_town, round(score, 6) AS score FROM rec"


def _wanted(spark, d) -> DataFrame:
    """All customers, most of them without a transaction."""
    return tt.table(spark, d, "customer").select(F.col("c_custkey").alias(CUSTOMER))


def _recommended(spark, d, recommender, read=tt.event_joined) -> DataFrame:
    recs = recommender.fit(read(spark, d)).recommend(_wanted(spark, d), N)
    return recs.withColumn("score", F.round("score", 6))


# Profiles --------------------------------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.round("weight", 9)).withColumn("key", F.regexp_replace("key", "\u0001", "/"))


def _wallet_query(name: str, key_sql: str, column, where_sql: str = "true", where: str = "true") -> None:
    @query(f"wallet_{name}", f"""WITH {EVENT_FAT} SELECT c AS masked_customer_id, replace(key, chr(1), '/') AS key,
    round(weight, 9) AS weight FROM ({_share_sql(name, key_sql, 'fat', where_sql)})""")
    def run(spark, d):
        fat = tt.event_joined(spark, d).filter(where)
        return _rounded(profiles.wallet(fat, column().cast("string")))


_wallet_query("category", "code", lambda: F.col("merchant_category_code"))
_wallet_query("day", "day", lambda: F.col("day_of_week"))
_wallet_query("postcode", SECTOR, lambda: profiles.postcode_sector(F.col("business_postcode")),
              "postcode IS NOT NULL", "business_postcode is not null")


@query("wallet_business_top_n", f"""WITH {EVENT_FAT}, {_features_sql('fat', 10, '')}
SELECT c AS masked_customer_id, replace(key, chr(1), '/') AS key, round(weight, 9) AS weight FROM bw""")
def wallet_business_top_n(spark, d):
    shares = profiles.wallet(tt.event_joined(spark, d), profiles.business_key())
    return _rounded(profiles.truncate_wallet(shares, 10))


@query("customer_pdfs", f"""WITH {EVENT_FAT}, {_features_sql('fat', 10, '')}
SELECT DISTINCT c AS masked_customer_id, family, key, round(weight, 9) AS weight FROM feat
WHERE family NOT IN ('day', 'category', 'postcode', 'business')""")
def customer_pdfs(spark, d):
    return profiles.customer_pdfs(tt.event_fat(spark, d)).withColumn("weight", F.round("weight", 9))


@query("customer_features", f"""WITH {EVENT_FAT}, {_features_sql('fat', MAX_BUSINESSES, '')}
SELECT c AS masked_customer_id, family, replace(key, chr(1), '/') AS key, round(weight, 9) AS weight FROM feat""")
def customer_features(spark, d):
    return _rounded(profiles.customer_features(tt.event_fat(spark, d), MAX_BUSINESSES))


@query("features_by_layout", f"""WITH {EVENT_FAT}, {_features_sql('fat', MAX_BUSINESSES, '')}
SELECT c AS masked_customer_id, family, replace(key, chr(1), '/') AS key, round(weight, 9) AS weight FROM feat""")
def features_by_layout(spark, d):
    """The same features from the fat table stored by customer."""
    return _rounded(profiles.customer_features(staged_by_customer(tt.event_fat(spark, d), 8), MAX_BUSINESSES))


@query("eligible_neighbours", f"""WITH {EVENT_FAT}, {_features_sql('fat', MAX_BUSINESSES, '')}
SELECT c AS masked_customer_id, count(*) AS businesses FROM bw GROUP BY c HAVING count(*) > 29""")
def eligible_neighbours(spark, d):
    features = profiles.customer_features(tt.event_fat(spark, d), MAX_BUSINESSES)
    counted = features.filter(F.col("family") == profiles.BUSINESS_FAMILY).groupBy(CUSTOMER).agg(
        F.count(F.lit(1)).alias("businesses"))
    return unit_profiles(features, 29).filter("eligible").select(CUSTOMER).join(counted, CUSTOMER)


# Similarities and neighbours -------------------------------------------------------------------------


@query("co_occurrence", f"""WITH {EVENT_FAT}, {_pairs_sql('fat', VISITS, '')}, {_similarity_sql('tanimoto', '')}
SELECT item, other, CAST(n12 AS BIGINT) AS n12 FROM co WHERE item < other""")
def co_occurrence(spark, d):
    pairs = min_visit_pairs(tt.event_joined(spark, d), VISITS)
    return similarity.co_occurrence(similarity.item_pairs(pairs))


def _matrix_query(name: str, metric) -> None:
    @query(f"item_{name}", f"""WITH {EVENT_FAT}, {_pairs_sql('fat', VISITS, '')}, {_similarity_sql(name, '')}
    SELECT a.bname AS business_name, a.btown AS business_town, b.bname AS similar_name, b.btown AS similar_town,
           round(score, 9) AS score FROM sim JOIN dict a ON a.item = sim.item JOIN dict b ON b.item = sim.other""")
    def run(spark, d):
        pairs = min_visit_pairs(tt.event_joined(spark, d), VISITS)
        return similarity.item_matrix(pairs, metric).withColumn("score", F.round("score", 9))


_matrix_query("tanimoto", tanimoto)
_matrix_query("conditional", conditional)


@query("item_row_normalised", f"""WITH {EVENT_FAT}, {_pairs_sql('fat', 1, '')}, {_similarity_sql('tanimoto', '')}
SELECT item, other, round(score / sum(score) OVER (PARTITION BY item), 9) AS score FROM sim""")
def item_row_normalised(spark, d):
    matrix = similarity.item_similarity(customer_business_pairs(tt.event_joined(spark, d)), tanimoto)
    return similarity.row_normalised(matrix).withColumn("score", F.round("score", 9))


NEAR = "SELECT c AS masked_customer_id, o AS neighbour, s AS similarity, r AS rank FROM near"


@query("knn_customers", f"WITH {EVENT_FAT}, {_features_sql('fat', MAX_BUSINESSES, '')}, {_knn_sql('', K)} {NEAR}")
def knn_customers(spark, d):
    return nearest_customers(profiles.customer_features(tt.event_fat(spark, d), MAX_BUSINESSES), K, MIN_BUSINESSES)


@query("nearest_customer_with_self",
       f"WITH {EVENT_FAT}, {_features_sql('fat', MAX_BUSINESSES, '')}, {_knn_sql('', 1, True)} {NEAR}")
def nearest_customer_with_self(spark, d):
    features = profiles.customer_features(tt.event_fat(spark, d), MAX_BUSINESSES)
    return nearest_customers(features, 1, MIN_BUSINESSES, exclude_self=False)


@query("knn_customers_lists", f"WITH {EVENT_FAT}, {_features_sql('fat', MAX_BUSINESSES, '')}, {_knn_sql('', K)} {NEAR}")
def knn_customers_lists(spark, d):
    """The same neighbours by inverted lists and cells of dense parts, as larger tables are searched."""
    features = profiles.customer_features(tt.event_fat(spark, d), MAX_BUSINESSES)
    return nearest_customers(features, K, MIN_BUSINESSES, search=exact_lists())


@query("knn_customers_approximate")
def knn_customers_approximate(spark, d):
    features = profiles.customer_features(tt.event_fat(spark, d), MAX_BUSINESSES)
    return nearest_customers(features, K, MIN_BUSINESSES, search=approximate())


@query("knn_recall", f"""WITH {EVENT_FAT}, {_features_sql('fat', MAX_BUSINESSES, '')}, {_knn_sql('', K)}
SELECT count(DISTINCT c) AS queries, count(*) AS wanted, true AS enough FROM near WHERE c % 50 = 0""")
def knn_recall(spark, d):
    """Nine tenths of the true neighbours of the customers asked are found by the approximate search."""
    features = cut_lineage(profiles.customer_features(tt.event_fat(spark, d), MAX_BUSINESSES))
    exact = nearest_customers(features, K, MIN_BUSINESSES)
    measured = recall(nearest_customers(features, K, MIN_BUSINESSES, search=approximate()), exact)
    return measured.select("queries", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("enough"))


# Recommenders ----------------------------------------------------------------------------------------


@query("rec_random", f"WITH {EVENT_FAT}, {WANTED}, {_random_rec_sql('fat', 'wanted', '')} {REC}")
def rec_random(spark, d):
    return _recommended(spark, d, RandomOrder("1"))


@query("rec_popular", f"WITH {EVENT_FAT}, {WANTED}, {_popular_rec_sql('fat', 'wanted', '')} {REC}")
def rec_popular(spark, d):
    return _recommended(spark, d, Popular())


@query("rec_conditional", f"WITH {EVENT_FAT}, {WANTED}, {_item_rec_sql('fat', 'conditional', 'wanted', '')} {REC}")
def rec_conditional(spark, d):
    return _recommended(spark, d, ItemToItem(conditional, VISITS))


@query("rec_tanimoto", f"WITH {EVENT_FAT}, {WANTED}, {_item_rec_sql('fat', 'tanimoto', 'wanted', '')} {REC}")
def rec_tanimoto(spark, d):
    return _recommended(spark, d, ItemToItem(tanimoto, VISITS))


@query("rec_tanimoto_equal_scores_once",
       f"WITH {EVENT_FAT}, {WANTED}, {_item_rec_sql('fat', 'tanimoto', 'wanted', '', 'sum(DISTINCT score)')} {REC}")
def rec_tanimoto_equal_scores_once(spark, d):
    return _recommended(spark, d, ItemToItem(tanimoto, VISITS, dedupe_equal_scores=True))


_NEIGHBOURS = dict(min_businesses=MIN_BUSINESSES, max_businesses=MAX_BUSINESSES, precomputed=PRECOMPUTED, k=K)


@query("rec_knn", f"WITH {EVENT_FAT}, {WANTED}, {_knn_rec_sql('fat', 'wanted', '')} {REC}")
def rec_knn(spark, d):
    return _recommended(spark, d, NearestCustomers(**_NEIGHBOURS), tt.event_fat)


@query("rec_knn_literal", f"WITH {EVENT_FAT}, {WANTED}, {_popular_rec_sql('fat', 'wanted', '')} {REC}")
def rec_knn_literal(spark, d):
    return _recommended(spark, d, NearestCustomers(**_NEIGHBOURS, compat=True), tt.event_fat)


@query("rec_neighbour_to_item", f"WITH {EVENT_FAT}, {WANTED}, {_n2i_rec_sql('fat', 'wanted', '')} {REC}")
def rec_neighbour_to_item(spark, d):
    return _recommended(spark, d, NeighbourToItem(**_NEIGHBOURS), tt.event_fat)


def _three() -> Ensemble:
    return Ensemble([ItemToItem(conditional, VISITS), ItemToItem(tanimoto, VISITS), Popular()])


def _three_sql(src: str, customers: str) -> str:
    return ",".join([
        _item_rec_sql(src, "conditional", customers, "_a"), _item_rec_sql(src, "tanimoto", customers, "_b"),
        _popular_rec_sql(src, customers, "_c"), _ensemble_sql(["rec_a", "rec_b", "rec_c"])])


@query("rec_ensemble", f"WITH {EVENT_FAT}, {WANTED}, {_three_sql('fat', 'wanted')} {REC}")
def rec_ensemble(spark, d):
    return _recommended(spark, d, _three())


def _factors() -> ImplicitFactors:
    return ImplicitFactors(blocks=4)


@query("rec_als")
def rec_als(spark, d):
    return _recommended(spark, d, _factors())


def _promises(spark, d, recommended: DataFrame) -> DataFrame:
    """What holds of any list: everybody asked is there, has n places without repeats, scores fall, and no scored place is known."""
    known = customer_business_pairs(tt.event_joined(spark, d)).withColumn("known", F.lit(1))
    before = F.lag("score").over(Window.partitionBy(CUSTOMER).orderBy("rank"))
    marked = recommended.join(known, [CUSTOMER, *BUSINESS_KEY], "left").withColumn("_before", before)
    each = marked.groupBy(CUSTOMER).agg(
        F.count(F.lit(1)).alias("places"), F.count_distinct(*BUSINESS_KEY).alias("different"), F.max("rank").alias("last"),
        F.count_if(F.col("score") > F.col("_before")).alias("rising"),
        F.count_if(F.col("score").isNotNull() & F.col("known").isNotNull()).alias("known"))
    return each.agg(
        F.count(F.lit(1)).alias("customers"), F.sum("places").alias("places"),
        F.count_if((F.col("places") != N) | (F.col("different") != N) | (F.col("last") != N)).alias("wrong_lists"),
        F.sum("rising").alias("rising"), F.sum("known").alias("known"))


@query("rec_als_promises", f"""WITH {EVENT_FAT}, {WANTED}
SELECT count(*) AS customers, count(*) * {N} AS places, CAST(0 AS BIGINT) AS wrong_lists, CAST(0 AS BIGINT) AS rising,
       CAST(0 AS BIGINT) AS known FROM wanted""")
def rec_als_promises(spark, d):
    return _promises(spark, d, cut_lineage(_recommended(spark, d, _factors())))


def _with_factors() -> Ensemble:
    return Ensemble([ItemToItem(conditional, VISITS), ItemToItem(tanimoto, VISITS), _factors()])


@query("rec_ensemble_als_promises", f"""WITH {EVENT_FAT}, {WANTED}
SELECT count(*) AS customers, count(*) * {N} AS places, CAST(0 AS BIGINT) AS wrong_lists FROM wanted""")
def rec_ensemble_als_promises(spark, d):
    """The ensemble of both item recommenders and the factor model."""
    return _promises(spark, d, cut_lineage(_recommended(spark, d, _with_factors()))).select("customers", "places", "wrong_lists")


# Evaluation ------------------------------------------------------------------------------------------

DRAW = "CAST('0x' || substr(md5('1|' || c || '|' || bname || '|' || btown), 1, 8) AS BIGINT) / 4294967296.0"
SPLIT = f"""
training AS (SELECT * FROM fat WHERE NOT {DRAW} > 0.8),
test AS (SELECT * FROM fat WHERE {DRAW} > 0.8),
wanted AS (SELECT DISTINCT c FROM test)"""
FLAT = "c AS masked_customer_id, amount, day AS day_of_week, bname AS business_name, btown AS business_town"
AP = f"""
truth AS (SELECT DISTINCT c, bname, btown FROM test),
hits AS (SELECT r.c, r.rank, CASE WHEN t.c IS NULL THEN 0 ELSE 1 END AS hit FROM rec r
         LEFT JOIN truth t ON t.c = r.c AND t.bname = r.bname AND t.btown = r.btown WHERE rank <= {N}),
sums AS (SELECT c, sum(CASE WHEN hit = 1 THEN so_far / rank ELSE 0 END) AS p
         FROM (SELECT *, CAST(sum(hit) OVER (PARTITION BY c ORDER BY rank) AS DOUBLE) AS so_far FROM hits) GROUP BY c),
ap AS (SELECT s.c, p / least(liked, {N}) AS average_precision
       FROM sums s JOIN (SELECT c, count(*) AS liked FROM truth GROUP BY c) USING (c))"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select(CUSTOMER, "amount", "day_of_week", "business_name", "business_town")


@query("holdout_train", f"WITH {EVENT_FAT}, {SPLIT} SELECT {FLAT} FROM training")
def holdout_train(spark, d):
    return _flat(evaluation.split(tt.event_joined(spark, d))[0])


@query("holdout_test", f"WITH {EVENT_FAT}, {SPLIT} SELECT {FLAT} FROM test")
def holdout_test(spark, d):
    return _flat(evaluation.split(tt.event_joined(spark, d))[1])


@query("sampled_customers", """
SELECT masked_customer_id FROM (SELECT DISTINCT user_id AS masked_customer_id FROM events)
WHERE CAST('0x' || substr(md5('1|' || masked_customer_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.5""")
def sampled_customers(spark, d):
    return evaluation.sample_customers(tt.event_transactions(spark, d), 0.5)


@query("output_problems", f"""WITH {EVENT_FAT}, {SPLIT}, short AS (
  SELECT c, count(DISTINCT (bname, btown)) AS n FROM test GROUP BY c)
SELECT c AS masked_customer_id, 'wrong number of places' AS problem FROM short WHERE n <> {N}""")
def output_problems(spark, d):
    held_out = evaluation.split(tt.event_joined(spark, d))[1]
    return evaluation.output_problems(customer_business_pairs(held_out), held_out, N)


@query("average_precision", f"""WITH {EVENT_FAT}, {SPLIT}, {_item_rec_sql('training', 'tanimoto', 'wanted', '')}, {AP}
SELECT c AS masked_customer_id, round(average_precision, 9) AS average_precision FROM ap""")
def average_precision(spark, d):
    train, test = evaluation.split(tt.event_joined(spark, d))
    recs = ItemToItem(tanimoto, VISITS).fit(train).recommend(test, N)
    return evaluation.average_precision(recs, test, N).withColumn(
        "average_precision", F.round("average_precision", 9))


def _evaluate_query(name: str, make, rec_sql: str | None, read=tt.event_joined) -> None:
    sql = None if rec_sql is None else f"""WITH {EVENT_FAT}, {SPLIT}, {rec_sql}, {AP}
    SELECT '{name}' AS recommender, {N} AS n, round(coalesce(avg(average_precision), 0), 9) AS map FROM ap"""

    @query(f"evaluate_{name}", sql)
    def run(spark, d):
        scored = evaluation.evaluation_job(read(spark, d), name, N, recommenders={name: make()})
        return scored.withColumn("map", F.round("map", 9))


_evaluate_query("random", lambda: RandomOrder("1"), _random_rec_sql("training", "wanted", ""))
_evaluate_query("popular", Popular, _popular_rec_sql("training", "wanted", ""))
_evaluate_query("conditional", lambda: ItemToItem(conditional, VISITS),
                _item_rec_sql("training", "conditional", "wanted", ""))
_evaluate_query("tanimoto", lambda: ItemToItem(tanimoto, VISITS), _item_rec_sql("training", "tanimoto", "wanted", ""))
_evaluate_query("nearest_customers", lambda: NearestCustomers(**_NEIGHBOURS), _knn_rec_sql("training", "wanted", ""),
                tt.event_fat)
_evaluate_query("neighbour_to_item", lambda: NeighbourToItem(**_NEIGHBOURS), _n2i_rec_sql("training", "wanted", ""),
                tt.event_fat)
_evaluate_query("ensemble", _three, _three_sql("training", "wanted"))
_evaluate_query("als", _factors, None)


@query("evaluate_ensemble_als_promises", f"SELECT 'ensemble_als' AS recommender, {N} AS n, true AS share")
def evaluate_ensemble_als_promises(spark, d):
    """Evaluation, with its output checks, of both item recommenders and the factor model together: the mean is a share."""
    scored = evaluation.evaluation_job(
        tt.event_joined(spark, d), "ensemble_als", N, recommenders={"ensemble_als": _with_factors()})
    return scored.select("recommender", "n", F.col("map").between(0.0, 1.0).alias("share"))
