"""Scans, text layouts, scalar functions, filters, joins, aggregates and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillsight.catalogue.base import (EVENT_FAT, GROUPS, MERCHANTS, MONEY, ORDER_FAT, ORDER_TX,
                                      RAW_CUSTOMERS, query)
from tillsight.functions import scalars as S
from tillsight.operators import cleaning, partials, ranking, relational, similarity, statistics
from tillsight.operators.anonymise import bucket_text, mask_ids
from tillsight.plans import cleaning as cleaning_plan, fat_table as fat_plan
from tillsight.session import stage_path, stage_table
from tillsight.sources import delimited, jdbc, testtables as tt
from tillsight.sources.schema import BUCKET_FIELDS, BUSINESS_KEY

BAD = ("NATION_1", "ION_7")
BAD_SQL = "NOT (contains(btown, 'NATION_1') OR contains(btown, 'ION_7'))"


def _group_text(group):
    shown = lambda b: F.concat_ws("|", *[F.coalesce(b[f].cast("string"), F.lit("")) for f in BUCKET_FIELDS])
    return F.array_join(F.array_sort(F.transform(group, shown)), ",")


GROUP_TEXT_SQL = """
group_texts AS (
  SELECT acorn_type_id, online_active, string_agg(t, ',' ORDER BY t) AS group_text
  FROM (SELECT acorn_type_id, online_active,
               concat(CASE WHEN online_active THEN 'true' ELSE 'false' END, '|', acorn_type_id, '|', gender, '|',
                      coalesce(CAST(marital_status_id AS VARCHAR), ''), '|',
                      coalesce(CAST(occupation_id AS VARCHAR), '')) AS t FROM members)
  GROUP BY ALL)"""


# Sources ---------------------------------------------------------------------------------------------


def _customer_source(spark, d) -> DataFrame:
    """The raw customer table as a database would hand it over: flags as ints, codes as padded text."""
    c = tt.raw_customers(spark, d)
    return c.select(
        F.lit("2015-06-30").cast("date").alias("SUMMARY_DATE"),
        F.col("customer_id").cast("decimal(18,0)").alias("CUSTOMER_IDENTIFIER"),
        F.col("balance").cast("decimal(18,2)").alias("CA_AVG_CLEARED_BALANCE_AMT"),
        F.col("age").alias("AGE"),
        F.col("online_active").cast("int").alias("ONLINE_ACTIVE"),
        F.col("income").cast("decimal(18,2)").alias("CUSTOMER_INCOME"),
        F.col("gross_income").cast("int").alias("GROSS_INCOME_AMOUNT"),
        F.col("postal_sector").alias("POSTAL_SECTOR"),
        F.col("acorn_type_id").alias("ACORN_TYPE_ID"),
        F.col("gender").alias("SEX_INDICATOR"),
        F.concat(F.lit(" "), F.coalesce(F.col("marital_status_id").cast("string"), F.lit(""))).alias(
            "MARITAL_STATUS_CODE"),
        F.coalesce(F.col("occupation_id").cast("string"), F.lit("N/A")).alias("OCCUPATION_CODE"),
        F.lit(0).alias("UNUSED"),
    )


@query("raw_customers_scan", f"WITH {RAW_CUSTOMERS} SELECT DATE '2015-06-30' AS summary_date, * FROM customers")
def raw_customers_scan(spark, d):
    return jdbc.raw_customers(_customer_source(spark, d))


def _transaction_source(spark, d) -> DataFrame:
    return tt.order_raw_transactions(spark, d).select(
        F.col("customer_id").cast("decimal(18,0)").alias("cust"), "date", F.lit("m").alias("merchant_number"),
        F.col("merchant_name").alias("name"), F.col("merchant_town").alias("town"),
        F.col("amount").cast("decimal(18,2)").alias("amount"), F.col("merchant_country").alias("country"),
        F.col("merchant_category_code").alias("code"))


@query("raw_transactions_scan", f"WITH {ORDER_TX} SELECT * FROM raw_tx")
def raw_transactions_scan(spark, d):
    return jdbc.raw_transactions(_transaction_source(spark, d))


@query("union_transactions", f"""WITH {ORDER_TX}, u AS (SELECT * FROM raw_tx UNION ALL SELECT * FROM raw_tx WHERE amount > 50000)
SELECT merchant_country, count(*) AS n, {MONEY.format('amount')} AS amount FROM u GROUP BY merchant_country""")
def union_transactions(spark, d):
    tx = tt.order_raw_transactions(spark, d)
    both = relational.union_all([tx, tx.filter(F.col("amount") > 50000)])
    return both.groupBy("merchant_country").agg(
        F.count(F.lit(1)).alias("n"), S.exact_sum(F.col("amount")).alias("amount"))


@query("merchants_from_text", f"WITH {MERCHANTS} SELECT * FROM merchants")
def merchants_from_text(spark, d):
    m = tt.order_merchants(spark, d)
    return delimited.parse_businesses(m.select(F.concat_ws("\t", *m.columns).alias("value")))


def _text_group(df: DataFrame) -> DataFrame:
    return df.withColumn("group_text", _group_text(F.col("categorical_group.group"))).withColumn(
        "group_size", F.col("categorical_group.group_size")).drop("categorical_group")


@query("fat_text_lines", f"""WITH {EVENT_FAT}, {GROUP_TEXT_SQL}
SELECT concat(c, chr(9), group_size, chr(9), CAST(amount AS VARCHAR), chr(9), day, chr(9), code, chr(9), bname, chr(9),
              btown, chr(9), coalesce(postcode, '')) AS line, group_text
FROM fat JOIN group_sizes USING (acorn_type_id, online_active) JOIN group_texts USING (acorn_type_id, online_active)""")
def fat_text_lines(spark, d):
    # The order of the buckets inside the text is free, so the group is compared sorted and apart from the line.
    lines = delimited.format_fat(tt.event_fat(spark, d)).select(F.split("value", "\t", -1).alias("p"))
    keep = [F.col("p")[i] for i in (0, 2, 3, 4, 5, 6, 7, 8)]
    return lines.select(F.concat_ws("\t", *keep).alias("line"),
                        F.array_join(F.array_sort(F.split(F.col("p")[1], ",")), ",").alias("group_text"))


FAT_BACK = f"""WITH {EVENT_FAT}, {GROUP_TEXT_SQL}
SELECT c AS masked_customer_id, amount, day AS day_of_week, code AS merchant_category_code, bname AS business_name,
       btown AS business_town, postcode AS business_postcode, group_text, group_size
FROM fat JOIN group_sizes USING (acorn_type_id, online_active) JOIN group_texts USING (acorn_type_id, online_active)"""


@query("fat_text_round_trip", FAT_BACK)
def fat_text_round_trip(spark, d):
    return _text_group(delimited.parse_fat(delimited.format_fat(tt.event_fat(spark, d))))


@query("fat_files", FAT_BACK)
def fat_files(spark, d):
    """The fat table written as text files and read again."""
    path = stage_path(spark)
    delimited.write_fat(tt.event_fat(spark, d), path)
    return _text_group(delimited.read_fat(spark, path))


ROLLUP_SQL = f"""
SELECT c AS masked_customer_id, {MONEY.format('amount')} AS amount_sum, CAST(count(*) AS INT) AS visits,
       min(code) AS merchant_category_code, bname AS business_name, btown AS business_town,
       min(postcode) AS business_postcode, group_text, group_size
FROM {{0}} JOIN group_sizes USING (acorn_type_id, online_active) JOIN group_texts USING (acorn_type_id, online_active)
GROUP BY c, bname, btown, group_text, group_size"""


@query("rollup_text_round_trip", f"WITH {EVENT_FAT}, {GROUP_TEXT_SQL} {ROLLUP_SQL.format('fat')}")
def rollup_text_round_trip(spark, d):
    rolled = relational.customer_business_rollup(tt.event_fat(spark, d))
    return _text_group(delimited.parse_rollup(delimited.format_rollup(rolled)))


@query("rollup_files", f"WITH {EVENT_FAT}, {GROUP_TEXT_SQL} {ROLLUP_SQL.format('fat')}")
def rollup_files(spark, d):
    path = stage_path(spark)
    delimited.write_rollup(relational.customer_business_rollup(tt.event_fat(spark, d)), path)
    return _text_group(delimited.read_rollup(spark, path))


# Scalar functions ------------------------------------------------------------------------------------


@query("scalars_text", """
SELECT c_custkey, nullif(t, '') AS empty_to_null, TRY_CAST(nullif(trim(t), '') AS INT) AS trimmed_int,
       CASE WHEN regexp_matches(o, '^[0-9]+$') THEN CAST(o AS INT) END AS digits, c_nationkey = 1 AS flag,
       upper(trim(' ' || c_mktsegment || ' ')) AS match_key, substr(c_name, 1, length(c_name) - 2) AS sector,
       CASE WHEN length(p) > 0 THEN substr(p, 1, greatest(length(p) - 3, 0)) ELSE '$NONE_POSTCODE$' END AS district,
       concat(c_name, '_', c_mktsegment, '_', coalesce(p, '')) AS business
FROM (SELECT *, CASE WHEN c_nationkey > 12 THEN ' ' || c_nationkey ELSE '' END AS t,
             CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '4a' END AS o,
             CASE WHEN c_nationkey > 4 THEN substr(c_name, 1, c_nationkey) END AS p FROM customer)""")
def scalars_text(spark, d):
    c = tt.table(spark, d, "customer")
    n = F.col("c_nationkey").cast("string")
    t = F.when(F.col("c_nationkey") > 12, F.concat(F.lit(" "), n)).otherwise(F.lit(""))
    o = F.when(F.col("c_acctbal") > 0, n).otherwise(F.lit("4a"))
    p = F.when(F.col("c_nationkey") > 4, F.substring(F.col("c_name"), F.lit(1), F.col("c_nationkey")))
    return c.select(
        "c_custkey", S.empty_to_null(t).alias("empty_to_null"), S.trimmed_int(t).alias("trimmed_int"),
        S.digits_only_int(o).alias("digits"), S.flag(F.col("c_nationkey")).alias("flag"),
        S.match_key(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" "))).alias("match_key"),
        S.postcode_sector(F.col("c_name")).alias("sector"), S.postcode_district(p).alias("district"),
        S.business_id(F.col("c_name"), F.col("c_mktsegment"), p).alias("business"))


@query("scalars_numbers", """
SELECT o_orderkey, CAST(isodow(o_orderdate) AS INT) AS iso_day, CAST(floor(v + 0.5) AS BIGINT) AS half_up,
       CAST(trunc(v) AS BIGINT) AS truncated,
       make_timestamp(o_orderkey * 1000000000) AS millis
FROM (SELECT *, (o_totalprice - 200000) / 4 AS v FROM orders)""")
def scalars_numbers(spark, d):
    v = (F.col("o_totalprice") - 200000) / 4
    return tt.table(spark, d, "orders").select(
        "o_orderkey", S.iso_day_of_week(F.col("o_orderdate")).alias("iso_day"), S.round_half_up(v).alias("half_up"),
        S.truncate(v).alias("truncated"),
        S.epoch_millis_to_timestamp(F.col("o_orderkey") * 1000000).cast("timestamp_ntz").alias("millis"))


@query("group_attributes", f"""WITH {GROUPS},
sets AS (SELECT acorn_type_id, online_active,
                string_agg(DISTINCT CAST(marital_status_id AS VARCHAR), ',' ORDER BY CAST(marital_status_id AS VARCHAR)) AS marital,
                min(gender) AS gender, string_agg(DISTINCT gender, ',' ORDER BY gender) AS genders,
                count(DISTINCT coalesce(occupation_id, -1)) AS occupations, count(*) AS buckets
         FROM members GROUP BY ALL)
SELECT customer_id, coalesce(s.marital, '') AS marital, s.gender, s.genders, CAST(s.occupations AS INT) AS occupations,
       CAST(s.buckets AS INT) AS buckets
FROM customers JOIN sets s USING (acorn_type_id, online_active)""")
def group_attributes(spark, d):
    g = F.col("categorical_group")
    return tt.region_groups(spark, d).select(
        "customer_id", S.set_to_id(S.group_attribute(g, "marital_status_id")).alias("marital"),
        S.first_gender(S.group_attribute(g, "gender")).alias("gender"),
        S.set_to_id(S.group_attribute(g, "gender")).alias("genders"),
        F.size(S.group_attribute(g, "occupation_id")).alias("occupations"), F.size("categorical_group.group").alias("buckets"))


def _spend_maps(spark, d) -> DataFrame:
    """Per customer: spend per event type, and rows per event type of high amounts, as maps."""
    e = tt.table(spark, d, "events")
    per = e.groupBy("user_id", "event_type").agg(
        S.exact_sum(F.col("value")).alias("spend"), F.sum((F.col("value") > 50).cast("double")).alias("high"))
    pairs = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", c))))
    return per.groupBy("user_id").agg(
        pairs("spend").alias("spend"), F.map_filter(pairs("high"), lambda _, v: v > 2).alias("high"))


PER_TYPE = """per AS (SELECT user_id, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS spend,
  CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS DOUBLE) AS high FROM events GROUP BY ALL)"""


@query("map_normalise_and_dot", f"""WITH {PER_TYPE}
SELECT user_id, round(max(spend) / sum(spend), 6) AS largest_share,
       round(coalesce(sum(CASE WHEN high > 2 THEN spend * high END), 0), 2) AS dot,
       CAST(count(CASE WHEN high > 2 THEN 1 END) AS INT) AS shared FROM per GROUP BY user_id""")
def map_normalise_and_dot(spark, d):
    m = _spend_maps(spark, d)
    return m.select(
        "user_id", F.round(F.array_max(F.map_values(S.map_normalize(F.col("spend")))), 6).alias("largest_share"),
        F.round(S.map_dot(F.col("spend"), F.col("high")), 2).alias("dot"),
        F.size(S.map_join(F.col("spend"), F.col("high"))).alias("shared"))


@query("map_flat_keys", f"""WITH {PER_TYPE}
SELECT user_id, unnest([event_type, upper(event_type)]) AS key, spend FROM per""")
def map_flat_keys(spark, d):
    both = S.map_flat_keys(F.col("spend"), lambda k: F.array(k, F.upper(k)))
    return _spend_maps(spark, d).select("user_id", F.explode(both).alias("e")).select(
        "user_id", F.col("e.key").alias("key"), F.col("e.value").alias("spend"))


@query("array_product", f"""WITH {PER_TYPE}
SELECT a.user_id, a.event_type AS a, b.event_type AS b FROM per a JOIN per b ON a.user_id = b.user_id AND b.high > 2""")
def array_product(spark, d):
    pairs = S.array_product(F.map_keys("spend"), F.map_keys("high"))
    return _spend_maps(spark, d).select("user_id", F.explode(pairs).alias("p")).select(
        "user_id", F.col("p.left").alias("a"), F.col("p.right").alias("b"))


@query("hamming_buckets", f"""WITH {RAW_CUSTOMERS}
SELECT customer_id, CAST((online_active IS DISTINCT FROM TRUE)::INT + (acorn_type_id IS DISTINCT FROM 2)::INT
  + (gender IS DISTINCT FROM 'BUILDING')::INT + (marital_status_id IS DISTINCT FROM NULL)::INT
  + (occupation_id IS DISTINCT FROM 4)::INT AS INT) AS distance FROM customers""")
def hamming_buckets(spark, d):
    probe = [F.lit(True), F.lit(2), F.lit("BUILDING"), F.lit(None).cast("int"), F.lit(4)]
    return tt.customer_buckets(spark, d).select(
        "customer_id", S.hamming([F.col(f) for f in BUCKET_FIELDS], probe).alias("distance"))


BOX_SQL = """boxes AS (
  SELECT l_suppkey, l_returnflag, CAST(min(floor(l_quantity)) AS BIGINT) AS q0, CAST(max(floor(l_quantity)) AS BIGINT) AS q1,
         CAST(min(floor(l_extendedprice)) AS BIGINT) AS p0, CAST(max(floor(l_extendedprice)) AS BIGINT) AS p1
  FROM lineitem GROUP BY ALL)"""


def _boxes(spark, d) -> DataFrame:
    value = lambda c: F.floor(c).cast("bigint")
    box = lambda c: F.struct(F.min(value(c)).alias("start"), F.max(value(c)).alias("end"))
    return tt.table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        box("l_quantity").alias("q"), box("l_extendedprice").alias("p"))


@query("box_gap_distance", f"""WITH {BOX_SQL}
SELECT a.l_suppkey, a.l_returnflag, round(sqrt(
   CAST(least(abs(a.q0 - b.q1), abs(a.q1 - b.q0)) AS DOUBLE) ** 2 + CAST(least(abs(a.p0 - b.p1), abs(a.p1 - b.p0)) AS DOUBLE) ** 2), 6)
   AS distance
FROM boxes a JOIN boxes b ON a.l_suppkey = b.l_suppkey AND b.l_returnflag = 'A'""")
def box_gap_distance(spark, d):
    boxes = _boxes(spark, d)
    other = boxes.filter("l_returnflag = 'A'").select("l_suppkey", F.col("q").alias("oq"), F.col("p").alias("op"))
    distance = S.end_gap_distance([F.col("q"), F.col("p")], [F.col("oq"), F.col("op")])
    return boxes.join(other, "l_suppkey").select("l_suppkey", "l_returnflag", F.round(distance, 6).alias("distance"))


@query("box_union", f"""WITH {BOX_SQL}
SELECT l_returnflag, min(q0) AS q_start, max(q1) AS q_end, min(p0) AS p_start, max(p1) AS p_end FROM boxes GROUP BY ALL""")
def box_union(spark, d):
    u = _boxes(spark, d).groupBy("l_returnflag").agg(
        S.range_union(F.col("q")).alias("q"), S.range_union(F.col("p")).alias("p"))
    return u.select("l_returnflag", F.col("q.start").alias("q_start"), F.col("q.end").alias("q_end"),
                    F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"))


@query("dense_dot", """
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)),
       lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6) AS dot FROM embeddings""")
def dense_dot(spark, d):
    return tt.table(spark, d, "embeddings").select(
        "vec_id", F.round(S.dense_dot(F.col("embedding"), F.reverse("embedding")), 6).alias("dot"))


# Filters ---------------------------------------------------------------------------------------------


def _flat(df: DataFrame) -> DataFrame:
    return df.drop("categorical_group")


FLAT = """c AS masked_customer_id, amount, day AS day_of_week, code AS merchant_category_code, bname AS business_name,
  btown AS business_town, postcode AS business_postcode"""


@query("bad_town_filter", f"WITH {ORDER_FAT} SELECT {FLAT} FROM fat WHERE {BAD_SQL}")
def bad_town_filter(spark, d):
    return _flat(cleaning.drop_bad_towns(tt.order_joined(spark, d), BAD))


@query("listed_town_filter", f"""WITH {ORDER_FAT}, lits AS (SELECT DISTINCT substr(n_name, 4) AS literal FROM nation WHERE n_regionkey < 3)
SELECT {FLAT} FROM fat WHERE NOT EXISTS (SELECT 1 FROM lits WHERE contains(btown, literal))""")
def listed_town_filter(spark, d):
    """The town filter with its list as a table."""
    literals = tt.table(spark, d, "nation").filter("n_regionkey < 3").select(F.substring("n_name", 4, 99).alias("literal"))
    return _flat(cleaning.drop_listed_towns(tt.order_joined(spark, d), literals))


ACTIVE = f"""
good AS (SELECT * FROM fat WHERE {BAD_SQL}),
active_c AS (SELECT c, count(*) AS n FROM good GROUP BY c HAVING count(*) > 35),
active_b AS (SELECT bname, btown, count(*) AS n FROM good GROUP BY bname, btown HAVING count(*) > 100),
cleaned AS (SELECT * FROM good WHERE c IN (SELECT c FROM active_c)
            AND (bname, btown) IN (SELECT (bname, btown) FROM active_b))"""


def _cleaned(spark, d, read=tt.order_joined):
    return cleaning_plan.clean(read(spark, d), min_per_business=100, min_per_customer=35, towns=BAD)


@query("active_customers", f"WITH {ORDER_FAT}, {ACTIVE} SELECT c AS masked_customer_id, n FROM active_c")
def active_customers(spark, d):
    return cleaning.active_customers(cleaning.drop_bad_towns(tt.order_joined(spark, d), BAD), 35)


@query("active_businesses", f"WITH {ORDER_FAT}, {ACTIVE} SELECT bname AS business_name, btown AS business_town, n FROM active_b")
def active_businesses(spark, d):
    return cleaning.active_businesses(cleaning.drop_bad_towns(tt.order_joined(spark, d), BAD), 100)


@query("cleaned_transactions", f"WITH {ORDER_FAT}, {ACTIVE} SELECT {FLAT} FROM cleaned")
def cleaned_transactions(spark, d):
    return _flat(_cleaned(spark, d))


@query("customer_business_rollup",
       f"WITH {ORDER_FAT}, {ACTIVE}, {GROUP_TEXT_SQL} {ROLLUP_SQL.format('cleaned')}")
def customer_business_rollup(spark, d):
    return _text_group(cleaning_plan.clean_rollup(
        tt.order_fat(spark, d), min_per_business=100, min_per_customer=35, towns=BAD))


@query("min_visit_pairs", f"""WITH {EVENT_FAT} SELECT c AS masked_customer_id, bname AS business_name,
btown AS business_town, count(*) AS visits FROM fat GROUP BY ALL HAVING count(*) >= 2""")
def min_visit_pairs(spark, d):
    return relational.min_visit_pairs(tt.event_joined(spark, d), 2)


@query("with_postcode", f"WITH {EVENT_FAT} SELECT {FLAT} FROM fat WHERE postcode IS NOT NULL")
def with_postcode(spark, d):
    return _flat(cleaning.with_postcode(tt.event_joined(spark, d)))


@query("semi_and_anti_join", f"""WITH {ORDER_FAT}, k AS (SELECT DISTINCT bname, btown FROM fat WHERE amount > 90000)
SELECT (bname, btown) IN (SELECT (bname, btown) FROM k) AS expensive, count(*) AS n FROM fat GROUP BY ALL""")
def semi_and_anti_join(spark, d):
    fat = tt.order_joined(spark, d)
    keys = fat.filter("amount > 90000").select(*BUSINESS_KEY).distinct()
    count = lambda df, value: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(value).alias("expensive"), "n")
    return count(relational.semi_join(fat, keys, BUSINESS_KEY), True).unionByName(
        count(relational.anti_join(fat, keys, BUSINESS_KEY), False)).filter("n > 0")


# Joins -----------------------------------------------------------------------------------------------


@query("join_customers", f"""WITH {RAW_CUSTOMERS}, {ORDER_TX},
masks AS (SELECT customer_id, row_number() OVER (ORDER BY md5('1|' || customer_id), customer_id) - 1 AS masked_customer_id
          FROM (SELECT DISTINCT customer_id FROM raw_tx))
SELECT r.*, gender, acorn_type_id, masked_customer_id
FROM raw_tx r JOIN customers USING (customer_id) JOIN masks USING (customer_id) WHERE balance IS NOT NULL""")
def join_customers(spark, d):
    c = tt.raw_customers(spark, d).filter("balance is not null").select("customer_id", "gender", "acorn_type_id")
    transactions = tt.order_raw_transactions(spark, d)
    return fat_plan.join_customers(transactions, c, mask_ids(transactions))


@query("join_merchants", f"""WITH {ORDER_TX}, {MERCHANTS},
keyed AS (SELECT *, upper(trim(merchant_name)) AS kn, upper(trim(merchant_town)) AS kt FROM raw_tx)
SELECT k.merchant_country, k.merchant_category_code, amount, date, customer_id, coalesce(name, kn) AS business_name,
       coalesce(town, kt) AS business_town, postcode AS business_postcode
FROM keyed k LEFT JOIN merchants m ON kn = m.merchant_name AND kt = m.merchant_town""")
def join_merchants(spark, d):
    return fat_plan.join_merchants(tt.order_raw_transactions(spark, d), tt.order_merchants(spark, d))


# Aggregates ------------------------------------------------------------------------------------------


@query("count_by", f"WITH {RAW_CUSTOMERS} SELECT gender, acorn_type_id, count(*) AS n FROM customers GROUP BY ALL")
def count_by(spark, d):
    return relational.count_by(tt.customer_buckets(spark, d), ["gender", "acorn_type_id"])


@query("latest_customer", """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_customer(spark, d):
    o = tt.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return relational.latest_by(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("latest_customers", f"""WITH {RAW_CUSTOMERS}
SELECT c.* REPLACE (o_totalprice AS balance) FROM customers c JOIN orders ON o_custkey = customer_id
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY o_orderdate DESC, o_totalprice DESC) = 1""")
def latest_customers(spark, d):
    """A snapshot of the customer for each order, dated by it."""
    orders = tt.table(spark, d, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("summary_date"), F.col("o_totalprice").alias("balance"))
    return fat_plan.latest_customers(tt.raw_customers(spark, d).drop("balance").join(orders, "customer_id"))


@query("distinct_pairs", f"""WITH {EVENT_FAT} SELECT DISTINCT c AS masked_customer_id, bname AS business_name,
btown AS business_town FROM fat""")
def distinct_pairs(spark, d):
    return relational.customer_business_pairs(tt.event_joined(spark, d))


@query("multi_map", f"""WITH {EVENT_FAT}
SELECT c AS masked_customer_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM fat GROUP BY c""")
def multi_map(spark, d):
    m = relational.multi_map(tt.event_joined(spark, d), "masked_customer_id", "merchant_category_code", "codes")
    return m.withColumn("codes", F.array_join("codes", ","))


@query("reduce_by_key", f"""WITH {EVENT_FAT}
SELECT code AS merchant_category_code, max(amount) AS highest, {MONEY.format('amount')} AS total FROM fat GROUP BY code""")
def reduce_by_key(spark, d):
    return relational.reduce_by_key(
        tt.event_joined(spark, d), ["merchant_category_code"], highest=F.max("amount"),
        total=S.exact_sum(F.col("amount")))


@query("popularity", f"""WITH {EVENT_FAT} SELECT bname AS business_name, btown AS business_town,
count(DISTINCT c) AS customers FROM fat GROUP BY ALL""")
def popularity(spark, d):
    return relational.popularity(tt.event_joined(spark, d))


@query("popular_businesses", f"""WITH {EVENT_FAT} SELECT bname AS business_name, btown AS business_town,
count(DISTINCT c) AS customers FROM fat GROUP BY ALL ORDER BY customers DESC, bname, btown LIMIT 20""")
def popular_businesses(spark, d):
    return relational.popular_businesses(tt.event_joined(spark, d), 20)


@query("stat_counter", """
SELECT l_suppkey, count(l_extendedprice) AS count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum,
       round(sum(l_extendedprice * l_extendedprice) / 1e6, 3) AS sum_of_squares_m,
       round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean,
       round(coalesce(var_samp(l_extendedprice), 'NaN'::DOUBLE) / 1e6, 4) AS variance_m,
       round(coalesce(stddev_samp(l_extendedprice), 'NaN'::DOUBLE), 4) AS stdev, min(l_extendedprice) AS min,
       max(l_extendedprice) AS max, round(coalesce(stddev_samp(l_extendedprice), 'NaN'::DOUBLE) / sqrt(count(*)), 4) AS stderr
FROM lineitem GROUP BY l_suppkey""")
def stat_counter(spark, d):
    s = statistics.stat_counter(tt.table(spark, d, "lineitem"), "l_extendedprice", ["l_suppkey"])
    rounded = lambda c: F.round(c, 4).alias(c)
    return s.select(
        "l_suppkey", "count", F.round("sum", 2).alias("sum"), F.round(F.col("sum_of_squares") / 1e6, 3).alias("sum_of_squares_m"),
        rounded("mean"), F.round(F.col("variance") / 1e6, 4).alias("variance_m"), rounded("stdev"), "min", "max",
        rounded("stderr"))


def _merged_statistics(lines: DataFrame, value: str, key: str) -> DataFrame:
    """Statistics of a table from stored states of its loads, one for each quarter."""
    loads = [lines.filter(F.coalesce(F.quarter("l_shipdate"), F.lit(0)) == q) for q in range(5)]
    stored = [stage_table(partials.stat_states(load, value, [key])) for load in loads]
    return partials.state_statistics(partials.merge_states(relational.union_all(stored), [key]), [key])


@query("merged_stat_states", """
SELECT l_suppkey, count(l_extendedprice) AS count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum,
       round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean,
       round(coalesce(var_samp(l_extendedprice), 'NaN'::DOUBLE) / 1e6, 4) AS variance_m,
       round(coalesce(stddev_samp(l_extendedprice), 'NaN'::DOUBLE), 4) AS stdev, min(l_extendedprice) AS min,
       max(l_extendedprice) AS max, round(coalesce(stddev_samp(l_extendedprice), 'NaN'::DOUBLE) / sqrt(count(*)), 4) AS stderr
FROM lineitem GROUP BY l_suppkey""")
def merged_stat_states(spark, d):
    s = _merged_statistics(tt.table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_shipdate"), "l_extendedprice", "l_suppkey")
    rounded = lambda c: F.round(c, 4).alias(c)
    return s.select(
        "l_suppkey", "count", F.round("sum", 2).alias("sum"), rounded("mean"), F.round(F.col("variance") / 1e6, 4).alias("variance_m"),
        rounded("stdev"), "min", "max", rounded("stderr"))


@query("merged_stat_states_far_from_zero", """
WITH v AS (SELECT l_suppkey, 1e9::DOUBLE + l_discount / 100 AS v FROM lineitem)
SELECT l_suppkey, count(v) AS count, round(var_samp(v - 1e9::DOUBLE) * 1e9, 3) AS variance_n, min(v) AS min, max(v) AS max
FROM v GROUP BY l_suppkey""")
def merged_stat_states_far_from_zero(spark, d):
    """Means of a thousand million, deviations below a thousandth."""
    lines = tt.table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", (F.lit(1e9) + F.col("l_discount") / 100).alias("v"))
    return _merged_statistics(lines, "v", "l_suppkey").select(
        "l_suppkey", "count", F.round(F.col("variance") * 1e9, 3).alias("variance_n"), "min", "max")


@query("stat_counter_fine", """
WITH v AS (SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN value / 1000 END AS v FROM events)
SELECT user_id, count(v) AS count, round(coalesce(sum(v), 0.0), 7) AS sum, round(coalesce(avg(v), 'NaN'::DOUBLE), 7) AS mean,
       round(coalesce(stddev_samp(v), 'NaN'::DOUBLE), 7) AS stdev, coalesce(min(v), 'NaN'::DOUBLE) AS min,
       round(CASE WHEN count(v) > 0 THEN coalesce(stddev_samp(v), 'NaN'::DOUBLE) / sqrt(count(v)) ELSE 'NaN'::DOUBLE END, 7) AS stderr
FROM v GROUP BY user_id""")
def stat_counter_fine(spark, d):
    """Values with more than two decimals, and keys without any value."""
    events = tt.table(spark, d, "events").select("user_id", F.when(F.col("user_id") % 7 != 0, F.col("value") / 1000).alias("v"))
    rounded = lambda c: F.round(c, 7).alias(c)
    return statistics.stat_counter(events, "v", ["user_id"]).select(
        "user_id", "count", rounded("sum"), rounded("mean"), rounded("stdev"), "min", rounded("stderr"))


@query("max_rows_with_ties", """
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT * FROM n QUALIFY rank() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def max_rows_with_ties(spark, d):
    n = relational.count_by(tt.table(spark, d, "events"), ["user_id", "event_type"])
    return ranking.max_rows(n, ["user_id"], "n")


@query("min_rows_with_ties", """
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT * FROM n QUALIFY rank() OVER (PARTITION BY user_id ORDER BY n) = 1""")
def min_rows_with_ties(spark, d):
    n = relational.count_by(tt.table(spark, d, "events"), ["user_id", "event_type"])
    return ranking.min_rows(n, ["user_id"], "n")


@query("arg_max_and_min", """
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
hi AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1),
lo AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n, event_type) = 1)
SELECT hi.user_id, hi.event_type AS most, hi.n AS most_n, lo.event_type AS least, lo.n AS least_n
FROM hi JOIN lo USING (user_id)""")
def arg_max_and_min(spark, d):
    n = relational.count_by(tt.table(spark, d, "events"), ["user_id", "event_type"])
    most = ranking.arg_max(n, ["user_id"], "event_type", "n").toDF("user_id", "most", "most_n")
    least = ranking.arg_min(n, ["user_id"], "event_type", "n").toDF("user_id", "least", "least_n")
    return most.join(least, "user_id")


@query("max_rows_of_table", "SELECT * FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)")
def max_rows_of_table(spark, d):
    return ranking.max_rows(tt.table(spark, d, "part"), [], "p_retailprice")


@query("row_counts", f"""WITH {ORDER_FAT}, {ACTIVE} SELECT 'all' AS stage, count(*) AS rows FROM fat
UNION ALL SELECT 'cleaned', count(*) FROM cleaned""")
def row_counts(spark, d):
    return relational.row_counts({"all": tt.order_joined(spark, d), "cleaned": _cleaned(spark, d)})


@query("table_differences", """
SELECT * FROM (SELECT o_custkey, o_orderpriority, 'left' AS side FROM
  (SELECT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 100000 EXCEPT ALL
   SELECT o_custkey, o_orderpriority FROM orders WHERE o_totalprice < 300000)
UNION ALL SELECT o_custkey, o_orderpriority, 'right' FROM
  (SELECT o_custkey, o_orderpriority FROM orders WHERE o_totalprice < 300000 EXCEPT ALL
   SELECT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 100000))""")
def table_differences(spark, d):
    o = tt.table(spark, d, "orders")
    some = lambda rule: o.filter(rule).select("o_custkey", "o_orderpriority")
    return relational.same_rows(some("o_totalprice > 100000"), some("o_totalprice < 300000"))


# Ranking ---------------------------------------------------------------------------------------------


@query("top_n_per_key", f"""WITH {ORDER_TX}, s AS (
  SELECT customer_id, merchant_name, {MONEY.format('amount')} AS spend FROM raw_tx GROUP BY ALL)
SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY round(spend, 9) DESC, merchant_name) AS INT) AS rank,
       merchant_name, spend FROM s QUALIFY rank <= 5""")
def top_n_per_key(spark, d):
    s = tt.order_raw_transactions(spark, d).groupBy("customer_id", "merchant_name").agg(
        S.exact_sum(F.col("amount")).alias("spend"))
    return ranking.top_n(s, ["customer_id"], "spend", 5, ["merchant_name"])


@query("percentile_bins", """
WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n
           FROM lineitem),
b AS (SELECT b, CAST(floor(CAST(b AS DOUBLE) * (CAST(n AS DOUBLE) / 100.0)) AS BIGINT) AS i
      FROM (SELECT unnest(range(100)) AS b), (SELECT count(*) AS n FROM lineitem))
SELECT CAST(b AS INT) AS point, v AS value FROM b JOIN s USING (i)""")
def percentile_bins(spark, d):
    return ranking.percentile_bins(tt.table(spark, d, "lineitem"), "l_extendedprice", 100)


@query("exact_median", "SELECT median(l_extendedprice) AS median FROM lineitem")
def exact_median(spark, d):
    return ranking.exact_median(tt.table(spark, d, "lineitem"), "l_extendedprice")


@query("dense_ids", """
SELECT o_custkey, row_number() OVER (ORDER BY md5('7|' || o_custkey), o_custkey) - 1 AS number
FROM (SELECT DISTINCT o_custkey FROM orders)""")
def dense_ids(spark, d):
    return ranking.number_rows(tt.table(spark, d, "orders"), ["o_custkey"], "7")


@query("range_similarity_hamming", f"""WITH {RAW_CUSTOMERS},
b AS (SELECT DISTINCT online_active, acorn_type_id, gender, marital_status_id, occupation_id,
  concat_ws(',', CASE WHEN online_active THEN 'true' ELSE 'false' END, acorn_type_id, gender,
    coalesce('Some(' || marital_status_id || ')', 'None'), coalesce('Some(' || occupation_id || ')', 'None')) AS bucket FROM customers),
p AS (SELECT a.bucket, o.bucket AS other, CAST((a.online_active IS DISTINCT FROM o.online_active)::INT
  + (a.acorn_type_id IS DISTINCT FROM o.acorn_type_id)::INT + (a.gender IS DISTINCT FROM o.gender)::INT
  + (a.marital_status_id IS DISTINCT FROM o.marital_status_id)::INT
  + (a.occupation_id IS DISTINCT FROM o.occupation_id)::INT AS INT) AS distance FROM b a, b o)
SELECT * FROM p WHERE distance <= 2""")
def range_similarity_hamming(spark, d):
    buckets = tt.customer_buckets(spark, d).select(*BUCKET_FIELDS).distinct().withColumn("bucket", bucket_text())
    return similarity.hamming_range_pairs(buckets, BUCKET_FIELDS, "bucket", 2)


@query("conditional_and_tapped_steps", """
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority""")
def conditional_and_tapped_steps(spark, d):
    orders = relational.tap(tt.table(spark, d, "orders"), "orders")
    kept = relational.apply_if(orders, True, lambda df: df.filter("o_totalprice > 100000"))
    same = relational.apply_if(kept, False, lambda df: df.limit(0))
    return relational.count_by(same, ["o_orderpriority"])
