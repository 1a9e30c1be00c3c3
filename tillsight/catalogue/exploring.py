"""The exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.catalogue.base import MONEY, ORDER_FAT, query
from tillsight.operators.partials import sketch_error
from tillsight.operators.relational import union_all
from tillsight.plans.exploration import (SKETCHED, STATISTICS, distinct_exact, distinct_from_partials, distinct_partials, explore,
                                         statistic)
from tillsight.session import stage_table
from tillsight.sources import testtables as tt

_BUSINESS = "concat(bname, '_', btown, '_', coalesce(postcode, ''))"
_DISTRICT = "CASE WHEN length(postcode) > 0 THEN substr(postcode, 1, length(postcode) - 3) ELSE '$NONE_POSTCODE$' END"
_SPEND = MONEY.format("amount")
_MEAN = f"{_SPEND} / count(*)"
_ROUND, _CUT = "CAST(floor(m + 0.5) AS BIGINT)", "CAST(trunc(m) AS BIGINT)"
_AMOUNT = "CAST(floor(amount + 0.5) AS BIGINT)"

# key expression, measure, conversion
_PARTS = {
    "x01": ("1", "count(DISTINCT c)", "m"),
    "x02": ("1", f"count(DISTINCT {_BUSINESS})", "m"),
    "x03": (_BUSINESS, "count(*)", "m"),
    "x04": ("c", "count(*)", "m"),
    "x05": ("marital", "count(*)", "m"),
    "x06": ("marital", _SPEND, _CUT),
    "x07": ("day", _SPEND, _CUT),
    "x08": ("c", _SPEND, _ROUND),
    "x09": (_AMOUNT, "count(DISTINCT c)", "m"),
    "x10": (_BUSINESS, _MEAN, _ROUND),
    "x11": ("c", _MEAN, _ROUND),
    "x12": (_DISTRICT, "count(*)", "m"),
    "x13": (_DISTRICT, _SPEND, _ROUND),
    "x14": (_DISTRICT, _MEAN, _ROUND),
    "x15": (_DISTRICT, "count(DISTINCT code)", "m"),
    "x16": ("code", _MEAN, _ROUND),
    "x17": ("concat(code, '|', gender)", _MEAN, _ROUND),
}


def _sql(number: str) -> str:
    key, measure, conversion = _PARTS[number]
    name, points = STATISTICS[number][0], STATISTICS[number][4]
    return f"""WITH {ORDER_FAT},
sets AS (SELECT acorn_type_id, online_active, min(gender) AS gender, coalesce(string_agg(DISTINCT
           CAST(marital_status_id AS VARCHAR), ',' ORDER BY CAST(marital_status_id AS VARCHAR)), '') AS marital
         FROM members GROUP BY ALL),
wide AS (SELECT * FROM fat JOIN sets USING (acorn_type_id, online_active)),
per_key AS (SELECT {conversion} AS v FROM (SELECT {key} AS key, {measure} AS m FROM wide GROUP BY {key})),
ranked AS (SELECT v, row_number() OVER (ORDER BY v) AS r FROM per_key),
points AS (SELECT i, greatest(1, (i * n + {points - 2}) // {points - 1}) AS r
           FROM (SELECT unnest(range({points})) AS i), (SELECT count(*) AS n FROM per_key))
SELECT '{name}' AS stat, CAST(i AS INT) AS point, CAST(v AS BIGINT) AS value FROM points JOIN ranked USING (r)"""


def _register(number: str) -> None:
    @query(f"eda_{number}", _sql(number))
    def run(spark, d):
        return statistic(tt.order_fat(spark, d), number)


for _number in STATISTICS:
    _register(_number)


def _sketch_sql(number: str) -> str:
    key, measure, _ = _PARTS[number]
    return f"""SELECT '{number}' AS stat, count(*) AS keys, count(CASE WHEN m >= 0 THEN 1 END) AS within
FROM (SELECT {key} AS key, {measure} AS m FROM fat GROUP BY {key})"""


@query("eda_distinct_sketches", f"WITH {ORDER_FAT} " + " UNION ALL ".join(f"({_sketch_sql(n)})" for n in SKETCHED))
def eda_distinct_sketches(spark, d):
    """Distinct counts from stored sketches of two loads: keys, and those whose estimate is within the error of the exact count."""
    fat = stage_table(tt.order_fat(spark, d))
    loads = [fat.filter(F.coalesce(F.col("day_of_week") > 5, F.lit(False))), fat.filter(~F.coalesce(F.col("day_of_week") > 5, F.lit(False)))]
    tables = []
    for number in SKETCHED:
        stored = [stage_table(distinct_partials(load, number)) for load in loads]
        exact = distinct_exact(fat, number).withColumnRenamed("measure", "exact")
        found = distinct_from_partials(stored)
        keys = [c for c in found.columns if c != "measure"]
        both = found.join(exact, keys, "full") if keys else found.crossJoin(F.broadcast(exact))
        near = F.abs(F.col("measure") - F.col("exact")) <= sketch_error() * F.col("exact") + 0.5
        tables.append(both.agg(F.lit(number).alias("stat"), F.count(F.lit(1)).alias("keys"), F.count_if(near).alias("within")))
    return union_all(tables)


@query("eda_all", "\nUNION ALL\n".join(f"SELECT * FROM ({_sql(number)})" for number in STATISTICS))
def eda_all(spark, d):
    return explore(tt.order_fat(spark, d))
