import pytest
from pyspark.sql import functions as F

from tillsight.operators.relational import customer_business_rollup, same_rows
from tillsight.plans.cleaning import cleaning_job
from tillsight.plans.exploration import exploration_job
from tillsight.plans.fat_table import database_job, fat_table_job
from tillsight.sources import delimited, jdbc
from tillsight.sources.schema import CATEGORICAL_GROUP, RAW_BUSINESS, RAW_CUSTOMER, RAW_TRANSACTION

FAT = ("masked_customer_id long, categorical_group struct<group:array<struct<online_active:boolean,acorn_type_id:int,"
       "gender:string,marital_status_id:int,occupation_id:int>>,group_size:int>, amount double, day_of_week int, "
       "merchant_category_code string, business_name string, business_town string, business_postcode string")
GROUP = ([(False, 8, "F", None, 4), (True, 28, "M", 2, None)], 12)
ROWS = [(1, GROUP, 12.5, 3, "5411", 'THE "OLD" SHOP', "BATH", None), (2, GROUP, 0.1, 7, "", "X, Y | Z", "", "BS1 4DJ")]
LINE = '1\tfalse|8|F||4,true|28|M|2|\t12\t12.5\t3\t5411\tTHE "OLD" SHOP\tBATH\t'


def fat(spark):
    return spark.createDataFrame(ROWS, FAT)


def test_layout(spark):
    assert delimited.format_fat(fat(spark)).first()["value"] == LINE


def test_file_round_trip_overwrites(spark, tmp_path):
    path = str(tmp_path / "fat")
    for _ in range(2):
        delimited.write_fat(fat(spark), path)
    assert same_rows(delimited.read_fat(spark, path), fat(spark)).count() == 0


def test_other_separators(spark, tmp_path):
    seps = dict(sep="||", list_sep=";", bucket_sep="+")
    delimited.write_fat(fat(spark), str(tmp_path / "fat"), **seps)
    assert same_rows(delimited.read_fat(spark, str(tmp_path / "fat"), **seps), fat(spark)).count() == 0


def test_rollup_round_trip(spark, tmp_path):
    rolled = customer_business_rollup(fat(spark).unionAll(fat(spark)))
    delimited.write_rollup(rolled, str(tmp_path / "rolled"))
    back = delimited.read_rollup(spark, str(tmp_path / "rolled"))
    assert same_rows(back, rolled.select(back.columns)).count() == 0
    assert {(r["masked_customer_id"], r["amount_sum"], r["visits"]) for r in back.collect()} == {(1, 25.0, 2), (2, 0.2, 2)}


@pytest.mark.parametrize("line", [LINE + "\textra", "1\t2", "", LINE.replace("|2|", "|2")])
def test_malformed_line_stops(spark, line):
    with pytest.raises(Exception, match="fields in"):
        delimited.parse_fat(spark.createDataFrame([(line,)], "value string")).collect()


def test_merchants_keep_trailing_empties(spark, tmp_path):
    (tmp_path / "m.txt").write_text("A\tB\tC\t\t\n")
    assert [tuple(r) for r in delimited.read_businesses(spark, str(tmp_path / "m.txt")).collect()] == [("A", "B", "C", "", "")]


def test_jdbc_options():
    options = jdbc.jdbc_options("jdbc:x", "d", "u", "p", "t", "ID", 1, 9, 12)
    assert options == {"url": "jdbc:x", "driver": "d", "user": "u", "password": "p", "dbtable": "t",
                       "partitionColumn": "ID", "lowerBound": "1", "upperBound": "9", "numPartitions": "12"}


def test_one_scan_per_listed_table(spark, monkeypatch):
    asked = []

    def load(_, **options):
        asked.append((options["table"], options["lower"], options["partitions"]))
        return spark.createDataFrame(
            [(1, "2020-01-06", 5, "n", "t", 1.5, "GB", "5411")], "a long, b string, c int, d string, e string, f double, g string, h string")

    monkeypatch.setattr(jdbc, "load_table", load)
    tx = jdbc.load_transactions(spark, "one, two", lower=7, url="", driver="", user="", password="")
    assert asked == [("one", 7, 20), ("two", 7, 20)] and tx.count() == 2
    assert tx.schema.names == RAW_TRANSACTION.names and tx.schema["date"].dataType == RAW_TRANSACTION["date"].dataType


def test_jobs_end_to_end(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    snapshots = spark.createDataFrame(
        [("2015-01-01", i, 1.0, 30, True, 5.0, 9.0, None, 1, "F", 1, None) for i in range(4)]
        + [("2015-02-01", i, 2.0, 31, False, 5.0, 9.0, None, 1, "F", 1, None) for i in range(4)],
        "summary_date string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_CUSTOMER))
    tx = spark.createDataFrame(
        [(" shop ", "bath", "GB", "5411", 2.5, "2026-12-01", i % 6) for i in range(24)],
        "merchant_name string, merchant_town string, merchant_country string, merchant_category_code string, amount double, "
        "date string, customer_id long").withColumn("date", F.to_date("date"))
    merchants = spark.createDataFrame([("SHOP", "BATH", "The Shop", "Bath", "BA1 1AA"), ("shop", "bath", "-", "-", "-")], RAW_BUSINESS)
    fat_table_job(tx, snapshots, merchants, path("fat"), k=3)
    table = delimited.read_fat(spark, path("fat"))
    assert table.count() == 16  # customers 4 and 5 are unknown
    row = table.first()
    assert (row["business_name"], row["business_postcode"], row["day_of_week"]) == ("The Shop", "BA1 1AA", 2)
    assert [tuple(b)[0] for b in row["categorical_group"]["group"]] == [False]  # the later snapshot
    assert table.schema["categorical_group"].dataType.simpleString() == CATEGORICAL_GROUP.simpleString()
    cleaning_job(table, path("clean"), path("rolled"), min_per_business=15, min_per_customer=3)
    assert delimited.read_rollup(spark, path("rolled")).agg(F.sum("visits")).first()[0] == 16
    cleaning_job(table, path("clean"), min_per_business=16)
    assert delimited.read_fat(spark, path("clean")).count() == 0
    exploration_job(table, path("stats"), path("stats_text"))
    stats = spark.read.parquet(path("stats"))
    assert stats.select("stat").distinct().count() == 17
    assert stats.filter("stat = 'unique customers'").select("value").distinct().collect() == [(4,)]
    assert spark.read.csv(path("stats_text"), sep="\t", header=True).count() == stats.count()


def test_fat_table_from_a_database(spark, tmp_path, monkeypatch):
    customers = spark.createDataFrame(
        [("2020-01-01", i, "1.50", 30, 1, "5.0", 9, "X1", 1, "F", " 2 ", "n/a") for i in range(3)],
        "SUMMARY_DATE string, CUSTOMER_IDENTIFIER long, CA_AVG_CLEARED_BALANCE_AMT string, AGE int, ONLINE_ACTIVE int, "
        "CUSTOMER_INCOME string, GROSS_INCOME_AMOUNT int, POSTAL_SECTOR string, ACORN_TYPE_ID int, SEX_INDICATOR string, "
        "MARITAL_STATUS_CODE string, OCCUPATION_CODE string")
    bought = spark.createDataFrame(
        [(i, "2020-01-06", 5, "n", "t", 1.5, "GB", "5411") for i in range(5)],
        "a long, b string, c int, d string, e string, f double, g string, h string")
    monkeypatch.setattr(jdbc, "load_table", lambda _, **o: customers if o["table"] == "customers" else bought)
    (tmp_path / "m.txt").write_text("N\tT\tThe N\tTown\tT1 1TT\n")
    database_job(spark, "one,two", "customers", str(tmp_path / "m.txt"), str(tmp_path / "fat"), k=3)
    rows = delimited.read_fat(spark, str(tmp_path / "fat")).collect()
    assert len(rows) == 6 and {r["business_name"] for r in rows} == {"The N"}
    assert tuple(rows[0]["categorical_group"]["group"][0]) == (True, 1, "F", 2, None)
