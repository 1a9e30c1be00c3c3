"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

Each paragraph (what lies between line feeds) is hashed to a wide vector, and the vectors of a text are added, every lane modulo a
power of two. So the order of paragraphs does not matter, and a paragraph is put in or taken out by adding or subtracting its vector.

The vector has two parts. 16 lanes modulo 2^32 come from the whole paragraph: they tell texts apart. 128 lanes modulo 2^32 count, for
each pair of neighbouring words of the paragraph, one bit of the pair's hash: they tell how alike two texts are. With the
number of pairs n, a lane c stands for 2c - n, a sum of random signs, and the cosine of two such vectors estimates the cosine of
the texts' pair counts.

Only DataFrame functions are used. Defined results: a null text is empty; an empty text is one empty paragraph. Null ids sort as the
smallest; equal ids are ordered by a hash of the text and the text; repeated rows follow one another. Of one row the next row is itself. An empty
table gives no rows. Other columns are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillsight.llm.catalogue import query, table

#: Longs of the first part (two lanes each) and of the second part.
WHOLE, PAIRS = 8, 64
_LOW = 0xFFFFFFFF
_ONES = 0x100000001
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a range of ids, about, and ranges at most; a range is a window of its own.
RANGE_ROWS, MAX_RANGES = 4096, 65_536


def words_of(paragraph: Column) -> Column:
    return F.split(paragraph, SPACE)


def add_vectors(one: Column, two: Column) -> Column:
    """Sum of two fingerprints (arrays of longs, two lanes each, and the number of pairs last)."""
    return _lanes(one, two, lambda a, b: (a + b).bitwiseAND(F.lit(_LOW)))


def subtract_vectors(one: Column, two: Column) -> Column:
    """What remains of a fingerprint when the paragraphs of another are taken out."""
    return _lanes(one, two, lambda a, b: (a - b).bitwiseAND(F.lit(_LOW)))


def _lanes(one: Column, two: Column, function) -> Column:
    def both(a: Column, b: Column) -> Column:
        high = function(F.shiftrightunsigned(a, 32), F.shiftrightunsigned(b, 32))
        return F.shiftleft(high, 32).bitwiseOR(function(a.bitwiseAND(F.lit(_LOW)), b.bitwiseAND(F.lit(_LOW))))

    return F.zip_with(one, two, both)


def vectors(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys`` and ``vector``: the fingerprint of each row's text. The keys must tell rows apart."""
    paragraphs = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_p"))
    paragraphs = paragraphs.select(
        *keys, F.xxhash64("_p").alias("_one"), F.xxhash64("_p", F.lit(1)).alias("_two"), words_of(F.col("_p")).alias("_w"))
    pairs = paragraphs.select(*keys, "_one", "_two", F.posexplode(F.arrays_zip(
        F.col("_w").alias("a"), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))).alias("b"))).alias("_at", "_pair"))
    worded = (F.col("_pair.a") != "") | (F.col("_pair.b") != "")
    pairs = pairs.select(
        *keys, "_one", "_two", "_at", F.coalesce(worded, F.lit(False)).alias("_worded"),
        F.xxhash64("_pair.a", "_pair.b").alias("_h"))
    pairs = pairs.withColumn("_g", F.xxhash64("_h"))
    sums = []
    for k in range(2 * WHOLE):
        lane = F.xxhash64("_one", "_two", F.lit(k)).bitwiseAND(F.lit(_LOW))
        sums.append(F.sum(F.when(F.col("_at") == 0, lane).otherwise(F.lit(0))).alias(f"_e{k}"))
    for k in range(PAIRS):
        bits = F.shiftrightunsigned(F.col("_h" if k < 32 else "_g"), k % 32).bitwiseAND(F.lit(_ONES))
        sums.append(F.sum(F.when(F.col("_worded"), bits).otherwise(F.lit(0))).alias(f"_l{k}"))
    sums.append(F.sum(F.col("_worded").cast("long")).alias("_n"))
    whole = [F.shiftleft(F.col(f"_e{2 * k}").bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(
        F.col(f"_e{2 * k + 1}").bitwiseAND(F.lit(_LOW))) for k in range(WHOLE)]
    return pairs.groupBy(*keys).agg(*sums).select(
        *keys, F.array(*whole, *[F.col(f"_l{k}") for k in range(PAIRS)], F.col("_n")).alias("vector"))


def as_text(vector: Column) -> Column:
    """The fingerprint in hexadecimal digits, 16 for each long."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(one: Column, two: Column) -> Column:
    """0 to 1: the cosine of two fingerprints' pair lanes; 1 for equal fingerprints, 0 if one of two unequal ones has no words."""
    def signs(vector: Column) -> Column:
        n = F.element_at(vector, -1)
        lanes = F.slice(vector, WHOLE + 1, PAIRS)
        low = F.transform(lanes, lambda x: (2 * x.bitwiseAND(F.lit(_LOW)) - n).cast("double"))
        high = F.transform(lanes, lambda x: (2 * F.shiftrightunsigned(x, 32) - n).cast("double"))
        return F.concat(low, high)

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)

    a, b = signs(one), signs(two)
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    return F.when(one == two, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def id_bounds(docs: DataFrame) -> list[int]:
    """Ids that cut the table, in descending order, into ranges of about equal numbers of rows; the first is the largest id."""
    rows, most = docs.agg(F.count("*"), F.max("doc_id")).first()
    if most is None:
        return []
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(MAX_RANGES, max(rows // RANGE_ROWS, 4 * parts)))
    shares = [(k + 1) / ranges for k in range(ranges - 1)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 8 * ranges))).first()[0] if shares else []
    return sorted({*found, most}, reverse=True)


def in_ranges(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """Adds ``bucket``, ``guest`` and ``wrap``: each row is in its range, and a range's first row is also a guest of the range before,
    the very first one of the last range, so that every row has its successor in its own bucket."""
    if not bounds:
        return docs.select("*", F.lit(0).alias("bucket"), F.explode(F.array(F.lit(False), F.lit(True))).alias("guest")).withColumn(
            "wrap", F.col("guest"))
    width = max(1, int(len(bounds) ** 0.5))
    tiers = [bounds[k:k + width] for k in range(0, len(bounds), width)]
    first = F.split(F.lit(",".join(str(t[0]) for t in tiers)), ",").cast("array<bigint>")
    inner = F.transform(F.split(F.lit(";".join(",".join(map(str, t)) for t in tiers)), ";"),
                        lambda x: F.split(x, ",").cast("array<bigint>"))
    reach = lambda values: F.size(F.filter(values, lambda x: x >= F.col("doc_id")))
    docs = docs.withColumn("_tier", F.when(F.col("doc_id").isNull(), F.lit(len(tiers))).otherwise(reach(first)))
    docs = docs.withColumn("_within", F.when(F.col("doc_id").isNull(), F.lit(len(tiers[-1]))).otherwise(
        reach(F.element_at(inner, F.col("_tier")))))
    bucket = (F.col("_tier") - 1) * width + F.col("_within") - 1
    docs = docs.withColumn("bucket", bucket).withColumn("_head", F.coalesce(
        F.element_at(F.element_at(inner, F.col("_tier")), F.col("_within")) == F.col("doc_id"), F.lit(False)))
    place = lambda b, guest, wrap: F.struct(b.alias("bucket"), guest.alias("guest"), wrap.alias("wrap"))
    own = place(F.col("bucket"), F.lit(False), F.lit(False))
    first_row = F.col("bucket") == 0
    other = place(F.when(first_row, F.lit(len(bounds) - 1)).otherwise(F.col("bucket") - 1), F.lit(True), first_row)
    places = F.when(F.col("_head"), F.array(own, other)).otherwise(F.array(own))
    return docs.withColumn("_place", F.explode(places)).select(
        *[c for c in docs.columns if c not in ("_tier", "_within", "_head", "bucket")], "_place.*")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every document.

    The next document is the one with the next smaller id; the last one's is the first. The edited text has the last third of
    its code points replaced by the first ones of the next document.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = in_ranges(docs, id_bounds(docs))
    order = Window.partitionBy("bucket").orderBy("wrap", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    rows = dealt.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third),
                      F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    rows = rows.withColumn("edited", F.when(~F.col("guest"), edited))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    own, other = (F.struct(F.lit(k).alias("kind"), F.col(c).alias("body")) for k, c in enumerate(("text", "edited")))
    rows = rows.withColumn("_both", F.explode(F.when(F.col("guest"), F.array(own)).otherwise(F.array(own, other))))
    keys = ["bucket", "place", "kind", "guest", "doc_id", "n_chars", "edited_sha256"]
    made = vectors(rows.select("*", "_both.kind", "_both.body"), "body", *keys)
    following = Window.partitionBy("bucket").orderBy("place", "kind")
    made = made.select("*", F.lead("vector", 1).over(following).alias("edited_vector"),
                       F.lead("vector", 2).over(following).alias("next_vector")).where("kind = 0 AND NOT guest")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("vector")).alias("fingerprint"),
        as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"))


@query("op1_fingerprint")
def op1(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))
