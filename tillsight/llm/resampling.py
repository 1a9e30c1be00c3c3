"""Importance resampling towards a target: hashed word windows, bucket gains, a Gumbel draw.

1. An untrained pre-tokeniser of the tokenizers library (a Regex Split) runs over the ASCII-lowered text and returns words with their
   offsets. Windows of 1 to ``longest`` consecutive words are pairs of offsets (start of the first word, end of the last);
   a window's feature is its words joined by one space, and the feature's bucket is a CRC-32 modulo ``buckets``.
2. Each text becomes its bucket histogram, written once: at most ``buckets`` entries, however long the text is. Corpus and target
   histograms are sums of these, one partial for each task.
3. A bucket's gain is the smoothed log ratio of target and corpus, in thousandths. A text's weight is the sum of its gains.
4. Weight plus a Gumbel variable of the id's digest is the score, and the highest scores are drawn: sampling without replacement in
   proportion to the weight. Scores are ranked by ranges of (score, id): no table is sorted in one task, and equal scores are spread too.

Only the gains, a row for each bucket, come to the driver.

Defined results: a null, empty or wordless text has no features, weight 0 and is never drawn where a least number of words is asked
for. Rows that share an id are documents of their own with the same Gumbel variable; rows alike in score and id are ranked
in any order. A null id has the digest of an empty one and comes last among equal scores. An empty corpus gives no rows; an empty
target has no counts, and gains then follow the corpus alone. Further columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillsight.llm.catalogue import query, table, written
from tillsight.llm.text import bound_batches, slices
from tillsight.session import ship_with_tasks

ship_with_tasks(__name__)

#: Words are runs of digits, small letters and all beyond ASCII, after A-Z became small.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 10, 20, 2024
#: The gains are collected, so their number is bounded.
MAX_BUCKETS = 1 << 20
#: Entries of a worker's table from feature to bucket; a full table is emptied.
_KNOWN = 200_000

HISTOGRAM = "doc_id long, n_words long, n_features long, cells array<int>, times array<int>"


def splitter():
    """The pre-tokeniser: what the pattern matches are the words, all else is removed."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def windows(offsets: list[tuple[int, int]], longest: int) -> Iterator[tuple[int, int, int]]:
    """First word, words and end offset of each run of 1 to ``longest`` words."""
    for n in range(1, longest + 1):
        for k in range(len(offsets) - n + 1):
            yield k, n, offsets[k + n - 1][1]


def _bucket_of(feature: str, known: dict[str, int], buckets: int) -> int:
    cell = known.get(feature)
    if cell is None:
        if len(known) >= _KNOWN:
            known.clear()
        cell = known[feature] = zlib.crc32(feature.encode()) % buckets
    return cell


def _histograms(longest: int, buckets: int):
    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = splitter(), {}
        for part in slices(batches, "text"):
            n_words, n_features, cells, times = [], [], [], []
            for text in part["text"]:
                pairs = split.pre_tokenize_str(ascii_lower(text.as_py() or ""))
                words = [word for word, _ in pairs]
                if longest == 1:
                    found = [_bucket_of(word, known, buckets) for word in words]
                else:
                    found = [_bucket_of(" ".join(words[k:k + n]), known, buckets)
                             for k, n, _ in windows([pair for _, pair in pairs], longest)]
                cell, count = np.unique(np.array(found, np.int32), return_counts=True)
                n_words.append(len(words))
                n_features.append(len(found))
                cells.append(cell)
                times.append(count.astype(np.int32))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32))
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int32)) for x in (cells, times)]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                 *[pa.ListArray.from_arrays(ends, x) for x in flat]],
                ["doc_id", "n_words", "n_features", "cells", "times"])

    return histograms


def bucket_histograms(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``doc_id, n_words, n_features`` and the buckets of each text's features with their numbers."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_histograms(longest, buckets), HISTOGRAM)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and times of all rows of a batch, and where each row's begin (one more than rows)."""
    cells, times = batch["cells"], batch["times"]
    offsets = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return cells.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64), offsets


def _summed(buckets: int):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            cells, times, _ = _entries(batch)
            np.add.at(total, cells, times)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "times"])

    return summed


def bucket_counts(histograms: DataFrame, buckets: int) -> DataFrame:
    """``bucket, times`` over all texts: one partial histogram for each task, then their sums."""
    partial = histograms.select("cells", "times").mapInArrow(_summed(buckets), "bucket int, times long")
    return partial.groupBy("bucket").agg(F.sum("times").alias("times"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` for every bucket: thousandths of the smoothed log ratio, floors going down."""
    both = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(corpus.withColumnRenamed("times", "s"), "bucket", "left").join(
        target.withColumnRenamed("times", "t"), "bucket", "left").select(
        "bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    whole = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    wide = lambda c: F.col(c).cast("double")
    ratio = (wide("t") + 1) * (F.col("all_s") + buckets) / ((wide("s") + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _weights(gains: np.ndarray):
    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, times, offsets = _entries(batch)
            sums = np.concatenate([[0], np.cumsum(gains[cells] * times)])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_words"], batch["n_features"], pa.array(sums[offsets[1:]] - sums[offsets[:-1]])],
                ["doc_id", "n_words", "n_features", "weight"])

    return weights


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable, from the first 32 bits of the id's digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    part = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((part + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """The rows with ``rank`` 1, 2, 3 ... by falling score, ties to smaller ids; null beyond ``drawn``.

    Rows are dealt in ranges and sorted inside them; a row's place is the rows of earlier ranges and its number in its own.
    The numbered rows are written, so both readings below see the same ranges.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_tie")]
    dealt = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order)
    at = written(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_range", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    # A row for each range; sums of counts in order.
    before = at.groupBy("_range").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).select("_range", "_before")
    place = F.col("_before") + F.col("_in") + 1
    return at.join(F.broadcast(before), "_range").withColumn("rank", F.when(place <= drawn, place)).drop("_at", "_range", "_in", "_before")


def importance_ranks(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT,
                     min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each row of ``docs``; ``rank`` is null for rows that are not drawn.

    ``docs`` has ``doc_id`` and ``text``, ``target`` has ``text``. Of the documents with ``min_words`` words, ``percent`` of a
    hundred are drawn.
    """
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MAX_BUCKETS}")
    if longest < 1 or not 0 <= percent <= 100:
        raise ValueError("longest must be 1 or more, percent from 0 to 100")
    histograms = written(bucket_histograms(docs, longest, buckets))
    wanted = bucket_histograms(target.select(F.lit(None).alias("doc_id"), "text"), longest, buckets)
    gains = np.zeros(buckets, np.int64)
    for row in bucket_gains(bucket_counts(histograms, buckets), bucket_counts(wanted, buckets), buckets).toLocalIterator():
        gains[row["bucket"]] = row["gain"]
    weighed = histograms.mapInArrow(_weights(gains), "doc_id long, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    enough = F.col("n_words") >= min_words
    drawn = percent * scored.where(enough).count() // 100
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(enough), drawn).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; ids are taken to be unique."""
    ranks = importance_ranks(docs, target, **options).where("rank IS NOT NULL").select("doc_id")
    return docs.join(ranks, "doc_id", "left_semi").select([F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT range, 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS l FROM steps WHERE k = 8),
words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
doc_words AS (SELECT doc_id, unnest(w) AS w FROM words),
target_words AS (
  SELECT unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
vocabulary AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM doc_words UNION SELECT w FROM target_words)),
spelled AS (
  SELECT w, list_transform(range(length(h) // 2), lambda i:
    16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) AS bytes
  FROM vocabulary),
buckets AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b:
    xor(c // 256, l[1 + xor(c % 256, b)])), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
  FROM spelled, crc),
doc_buckets AS (SELECT doc_id, bucket, count(*) AS times FROM doc_words JOIN buckets USING (w) GROUP BY doc_id, bucket),
s AS (SELECT bucket, sum(times) AS s FROM doc_buckets GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000)))) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT doc_id, sum(times * gain) AS weight FROM doc_buckets JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT)
           + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (doc_id)),
places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (doc_id)
"""


@query("op11_resampling", SQL)
def op11(spark, sf_dir: str) -> DataFrame:
    return importance_ranks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
