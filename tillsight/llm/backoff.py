"""Language-model scores of documents: stupid backoff over word pairs, counted and joined as tables.

The vocabulary is open: every word and every pair of neighbours of every document is counted, in tables keyed by word hashes. A pair that is
counted scores its count over the count of its first word, any other pair ``BACKOFF`` times its second word's share of all words. A
word that is counted nowhere has ``BACKOFF`` of one occurrence. With ``own`` the scored documents are those of the model, and each place
is scored by the counts of all other places: otherwise words that occur once would predict each other for certain.

1. Words and pairs are counted in tasks and summed by hash. Both tables hold all there are and grow with the input.
2. A document's pairs, exploded, are joined to the pair table. A counted pair then needs the count of its first word, any other pair that
   of its second one.
3. What a task has joined it adds up by document and rare word, and writes that. The rare words are joined to the word table, and
   everything is summed per document.

The most frequent words and pairs (at most ``HOT_WORDS`` and ``HOT_PAIRS``) are looked up in the tasks, so no key of a join has very many
rows; that does not change a score.

Defined results: a null or empty text has no words, score 0 and a null perplexity. Rows that share an id are parts of one document
(no pair goes over from one row to the next) and give one row; rows without an id are one document as well. An empty table gives no rows. Other columns
are left out of the result. Words with equal 63-bit hashes count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.catalogue import query, table, written
from tillsight.llm.text import Words, bound_batches, mix64, slices, utf8
from tillsight.session import ship_with_tasks

ship_with_tasks(__name__)

BACKOFF, HOT_WORDS, HOT_PAIRS = 0.4, 500_000, 500_000
#: Pairs and words that a task holds before it sums and sends them.
HELD = 2_000_000
#: How the tables are packed: most of the disk is theirs, once the shuffle files behind them are gone.
PACKED = "zstd"
#: Where the numbers of two frequent words stand in a key: in its high bytes, so that what changes from row to row lies beside the low
#: bytes of the next column, which packs better. A number has 19 bits.
FIRST, SECOND, NUMBER = 44, 24, (1 << 20) - 1
_SIGN, _ODD = np.uint64(1 << 63), np.uint64(0x9E3779B97F4A7C15)


def find(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted ones that are known, or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    differs = np.zeros(n - 1, bool)
    for column in columns:
        differs |= column[1:] != column[:-1]
    return np.flatnonzero(np.append(True, differs))


def keys(values: np.ndarray) -> np.ndarray:
    """Hashes as keys below zero."""
    return (mix64(values) | _SIGN).view(np.int64)


def marked(words: Words) -> np.ndarray:
    """Hashes of the words with the sign bit set, so that numbers of frequent words can stand beside them."""
    return words.hash | _SIGN


def codes(words: Words, known: np.ndarray) -> np.ndarray:
    """The number of each frequent word, which packs well; the hash of any other word, below zero."""
    number = find(marked(words), known)
    return np.where(number >= 0, number, marked(words).view(np.int64))


def pairs(words: Words, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each pair of neighbours, and the place of its first word. Two frequent words give their numbers, others a hash."""
    at = np.flatnonzero(words.doc[1:] == words.doc[:-1])
    a, b = code[at], code[at + 1]
    return np.where((a >= 0) & (b >= 0), a << FIRST | b << SECOND, keys(words.hash[at] * _ODD + words.hash[at + 1])), at


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = starts(key)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _tally(keys_of):
    """Counts of keys, summed in the task."""
    def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text"):
            key = keys_of(Words(*utf8(part["text"]), fold=True))
            held.append(summed(key, np.ones(len(key), np.int64)))
            size += len(held[-1][0])
            if size > HELD:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield rows(*held[0])
                    held, size = [], 0
        if held:
            yield rows(*summed(*map(np.concatenate, zip(*held, strict=True))))

    return tally


def count_table(docs: DataFrame, keys_of) -> DataFrame:
    return docs.mapInArrow(_tally(keys_of), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of the largest counts, at most ``most`` of them. The cut lies between steps of 1/64 octave: some 4,000 at most."""
    step = F.floor(F.log2("n") * 64)
    steps = counts.where("n > 1").groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).toPandas()
    inside = np.cumsum(steps["rows"].to_numpy()) <= most
    cut = int(steps["step"].to_numpy()[inside][-1]) if inside.any() else 1 << 20
    rows = counts.where((F.col("n") > 1) & (step >= cut)).select("key", "n").toArrow()
    return rows["key"].to_numpy(), rows["n"].to_numpy().astype(np.float64)


def added(parts: list[pa.Table]) -> pa.Table:
    """One row for each document and rare word."""
    sums = ["n_words", "times", "score"]
    rows = pa.concat_tables(parts).group_by(["doc_id", "rest"], use_threads=False).aggregate([(c, "sum") for c in sums])
    return rows.select(["doc_id", "rest", *[f"{c}_sum" for c in sums]]).rename_columns(["doc_id", "rest", *sums])


def added_in_task(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Rows of a task added up before they are written. Documents stand together, which packs better."""
    held, size = [], 0

    def sorted_rows() -> list[pa.RecordBatch]:
        return held[0].sort_by("doc_id").to_batches(max_chunksize=HELD // 20)

    for part in tables:
        held.append(added([part]))
        size += held[-1].num_rows
        if size > HELD // 2:
            held = [added(held)]
            size = held[0].num_rows
            if size > HELD // 4:
                yield from sorted_rows()
                held, size = [], 0
    if held:
        held = [added(held)]
        yield from sorted_rows()


def many_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Small batches together, ``least`` rows or what there is."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def log_count(n, own: int):
    """Logarithm of the other occurrences of a word; one that has none counts as a part of one."""
    return np.log(np.maximum(n - float(own), BACKOFF))


class BackoffModel:
    """Number of all words; the tables ``key, n`` of words (``marked``) and of pairs; sorted hashes of frequent words and their counts."""

    def __init__(self, total: int, words: DataFrame, pairs: DataFrame, known: np.ndarray, counts: np.ndarray):
        self.total, self.words, self.pairs, self.known, self.counts = total, words, pairs, known, counts

    @staticmethod
    def fit(docs: DataFrame) -> BackoffModel:
        bound_batches(docs.sparkSession)
        docs = docs.where("text IS NOT NULL").select("text")
        words = written(count_table(docs, lambda words: marked(words).view(np.int64)), PACKED)
        key, counts = most_frequent(words, HOT_WORDS)
        known = key.view(np.uint64)
        order = np.argsort(known)
        known, counts = known[order], counts[order]
        sent = docs.sparkSession.sparkContext.broadcast(known)
        both = written(count_table(docs, lambda words: pairs(words, codes(words, sent.value))[0]), PACKED)
        return BackoffModel(words.agg(F.sum("n")).first()[0] or 0, words, both, known, counts)

    def transform(self, docs: DataFrame, own: bool = False) -> DataFrame:
        """``doc_id, n_words, log_score, perplexity``; ``own`` if the documents are those that the model has counted."""
        bound_batches(docs.sparkSession)
        less, known, logs = int(own), self.known, log_count(self.counts, own)
        hot, times = most_frequent(self.pairs.where("key >= 0"), HOT_PAIRS)
        order = np.argsort(hot)
        hot = hot[order]
        sent = docs.sparkSession.sparkContext.broadcast((known, logs, hot, np.log(times[order] - less) - logs[hot >> FIRST]))
        share = -float(np.log(max(self.total - less, 1)))

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of four kinds: a text with what is known here (no word, key below 0), a rare first word (no ``a``), a pair
            of frequent words (no word, key from 0), another pair."""
            known, logs, hot, scores = sent.value
            for part in slices(batches, "text"):
                words = Words(*utf8(part["text"]), fold=True)
                texts, ids = part.num_rows, part["doc_id"]
                begin = starts(words.doc)
                code = codes(words, known)
                at = code[begin]
                score = np.zeros(texts)
                if len(known):
                    score += np.bincount(words.doc[begin][at >= 0], logs[at[at >= 0]] + share, texts)
                begin = begin[at < 0]
                key, at = pairs(words, code)
                order = np.argsort(key, kind="stable")
                key, at = key[order], at[order]
                first = starts(key, words.doc[at])
                times = np.diff(np.append(first, len(key)))
                key, at = key[first], at[first]
                if len(hot):
                    place = find(key, hot)
                    there = place >= 0
                    score += np.bincount(words.doc[at[there]], times[there] * scores[place[there]], texts)
                    key, at, times = key[~there], at[~there], times[~there]

                def rows(key, ids, n, score, a=None, b=None) -> pa.RecordBatch:
                    none = pa.nulls(len(key), pa.int64())
                    return pa.RecordBatch.from_arrays(
                        [pa.array(key), ids, pa.array(n), pa.array(score), none if a is None else pa.array(a),
                         none if b is None else pa.array(b)], ["key", "doc_id", "n", "score", "a", "b"])

                def taken(at: np.ndarray) -> pa.Array:
                    return ids.take(pa.array(words.doc[at]))

                id_keys = keys(ids.fill_null(0).to_numpy().view(np.uint64))
                yield rows(id_keys, ids, words.counts, score)
                yield rows(keys(words.hash[begin]), taken(begin), np.ones(len(begin), np.int64), np.zeros(len(begin)), b=code[begin])
                few = key >= 0
                yield rows(key[few], taken(at[few]), times[few], np.zeros(few.sum()))
                key, at, times = key[~few], at[~few], times[~few]
                yield rows(key, taken(at), times, np.zeros(len(key)), code[at], code[at + 1])

        def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The log counts of frequent words are added; other words stay as ``rest`` with how often they are to be added. Then rows
            of one document and rest are added up."""
            logs = sent.value[1]

            def resolved(part: pa.Table) -> pa.Table:
                there = part["word"].is_valid().to_numpy()
                word = part["word"].fill_null(0).to_numpy()
                times, score = part["times"].to_numpy(), part["score"].to_numpy().copy()
                found, rare = there & (word >= 0), there & (word < 0)
                score[found] += times[found] * logs[word[found]]
                return pa.Table.from_arrays(
                    [part["doc_id"], pa.array(word, mask=~rare), part["n_words"], pa.array(np.where(rare, times, 0)), pa.array(score)],
                    ["doc_id", "rest", "n_words", "times", "score"])

            yield from added_in_task(map(resolved, many_rows(batches, HELD // 10)))

        rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            explode, "key long, doc_id long, n long, score double, a long, b long")
        # A pair with no occurrence but the one that is scored is as good as not counted.
        counted = self.pairs.where(F.col("n") > less).select("key", F.col("n").alias("seen"))
        joined = rows.join(counted, "key", "left")
        frequent, base = F.col("key") >= 0, (F.col("key") < 0) & F.col("b").isNull()
        start = F.col("a").isNull() & F.col("b").isNotNull()
        seen = F.col("seen").isNotNull() & ~start
        weight = F.when(seen, F.log(F.col("seen") - less)).when(start, F.lit(share)).otherwise(F.lit(float(np.log(BACKOFF)) + share))
        needed = joined.select(
            "doc_id", F.when(frequent, F.when(seen, F.shiftright("key", FIRST)).otherwise(F.shiftright("key", SECOND).bitwiseAND(NUMBER)))
            .when(seen, F.col("a")).otherwise(F.col("b")).alias("word"),
            F.when(base, F.col("n")).otherwise(F.lit(0)).alias("n_words"),
            F.when(base, F.lit(0)).when(seen, -F.col("n")).otherwise(F.col("n")).cast("long").alias("times"),
            F.when(base, F.col("score")).otherwise(F.col("n") * weight).alias("score"))
        # Summed in the tasks and not by a shuffle, which would stand on the disk beside that of the join.
        parts = written(needed.mapInArrow(resolve, "doc_id long, rest long, n_words long, times long, score double"), PACKED)
        words = self.words.select(F.col("key").alias("rest"), F.greatest(F.col("n") - F.lit(float(less)), F.lit(BACKOFF)).alias("count"))
        rest = parts.where("rest IS NOT NULL").join(words, "rest", "left").select(
            "doc_id", "n_words", (F.col("score") + F.col("times") * F.log(F.coalesce("count", F.lit(BACKOFF)))).alias("score"))
        total = parts.where("rest IS NULL").select("doc_id", "n_words", "score").unionAll(rest).groupBy("doc_id").agg(
            F.sum("n_words").alias("n_words"), F.sum("score").alias("log_score"))
        return total.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("log_score") / F.col("n_words"))))


_SQL = f"""
WITH words AS MATERIALIZED (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x20\\x09-\\x0D]+') AS w FROM documents)),
uni AS MATERIALIZED (SELECT word, CAST(count(*) AS DOUBLE) AS n FROM words GROUP BY word),
pairs AS MATERIALIZED (SELECT doc_id, pos, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev, word FROM words),
seen AS MATERIALIZED (SELECT prev, word, CAST(count(*) AS DOUBLE) AS n FROM pairs WHERE prev IS NOT NULL GROUP BY ALL),
scored AS (
  SELECT doc_id, CASE WHEN p.prev IS NULL THEN ln(greatest(u.n - 1, {BACKOFF}) / t.n)
                      WHEN s.n > 1 THEN ln((s.n - 1) / (f.n - 1))
                      ELSE ln({BACKOFF}) + ln(greatest(u.n - 1, {BACKOFF}) / t.n) END AS score
  FROM pairs p JOIN uni u ON p.word = u.word LEFT JOIN uni f ON p.prev = f.word
  LEFT JOIN seen s ON p.prev = s.prev AND p.word = s.word, (SELECT greatest(sum(n) - 1, 1) AS n FROM uni) t)
SELECT d.doc_id, CAST(count(score) AS BIGINT) AS n_words, round(coalesce(sum(score), 0.0), 4) AS log_score,
       round(exp(-sum(score) / count(score)), 4) AS perplexity
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN scored s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


@query("op9_backoff", _SQL)
def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = BackoffModel.fit(docs).transform(docs, own=True)
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("perplexity", 4).alias("perplexity"))
