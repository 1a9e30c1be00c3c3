"""Quality verdicts by a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed n-grams (words, word pairs, character triples) are counted: one over the texts that a trusted
label calls good, one over the whole corpus. A text's score is the mean, over its n-grams, of the logarithm of their ratio. One
threshold, found once on labelled texts, decides every text.

Simple counts (short texts, repeated windows, symbols, repeated lines) come first: a text that fails them is not kept.

Defined results: a null or empty text has no words and fails the base; null ids and repeated rows are scored like any other row,
but a null id has no label; a label given twice counts once (quality: the highest). Without labels of both kinds no threshold can be
found, and every text that passes the base is kept. An empty table gives no rows. Other columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.catalogue import query, table
from tillsight.llm.text import Words, bound_batches, in_doc, repeated, run_hashes, slices, utf8
from tillsight.session import ship_with_tasks

ship_with_tasks(__name__)

#: Cells of the hashed n-gram tables: their size does not depend on the corpus.
CELLS = 1 << 18
#: At most so many labelled texts fit the target multinomial and the threshold; the corpus multinomial takes every text.
LABELLED = 20_000
WINDOW, SHORT, REPEATED_PERCENT = 8, 20, 30
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

BASE_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
               "base_failed boolean")


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """The plain counts of each text of a slice."""
    docs, data = len(words.offsets) - 1, words.data
    counts = words.counts
    # Lines: a text's start and whatever follows a line feed.
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(words.offsets, breaks, "right") - 1
    starts = np.concatenate([words.offsets[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(docs), owner])
    order = np.lexsort((starts, line_doc))
    starts, line_doc = starts[order], line_doc[order]
    last = np.append(line_doc[1:] != line_doc[:-1], True) if docs else np.zeros(0, bool)
    ends = np.where(last, words.offsets[1:][line_doc], np.append(starts[1:], 0) - 1)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(words.is_word, out=sums[1:])
    worded = sums[ends] > sums[starts]
    starts, ends, line_doc = starts[worded], ends[worded], line_doc[worded]
    _, later = repeated(in_doc(words.spans(starts, ends), line_doc))
    # Windows of words that occur twice in their text, and the words they cover.
    keys, first = run_hashes(words.hash, words.doc, WINDOW)
    twice, _ = repeated(in_doc(keys, words.doc[first]))
    cover = np.zeros(len(words.starts) + WINDOW + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    covered = np.cumsum(cover)[:len(words.starts)] > 0
    repeats = np.bincount(words.doc[covered], minlength=docs)
    return {
        "n_words": counts, "word_chars": words.per_doc(words.is_word & ((data & 0xC0) != 0x80)),
        "n_symbols": words.per_doc(_SYMBOLS[data]), "n_dup_lines": np.bincount(line_doc[later], minlength=docs),
        "n_repeat_words": repeats,
        "base_failed": (counts < SHORT) | (100 * repeats > REPEATED_PERCENT * counts)}


def cells(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cell and text of each word, word pair and character triple."""
    shift, found = np.uint64(64 - CELLS.bit_length() + 1), []
    found.append(((words.hash >> shift).astype(np.int32), words.doc))
    pairs, first = run_hashes(words.hash, words.doc, 2)
    found.append(((pairs >> shift).astype(np.int32), words.doc[first]))
    data = words.data.astype(np.uint32)
    if len(data) > 2:
        triples = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1)
        doc = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
        same = doc[2:] == doc[:-2]
        found.append(((triples >> np.uint32(32 - CELLS.bit_length() + 1)).astype(np.int32)[same], doc[:-2][same]))
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's cells: of all texts, and of the target's."""
    raw, target = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    for part in slices(batches, "text"):
        words = Words(*utf8(part["text"]))
        good = part["target"].to_numpy(zero_copy_only=False).astype(bool)
        for cell, doc in cells(words):
            raw += np.bincount(cell, minlength=CELLS)
            if good.any():
                target += np.bincount(cell[good[doc]], minlength=CELLS)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["cell", "raw", "target"])


def labelled_ids(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """At most ``bound`` labelled ids in the order of a hash, half of them of each quality: doc_id, quality."""
    once = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [once.where(F.col("quality") > 0), once.where(F.col("quality") <= 0)]
    return parts[0].orderBy(*order).limit(bound // 2).unionAll(parts[1].orderBy(*order).limit(bound // 2))


class QualityModel:
    """Log ratios by cell, and the threshold."""

    def __init__(self, ratios: np.ndarray, threshold: float):
        self.ratios, self.threshold = ratios, threshold

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> QualityModel:
        spark = docs.sparkSession
        bound_batches(spark)
        docs = docs.select("doc_id", "text")
        # The set of labelled ids has at most `bound` entries, so it may be collected and broadcast.
        chosen = labelled_ids(labels, bound).collect()
        ids = spark.createDataFrame([tuple(r) for r in chosen], "doc_id long, quality int")
        marked = docs.join(F.broadcast(ids), "doc_id", "left").select(
            "text", F.coalesce(F.col("quality") > 0, F.lit(False)).alias("target"))
        rows = marked.mapInArrow(_count, "cell long, raw long, target long").groupBy("cell").agg(
            F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most CELLS rows
        raw, target = np.zeros(CELLS), np.zeros(CELLS)
        raw[rows["cell"]], target[rows["cell"]] = rows["raw"], rows["target"]
        if not target.any():
            return QualityModel(np.zeros(CELLS), -np.inf)
        # The target is smoothed towards the corpus, so that a cell it has not seen says little against a rare one.
        share = raw / raw.sum()
        ratios = np.log((target + 100_000 * share + 1e-9) / (target.sum() + 100_000)) - np.log(np.maximum(share, 1e-18))
        ratios[raw == 0] = 0
        model = QualityModel(ratios, -np.inf)
        known = model.transform(docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text"), decide=False).where(
            "NOT base_failed").join(ids, "doc_id").select("score", "quality").toPandas()
        model.threshold = best_threshold(known["score"].to_numpy(), known["quality"].to_numpy() > 0)
        return model

    def transform(self, docs: DataFrame, decide: bool = True) -> DataFrame:
        """A row for each text: the base counts, ``score`` and ``kept``."""
        bound_batches(docs.sparkSession)
        shared, threshold = docs.sparkSession.sparkContext.broadcast(self.ratios.astype(np.float32)), self.threshold

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratios = shared.value
            for part in slices(batches, "text"):
                words = Words(*utf8(part["text"]))
                base = base_counts(words)
                total, number = np.zeros(part.num_rows), np.zeros(part.num_rows)
                for cell, doc in cells(words):
                    total += np.bincount(doc, ratios[cell], minlength=part.num_rows)
                    number += np.bincount(doc, minlength=part.num_rows)
                mean = total / np.maximum(number, 1)
                columns = {"doc_id": part["doc_id"], **base, "score": mean,
                           "kept": ~base["base_failed"] & (mean >= threshold)}
                yield pa.RecordBatch.from_pydict({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            score, BASE_SCHEMA + ", score double, kept boolean")


def best_threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold of the highest balanced accuracy; within the best gap it lies nearer to the bad side."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    bad_below = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    good_above = 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    edges = np.concatenate([[True], scores[1:] > scores[:-1], [True]])
    worth = np.where(edges, bad_below + good_above, -1)
    k = int(np.argmax(worth))
    if k == 0 or k == len(scores):
        return float(scores[0] if k == 0 else np.nextafter(scores[-1], np.inf))
    return float(scores[k - 1] + (scores[k] - scores[k - 1]) * 0.25)


@query("op4_quality")
def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return QualityModel.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")).transform(docs)
