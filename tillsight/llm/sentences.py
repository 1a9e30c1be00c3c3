"""Removal of repeated passages by sliding spans of sentences.

A sentence ends after . ! or ? (quotes and brackets may follow) or with its line. A passage is a run of consecutive sentences that has at
least three of them and ten words, or 25 words. Every sentence that lies in a passage which is not the first with its words is
removed: the first is that of the smallest id, and in one text the leftmost. What stays of a text is unchanged, byte for byte.

Two spans stand for all passages: from each sentence on the shortest passage, and up to each sentence the shortest passage. A sentence of
a repeated passage from which a passage goes on inside it lies in a span of the first kind; any other one lies in the shortest passage
up to the last sentence. A span's hash is that of its words, with A-Z folded, so the kind of white space does not matter. Spans are
joined across the whole corpus by their hash.

In a text, later spans with the same hash are found where the text is; so each text sends one row for each distinct span. First
occurrences are aggregated before they are shuffled, and each span of another text meets one row.

Defined results: a null text stays null, an empty text or one without words stays as it is. Rows that share an id are one document: they do not remove
each other's sentences. A row without an id is compared only with itself. A document may lose all of its text and keeps its row. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.catalogue import query, table
from tillsight.llm.text import Words, bound_batches, in_doc, mix64, repeated, slices, utf8
from tillsight.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

RUN, RUN_WORDS, LONG_WORDS = 3, 10, 25
#: Documents with something to remove: a list up to this length is broadcast if it is small in bytes too, see `BROADCAST_SPANS`.
BROADCAST_SPANS = 500_000
_ENDS, _CLOSES = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_CLOSES[list(b"\"')]}")] = True


class Sentences:
    """Sentences of a slice: ``word`` (index of the first word, one entry more), ``doc``, ``start`` (byte), and their spans (``span_of``, ``until``, ``hash``)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, fold=True)
        n = len(words.starts)
        self.offsets, self.words, self.data = offsets, words, data
        if not n:
            self.word, self.doc, self.start = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.span_of = self.until = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        last, before = data[words.ends - 1], data[np.maximum(words.ends - 2, 0)]
        stop = _ENDS[last] | _CLOSES[last] & _ENDS[before] & (words.ends - words.starts > 1)
        lines = np.append(0, np.cumsum(data == 10))
        new = np.ones(n, bool)
        new[1:] = (words.doc[1:] != words.doc[:-1]) | stop[:-1] | (lines[words.starts[1:]] > lines[words.ends[:-1]])
        first = np.flatnonzero(new)
        self.word = np.append(first, n)
        self.doc = words.doc[first]
        # What stands before a text's first sentence goes with it.
        opening = np.append(True, self.doc[1:] != self.doc[:-1])
        self.start = np.where(opening, offsets[self.doc], words.starts[first])
        at = np.arange(len(first))
        begins, ends = (x[np.cumsum(opening) - 1] for x in (np.flatnonzero(opening), np.append(np.flatnonzero(opening)[1:], len(first))))
        until = np.minimum(np.maximum(at + RUN, np.searchsorted(self.word, first + RUN_WORDS)),
                           np.searchsorted(self.word, first + LONG_WORDS))
        # Before the first word of all, the search gives -1.
        stop_word = self.word[1:]
        since = np.maximum(np.minimum(at + 1 - RUN, np.searchsorted(self.word, stop_word - RUN_WORDS, "right") - 1),
                           np.searchsorted(self.word, stop_word - LONG_WORDS, "right") - 1)
        on, back = until <= ends, since >= begins
        # A span has at most LONG_WORDS sentences. Sorted by its first sentence, each once.
        spans = np.unique(np.concatenate([at[on] * 64 + until[on] - at[on], since[back] * 64 + at[back] + 1 - since[back]]))
        self.span_of, self.until = spans // 64, spans // 64 + spans % 64
        # Hash of the words of a span: sums of word hashes times powers of an odd number.
        power = np.full(n + 1, 0xA24BAED4963EE407, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        inverse = np.full(n + 1, pow(0xA24BAED4963EE407, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hash * power[:n], out=sums[1:])
        a, b = self.word[self.span_of], self.word[self.until]
        self.hash = mix64((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def inner(self) -> np.ndarray:
        """Which spans repeat an earlier one of their own text."""
        return repeated(in_doc(self.hash, self.doc[self.span_of]))[1]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 1 << 20):
        found = Sentences(*utf8(part["text"]))
        first = ~found.inner()
        at = found.span_of[first]
        doc = found.doc[at]
        opening = np.searchsorted(found.doc, doc)
        ids = part["doc_id"].to_numpy(zero_copy_only=False)
        # Place in the text and length share a number.
        place = (at - opening) * 64 + np.minimum(found.until[first] - at, 63)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.hash[first].view(np.int64)), pa.array(ids[doc]), pa.array(place)], ["hash", "doc_id", "place"])


def _remove(columns: list[str], only_counts: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part["text"])
            found = Sentences(data, offsets)
            total = len(found.doc)
            opening = np.searchsorted(found.doc, np.arange(part.num_rows + 1))
            cover = np.zeros(total + 65, np.int64)
            inner = found.inner()
            np.add.at(cover, found.span_of[inner], 1)
            np.add.at(cover, found.until[inner], -1)
            gone = part["gone"]
            packed = gone.flatten().to_numpy()
            owner = np.repeat(np.arange(part.num_rows), np.diff(gone.offsets.to_numpy()))
            # Rows that share an id may differ in their texts, so a place may lie beyond this row's sentences.
            a = np.minimum(opening[owner] + packed // 64, opening[owner + 1])
            b = np.minimum(a + packed % 64, opening[owner + 1])
            np.add.at(cover, a, 1)
            np.add.at(cover, b, -1)
            removed = np.cumsum(cover)[:total] > 0
            stops = np.append(found.start[1:], 0)
            closing = np.append(found.doc[1:] != found.doc[:-1], True) if total else np.zeros(0, bool)
            stops = np.where(closing, offsets[1:][found.doc], stops)
            mask = np.zeros(len(data) + 1, np.int64)
            np.add.at(mask, found.start[removed], 1)
            np.add.at(mask, stops[removed], -1)
            out = np.cumsum(mask)[:len(data)] > 0
            kept = data[~out].tobytes()
            bounds = offsets - np.append(0, np.cumsum(out))[offsets]
            texts = pa.array([kept[x:y].decode() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
            null = part["text"].is_null()
            if null.true_count:
                texts = pa.array([None if n else t for n, t in zip(null.to_pylist(), texts.to_pylist(), strict=True)], pa.string())
            count = lambda mask: np.bincount(found.doc[mask], minlength=part.num_rows)
            made = {"text": texts, "n_sentences": pa.array(count(np.ones(total, bool))), "n_removed": pa.array(count(removed))}
            if not only_counts:
                del made["n_sentences"], made["n_removed"]
            yield pa.RecordBatch.from_pydict({**{c: part[c] for c in columns if c != "text"}, **made})

    return remove


def covered_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, gone``: the places of the spans of each document that an earlier document has too."""
    bound_batches(docs.sparkSession)
    spans = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _spans, "hash long, doc_id long, place long")
    first = spans.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    later = spans.join(first.drop("last"), "hash").where("doc_id > first")
    return later.groupBy("doc_id").agg(F.collect_list("place").alias("gone"))


def remove_passages(docs: DataFrame, counts: bool = False) -> DataFrame:
    """The documents without repeated passages: the same columns, ``text`` shortened; with ``counts`` also ``n_sentences, n_removed``."""
    clash = [c for c in ("gone", "n_sentences", "n_removed", "_id") if c in docs.columns]
    renamed = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    gone = cut_lineage(covered_spans(docs)).withColumnRenamed("doc_id", "_id")
    joined = renamed.join(gone, F.col("doc_id").cast("long") == F.col("_id"), "left").drop("_id").withColumn(
        "gone", F.coalesce("gone", F.array().cast("array<bigint>")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in renamed.schema if f.name != "text")
    schema = f"{fields}, text string" + (", n_sentences long, n_removed long" if counts else "")
    out = joined.mapInArrow(_remove(renamed.columns, counts), schema)
    if counts and clash:
        return out
    return out.withColumnsRenamed({f"_own_{c}": c for c in clash}).select(
        *docs.columns, *(["n_sentences", "n_removed"] if counts else []))


@query("op3_sentences")
def op3(spark, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents", "doc_id", "text"), counts=True)
