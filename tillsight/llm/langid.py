"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram (one to three characters of the lower-cased text, with each run of other characters as one blank) of the
training rows, by language and cell. The matrix of log probabilities has a row for each language and a fixed number of
cells; it is broadcast, and batches are scored with numpy.

A filter by language (`LanguageModel.judge`) takes its limits from the learned rows: texts that are far less likely than all but one in a hundred of those
are no text of any learned language, and a given language that is far less likely than the best one contradicts the text. With fewer than a hundred learned
rows no limit can be told, and only texts without letters are rejected. A few letters are no evidence, so the margins are wider for short texts.

Defined results: a null text, a text without letters, or an empty model gives ``und`` with score 0; null languages are not learned
from; null ids belong to no fold and are predicted; repeated rows are repeated; ties go to the language that sorts first; an empty table
gives no rows. Other columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.catalogue import query, table
from tillsight.llm.text import bound_batches, slices
from tillsight.session import ship_with_tasks

ship_with_tasks(__name__)

CELLS, ORDERS, MAX_LANGUAGES = 1 << 16, (1, 2, 3), 1000
UNKNOWN = "und"
#: What `judge` goes by. Share of the learned rows that lies beyond a limit, and margins beyond the limits, in nats an n-gram.
EVIDENCE = ("_letters", "_likely", "_gap")
TAIL, UNLIKELY, CONTRARY = 0.01, 3.0, 0.5
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: is it a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the texts (letters, and 32 for what lies between), the text of each, and the letters by text."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(lowered), dtype=np.int32), [len(t) for t in lowered])
    letter = letters()[points]
    number = np.bincount(doc[letter], minlength=len(lowered))
    keep = letter.copy()
    if len(points):
        # Of a run of other characters in a text the first stays, as a blank.
        keep[0] = True
        keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    return np.where(letter, points, np.uint32(32))[keep], doc[keep], number


def grams(points: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cell and text of each n-gram, an order at a time."""
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            return
        value = np.full(m, n, np.uint32)
        for k in range(n):
            value = (value ^ points[k:m + k]) * np.uint32(0x9E3779B1)
            value ^= value >> np.uint32(15)
        value *= np.uint32(0x85EBCA77)
        same = doc[:m] == doc[n - 1:]
        yield (value >> np.uint32(32 - CELLS.bit_length() + 1)).astype(np.int32)[same], doc[:m][same]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for part in slices(batches, "text"):
        points, doc, _ = characters(part["text"].to_pylist())
        names = part["lang"].to_pylist()
        known = sorted(set(names))
        if len(counts) + len(known) > 2 * MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        number = np.searchsorted(known, names).astype(np.int32)
        total = np.zeros(len(known) * CELLS, np.int64)
        for cell, owner in grams(points, doc):
            total += np.bincount(number[owner] * CELLS + cell, minlength=len(total))
        for k, name in enumerate(known):
            counts[name] = counts.get(name, 0) + total[k * CELLS:(k + 1) * CELLS]
    for name, total in counts.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(total[used])], ["lang", "cell", "n"])


class LanguageModel:
    """Languages in order, and the log probability of each cell in each."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    @staticmethod
    def fit(docs: DataFrame) -> LanguageModel:
        """Learn from the columns ``text`` and ``lang``. The result has at most languages x cells numbers."""
        bound_batches(docs.sparkSession)
        rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(
            _count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
        rows = rows.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).orderBy("lang")
        found = rows.limit(MAX_LANGUAGES + 1).collect()
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        logs = np.zeros((len(found), CELLS))
        for k, row in enumerate(found):
            pairs = np.array(row["cells"], np.float64).reshape(-1, 2)
            logs[k, pairs[:, 0].astype(int)] = pairs[:, 1]
        logs = np.log((logs + 0.1) / (logs.sum(1, keepdims=True) + 0.1 * CELLS))
        return LanguageModel([r["lang"] for r in found], logs.astype(np.float32))

    def transform(self, docs: DataFrame, *carry: str, evidence: str | None = None) -> DataFrame:
        """Columns ``carry``, ``lang_pred`` and ``score``: the probability of the language among those learned.

        With ``evidence``, the name of a column of given languages, also ``EVIDENCE``: letters, the mean log probability of an n-gram under
        the best language, and how far that under the given language is below it (0 if that language is null or was not learned).
        """
        bound_batches(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast((self.languages, np.ascontiguousarray(self.logs.T)))

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            languages, logs = shared.value
            place = {name: k for k, name in enumerate(languages)}
            for part in slices(batches, "text"):
                points, doc, number = characters(part["text"].to_pylist())
                total = np.zeros((part.num_rows, max(1, len(languages))))
                size = np.zeros(part.num_rows, np.int64)
                for cell, owner in grams(points, doc):
                    if len(cell):
                        size += np.bincount(owner, minlength=part.num_rows)
                        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                        total[owner[first], :logs.shape[1]] += np.add.reduceat(logs[cell], first, axis=0, dtype=np.float64)
                best = total.argmax(1)
                odds = 1 / np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1)
                unknown = (number == 0) | (not languages)
                names = np.array([*languages, UNKNOWN], object)[np.where(unknown, len(languages), best)]
                made = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(unknown, 0.0, odds))}
                if evidence:
                    given = np.array([place.get(name, -1) for name in part[evidence].to_pylist()], np.int64)
                    top, own = total.max(1), total[np.arange(part.num_rows), given]
                    gap = np.where(given < 0, 0.0, (top - own) / np.maximum(size, 1))
                    made |= dict(zip(EVIDENCE, (pa.array(number), pa.array(top / np.maximum(size, 1)), pa.array(gap)), strict=True))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in carry), *made.values()], [*carry, *made])

        fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
        more = ", {} long, {} double, {} double".format(*EVIDENCE) if evidence else ""
        wanted = dict.fromkeys([*carry, "text", *([evidence] if evidence else [])])
        return docs.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(predict, f"{fields}lang_pred string, score double{more}")

    def limits(self, docs: DataFrame) -> tuple[float, float] | None:
        """The mean log probability that all but ``TAIL`` of the learned rows reach, and the gap that all but ``TAIL`` stay within.

        None if the rows are too few to have such a tail. Counted in steps of a hundredth, so at most some thousand rows are collected.
        """
        learned = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
        found = self.transform(learned, evidence="lang").where(F.col("lang_pred") != UNKNOWN)
        steps = found.select(F.explode(F.array(*[F.struct(
            F.lit(k).alias("kind"), F.floor(F.col(c) * sign * 100).alias("step")) for k, (c, sign) in enumerate(
                zip(EVIDENCE[1:], (-1, 1), strict=True))])).alias("at")).groupBy("at.kind", "at.step").count().collect()
        reached = []
        for kind in (0, 1):
            own = sorted((r["step"], r["count"]) for r in steps if r["kind"] == kind)
            total = sum(n for _, n in own)
            left = int(TAIL * total)
            if not left:
                return None
            for step, n in reversed(own):
                left -= n
                if left < 0:
                    reached.append((step + 1) / 100)
                    break
        return -reached[0], reached[1]

    def judge(self, docs: DataFrame, *carry: str, limits: tuple[float, float] | None, lang: str = "lang") -> DataFrame:
        """``transform`` of the rows that the model does not reject.

        Rejected are rows without a language; rows whose n-grams are less likely, under the best language, than the limit by ``UNLIKELY``; and rows
        whose given language is less likely than the best one by more than the limit and ``CONTRARY``. Both margins are wider for few letters.
        """
        found = self.transform(docs, *carry, evidence=lang).where(F.col("lang_pred") != UNKNOWN)
        if limits is not None:
            wider = 1 + 3 / F.sqrt(F.col(EVIDENCE[0]))
            found = found.where((F.col(EVIDENCE[1]) >= limits[0] - UNLIKELY * wider) & (F.col(EVIDENCE[2]) <= limits[1] + CONTRARY * wider))
        return found.drop(*EVIDENCE)


def held_out(doc_id: str = "doc_id"):
    """A quarter of the documents is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those that are not held out."""
    model = LanguageModel.fit(docs.where(~held_out()))
    return model.transform(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text"), "doc_id", "held_out")


@query("op10_language")
def op10(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
