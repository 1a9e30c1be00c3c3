"""What the backoff model leaves on the disk."""

import pyarrow as pa
import pytest

from tillsight.llm import backoff


def test_no_shuffle_by_document_beside_that_of_the_join(spark, monkeypatch):
    """A shuffle between the join and the table written would stand on the disk together with that of the join."""
    plans, written = [], backoff.written

    def recorded(frame, *packed):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return written(frame, *packed)

    monkeypatch.setattr(backoff, "written", recorded)
    docs = spark.createDataFrame([(k, f"a b c{k % 3} d") for k in range(20)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        backoff.BackoffModel.fit(docs).transform(docs, own=True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Join" in plans[-1] and "hashpartitioning(key" in plans[-1] and "hashpartitioning(doc_id" not in plans[-1]


def test_a_task_adds_up_its_rows(monkeypatch):
    monkeypatch.setattr(backoff, "HELD", 40)
    docs, rest = [1, None, 2, 1, None, 1] * 100, [None, None, 7, None, None, 7] * 100
    batch = pa.RecordBatch.from_arrays(
        [pa.array(docs), pa.array(rest, pa.int64()), pa.array([1] * 600), pa.array([2] * 600), pa.array([0.5] * 600)],
        ["doc_id", "rest", "n_words", "times", "score"])
    parts = [batch.slice(k, 30) for k in range(0, 600, 30)]
    found = pa.Table.from_batches(backoff.added_in_task(backoff.many_rows(iter(parts), 45)))
    rows = {(r["doc_id"], r["rest"]): r for r in found.to_pylist()}
    assert len(rows) == found.num_rows == 4
    assert [(rows[k]["n_words"], rows[k]["times"], rows[k]["score"]) for k in ((1, None), (None, None), (2, 7), (1, 7))] == [
        (200, 400, 100.0), (200, 400, 100.0), (100, 200, 50.0), (100, 200, 50.0)]
    assert list(backoff.added_in_task(iter([]))) == []


def test_more_documents_than_a_task_holds(monkeypatch):
    monkeypatch.setattr(backoff, "HELD", 40)
    part = pa.table({"doc_id": list(range(100)) * 2, "rest": pa.nulls(200, pa.int64()), "n_words": [1] * 200, "times": [0] * 200,
                     "score": [1.0] * 200})
    found = pa.Table.from_batches(backoff.added_in_task(part.slice(k, 50) for k in range(0, 200, 50)))
    assert sum(found["n_words"].to_pylist()) == 200 and set(found["doc_id"].to_pylist()) == set(range(100))


def test_two_frequent_words_fit_one_key():
    """Numbers of up to 19 bits, one beside the other, and no sign."""
    top = backoff.HOT_WORDS - 1
    assert backoff.HOT_WORDS <= 1 << 19
    key = top << backoff.FIRST | top << backoff.SECOND
    assert key < 1 << 63 and key >> backoff.FIRST == top and key >> backoff.SECOND & backoff.NUMBER == top


@pytest.mark.parametrize("own", [False, True])
def test_frequent_pairs_joined_and_looked_up_score_alike(spark, monkeypatch, own):
    docs = spark.createDataFrame([(k, f"a b c{k % 3} d e{k % 5} a b") for k in range(30)], "doc_id long, text string")
    scores = []
    for hot in (0, backoff.HOT_PAIRS):
        monkeypatch.setattr(backoff, "HOT_PAIRS", hot)
        rows = backoff.BackoffModel.fit(docs).transform(docs, own).orderBy("doc_id").collect()
        scores.append([r["log_score"] for r in rows])
    assert scores[0] == pytest.approx(scores[1])
