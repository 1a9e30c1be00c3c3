"""Hashes of spans: alike for equal bytes, different for texts that a modulus of a power of two cannot tell apart."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))

import cases  # noqa: E402

from tillsight.llm import minhash, quality, text  # noqa: E402


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_equal_spans_have_equal_hashes():
    data = np.frombuffer(b"one two one two one" * 3, np.uint8)
    spans = text.SpanHash(data)
    starts = np.repeat(np.arange(len(data)), len(data))
    ends = np.tile(np.arange(1, len(data) + 1), len(data))
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    by_bytes, by_hash = {}, {}
    for s, e, h in zip(starts, ends, spans(starts, ends).tolist(), strict=True):
        by_bytes.setdefault(data[s:e].tobytes(), set()).add(h)
        by_hash.setdefault(h, set()).add(data[s:e].tobytes())
    assert all(len(x) == 1 for x in by_bytes.values()) and all(len(x) == 1 for x in by_hash.values())


def test_long_texts_do_not_overflow():
    data = np.full((1 << 23) + 50, 255, np.uint8)
    spans = text.SpanHash(data)
    found = spans(np.array([0, 17, len(data) - 40]), np.array([40, 57, len(data)]))
    assert len(set(found.tolist())) == 1


def test_thue_morse_words_are_different(spark):
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    words = text.Words(*text.utf8(text.pa.array([f"{one} {two}"])))
    assert len(set(words.hash.tolist())) == 2
    docs = cases.documents(spark, [(k, t, "en", "s", 0, 0.0, "", 0) for k, t in ((1, one), (2, two), (3, f"{one}\n{two}"))])
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert found == {1: 1, 2: 2, 3: 3}
    counts = quality.base_counts(text.Words(*text.utf8(text.pa.array([f"{one}\n{two}", f"{one}\n{one}"]))))
    assert counts["n_dup_lines"].tolist() == [0, 1]
