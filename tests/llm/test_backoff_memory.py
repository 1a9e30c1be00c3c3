"""What a task of the backoff model holds and sends."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tillsight.llm import backoff
from tillsight.llm.text import Words, utf8


def test_a_long_batch_is_worked_on_in_small_slices():
    """A batch of 12 MB of text; with slices of 4 MB the peak is above 200 MB."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 2000)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tally = backoff._tally(lambda words: backoff.pairs(words, backoff.codes(words, np.zeros(0, np.uint64)))[0])
    tracemalloc.start()
    try:
        counted = sum(part["n"].to_numpy().sum() for part in tally(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counted == 1000 * 1999 and peak < 200 << 20


def test_frequent_words_are_sent_by_number():
    words = Words(*utf8(pa.array(["a b a c", "c d"])))
    known = np.unique(backoff.marked(words)[[0, 3]])
    code = backoff.codes(words, known)
    assert (code >= 0).tolist() == [True, False, True, True, True, False]
    assert (known[code[code >= 0]] == backoff.marked(words)[code >= 0]).all()
