"""Importance resampling, SimHash links and whitening against brute-force versions."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))

import cases  # noqa: E402

from tillsight.llm import resampling, simhash, whitening  # noqa: E402

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.documents(spark, [])


# -- importance resampling

def resampled(rows, target, longest, buckets, percent, least):
    def features(text):
        words = ALNUM.findall((text or "").translate(cases.LOWER))
        runs = [" ".join(words[k:k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0]))
    drawn = percent * len(enough) // 100
    return sorted(((*x[:1], *x[2:]) for x in out), key=str), [(x[4], x[0]) for x in enough[:drawn]]


@pytest.mark.parametrize("longest,buckets,percent,least", [(1, 10_000, 10, 20), (2, 97, 60, 1), (3, 1, 100, 0)])
def test_importance_ranks(spark, docs, longest, buckets, percent, least):
    target = spark.createDataFrame([("the river, cold and bright", 1), (None, 2), ("", 3), ("Evening MARKET letter" * 9, 4)], "text string, rank int")
    extra = docs.withColumnRenamed("gone", "cells").withColumnRenamed("lang", "weight")
    found = resampling.importance_ranks(extra, target, longest, buckets, percent, least).collect()
    rows = [(r[0], r[1]) for r in cases.rows()]
    want, drawn = resampled(rows, [r["text"] for r in target.collect()], longest, buckets, percent, least)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in found), key=str) == want
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["score"], r["doc_id"]) for r in ranked] == drawn


def test_importance_ranks_of_odd_tables(spark, docs, empty):
    target = spark.createDataFrame([], "text string")
    assert resampling.importance_ranks(empty, target).count() == 0
    assert resampling.importance_ranks(docs, target).count() == docs.count()
    none = cases.documents(spark, [(None, "word " * 30, "en", "s", 3, 0.0, "", 0)] * 3)
    found = resampling.importance_ranks(none, target, percent=100).collect()
    assert sorted(r["rank"] for r in found) == [1, 2, 3] and {r["doc_id"] for r in found} == {None}
    kept = resampling.resampled(docs, target, percent=50)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    with pytest.raises(ValueError):
        resampling.importance_ranks(docs, target, buckets=0)


def test_windows_are_offset_pairs():
    text = "Ab-c  Äé日本 \U0001F600\x00y 12"
    pairs = resampling.splitter().pre_tokenize_str(resampling.ascii_lower(text))
    assert [w for w, _ in pairs] == ALNUM.findall(text.translate(cases.LOWER))
    assert all(resampling.ascii_lower(text)[a:b] == w for w, (a, b) in pairs)
    runs = list(resampling.windows([p for _, p in pairs], 2))
    assert len(runs) == 2 * len(pairs) - 1 and runs[-1] == (len(pairs) - 2, 2, len(text))


# -- SimHash

def simhash_of(text, n):
    words = cases.words((text or "").translate(cases.LOWER))
    runs = [" ".join(words[k:k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, ids, bits):
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(values)), 2):
        if (values[a] ^ values[b]).bit_count() <= bits:
            root[find(a)] = find(b)
    least = {}
    for k in range(len(values)):
        if ids[k] is not None:
            least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [least.get(find(k)) for k in range(len(values))]


@pytest.mark.parametrize("n,bits", [(3, 2), (1, 1), (5, 3), (3, 0)])
def test_simhash_duplicates(spark, n, bits):
    rng = random.Random(3)
    rows = cases.rows()
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(3000))
    rows += [(1000 + k, long + f" tail{k % 7}" * (k % 5), "en", "s", 3, 0.0, "", 0) for k in range(30)]
    rows += [(None, rows[0][1], "en", "s", 3, 0.0, "", 0), (None, "nobody else has this text here", "en", "s", 3, 0.0, "", 0)]
    frame = cases.documents(spark, rows).withColumnRenamed("gone", "bits").withColumnRenamed("lang", "component_id")
    found = simhash.simhash_duplicates(frame, n, bits).collect()
    values = [simhash_of(r[1], n) for r in rows]
    want = components(values, [r[0] for r in rows], bits)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=str) == sorted(
        ((r[0], f"{v:016x}", c) for r, v, c in zip(rows, values, want, strict=True)), key=str)


def test_simhash_of_odd_tables(spark, empty):
    assert simhash.simhash_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.simhash_duplicates(empty, bits=4)


def test_xxh64_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = rng.integers(0, 3000, 2000)
    ends = starts + rng.integers(0, 200, 2000)
    want = [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]
    assert simhash.xxh64(data, starts, ends, 42).tolist() == want


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_position_sets_avoid_any_positions(bits):
    for size in (4, 8 - bits):
        sets = simhash.position_sets(size, bits)
        assert all(any(not set(s) & set(bad) for s in sets) for bad in combinations(range(8), bits))


def test_large_lists_give_the_same_links():
    rng = np.random.default_rng(4)
    low = np.unique(rng.integers(0, 1 << 16, 3000)).astype(np.uint64)
    members = low | np.uint64(0xABCDEF0000000000)
    shared = np.uint64(0xFFFFFFFFFFFF0000)
    a, b = simhash.list_links(members, shared, 2)
    roots = dict(zip(a.tolist(), b.tolist(), strict=True))
    values = members.tolist()
    want = components([v & 0xFFFF for v in values[:400]], list(range(400)), 2)
    few_a, few_b = simhash.list_links(members[:400], shared, 2)
    few = dict(zip(few_a.tolist(), few_b.tolist(), strict=True))
    assert [values.index(few.get(v, v)) for v in values[:400]] == want
    assert len(roots) < len(members) and all(r not in roots for r in roots.values())


# -- whitening

def test_rank_one_updates():
    rng = np.random.default_rng(2)
    for d in (1, 2, 7, 30):
        for k in range(24):
            base = rng.normal(size=(d, int(rng.integers(1, 2 * d + 1))))
            matrix = (base @ base.T, np.diag(np.repeat([1.0, 2.0], [d // 2, d - d // 2])), np.zeros((d, d)))[k % 3]
            x = rng.normal(size=d) * 10.0 ** rng.integers(-9, 5)
            if k % 4 == 0:
                x[rng.integers(d)] = 0
            values, vectors = whitening.rank_one_update(*np.linalg.eigh(matrix), x)
            whole = matrix + np.outer(x, x)
            size = np.abs(whole).max() + 1e-300
            assert np.abs(vectors @ np.diag(values) @ vectors.T - whole).max() / size < 1e-12
            assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12


def test_spectra_add_and_merge():
    rng = np.random.default_rng(5)
    rows = np.floor(rng.normal(size=(300, 9)) * 50).astype(np.int64) + 1_000_000
    rows[100:140] = rows[0]
    parts = []
    for chunk in np.array_split(rows, 7):
        one = whitening.Spectrum(9)
        for few in np.array_split(chunk, 4):
            one.add(few)
        parts.append(one)
    first, *rest = parts
    for other in rest:
        first.merge(whitening.Spectrum.of(other.batch().to_pylist()[0]))
    about = rows - rows.mean(0)
    assert first.n == 300 and (first.sums == rows.sum(0)).all()
    assert np.allclose(first.vectors @ np.diag(first.values) @ first.vectors.T, about.T @ about, rtol=1e-11, atol=1e-6)


def whitened(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows])
    n, sums = len(x), x.sum(0)
    about = (x * n - sums) / n
    values, vectors = np.linalg.eigh(about.T @ about / n)
    order = np.argsort(-values)
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, sums, strict=True)) for r in x], about, values[order], vectors[:, order]


def test_whitening(spark):
    rng = np.random.default_rng(8)
    good = [(k, [float(np.float32(c)) for c in rng.normal(size=6) * (9, 5, 3, 2, 1, 0)]) for k in range(200)]
    good += [good[0], good[0], (None, good[7][1])] + [(500, good[3][1])] * 80
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] + [0.0] * 5), (903, [float("-inf")] + [0.0] * 5),
           (904, [1.0, 2.0]), (905, [])]
    frame = spark.createDataFrame([(i, v, "a", 2) for i, v in good + bad], "vec_id long, embedding array<float>, x string, n int").repartition(6)
    found = whitening.whiten(frame, 4).collect()
    n, deviations, about, values, vectors = whitened(good)
    assert len(found) == 4 * n and {r["n"] for r in found} == {n}
    by = {(r["vec_id"], r["component"]): r for r in found}
    signs = {}
    for (i, _), deviation, row in zip(good, deviations, about, strict=True):
        for c in range(1, 5):
            r = by[i, c]
            want = row @ vectors[:, c - 1] / math.sqrt(values[c - 1])
            if i is None:
                continue
            sign = signs.setdefault(c, 1 if want * r["whitened"] > 0 else -1)
            assert abs(sign * r["whitened"] - want) < 1e-9
            assert r["deviation"] == deviation and abs(r["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9
            assert r["identity_error"] < 1e-9
    # The last dimension has no variance: five components at most.
    assert {r["component"] for r in whitening.whiten(frame).collect()} == {1, 2, 3, 4, 5}


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0])] * 3, schema)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (2, [4.0, 3.0])], schema)).collect()
    assert sorted(abs(r["whitened"]) for r in two) == [1.0, 1.0] and {r["deviation"] for r in two} == {128 ** 2}
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [1.0])], schema)).collect()
