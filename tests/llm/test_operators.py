"""Each operator on awkward documents, against a brute-force version."""

import hashlib
import math
import os
import struct
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import cases  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tillsight.llm import backoff, fingerprint, langid, minhash, mixing, pieces, quality, sentences, suffixes  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def single(spark):
    """Without repeated rows."""
    return cases.documents(spark, cases.rows(repeat=False)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.documents(spark, [])


def by_id(frame):
    return {r["doc_id"]: r.asDict() for r in frame.collect()}


def no_id(spark):
    return cases.documents(spark, [(None, "No id has this text, it is ordinary otherwise.", "en", "s", 3, 0.0, "", 0)] * 2)


# -- fingerprints

def test_fingerprints(single, docs, empty, spark):
    found = by_id(fingerprint.fingerprints(single))
    texts = [t or "" for t in cases.texts()]
    for k, text in enumerate(texts):
        following = texts[k - 1]
        third = len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        row = found[k]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        if edited == text:
            assert row["near_edited"] == 1 and row["fingerprint"] == row["edited_fingerprint"]
    # Texts have equal fingerprints exactly if they have the same paragraphs.
    for a in range(len(texts)):
        for b in range(a):
            same = sorted(texts[a].split("\n")) == sorted(texts[b].split("\n"))
            assert (found[a]["fingerprint"] == found[b]["fingerprint"]) == same
    assert found[1]["near_edited"] > found[1]["near_next"]
    assert fingerprint.fingerprints(docs).count() == docs.count()
    assert fingerprint.fingerprints(empty).count() == 0
    assert fingerprint.fingerprints(no_id(spark)).count() == 2


def test_fingerprints_add_and_subtract(spark):
    parts = ["one two three", "four five", "six", "one two three"]
    frame = spark.createDataFrame(
        [(0, "\n".join(parts)), (1, "\n".join(reversed(parts))), (2, "\n".join(parts[:2])), (3, "\n".join(parts[2:]))], "k long, t string")
    vectors = {r["k"]: r["vector"] for r in fingerprint.vectors(frame, "t", "k").collect()}
    assert vectors[0] == vectors[1] and vectors[0] != vectors[2]
    pair = spark.createDataFrame([(vectors[2], vectors[3], vectors[0])], "a array<long>, b array<long>, c array<long>")
    row = pair.select(fingerprint.add_vectors(F.col("a"), F.col("b")).alias("sum"),
                      fingerprint.subtract_vectors(F.col("c"), F.col("b")).alias("rest")).first()
    assert row["sum"] == vectors[0] and row["rest"] == vectors[2]


def test_fingerprint_plan_has_no_python(single):
    plan = fingerprint.fingerprints(single)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# -- mixing

def test_mixing_meets_targets(docs, empty, spark):
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count()
    tokens = sum(r["_tokens"] for r in found)
    assert all(r["_tokens"] == len(cases.words(r["text"])) for r in found)
    for dimension, power in mixing.POWERS.items():
        own = Counter()
        for r in found:
            own[r[f"_{dimension}"]] += r["_tokens"]
        raked = Counter()
        for r in found:
            raked[r[f"_{dimension}"]] += r["_tokens"] * r["_weight"]
        total = sum(v ** power for v in own.values() if v)
        for name, value in own.items():
            if value:
                assert raked[name] == pytest.approx(value ** power / total * tokens, rel=1e-6)
    assert sum(r["_tokens"] * r["_prob"] for r in found) == pytest.approx(mixing.BUDGET * tokens, rel=1e-6)
    for r in found:
        draw = int(hashlib.md5(f"{r['doc_id']}:mix".encode()).hexdigest()[:12], 16) / 2 ** 48
        assert r["_kept"] == (draw < r["_prob"])
    assert mixing.mix(empty).count() == 0
    assert mixing.sample_documents(no_id(spark)).count() in (0, 2)


# -- sentence spans

def test_sentences(single, docs, empty, spark):
    found = by_id(sentences.remove_passages(single, counts=True))
    expected = brute_sentences(cases.texts())
    assert {k: (r["text"], r["n_removed"]) for k, r in found.items()} == expected
    removed = [k for k, (_, n) in expected.items() if n]
    assert removed and len(removed) < len(expected)
    # Repeated rows are one document, and columns with clashing names are carried.
    twice = sentences.remove_passages(docs)
    assert twice.columns == docs.columns and twice.count() == docs.count()
    assert {(r["doc_id"], r["text"]) for r in twice.collect()} == {(k, t) for k, (t, _) in expected.items()}
    assert sentences.remove_passages(empty).count() == 0
    assert [r["text"] for r in sentences.remove_passages(no_id(spark)).collect()] == ["No id has this text, it is ordinary otherwise."] * 2


def brute_sentences(texts):
    import re

    seen, out = set(), {}
    for k, text in enumerate(texts):
        parts, before = [], None
        for m in cases.WORD.finditer(text or ""):
            if before is None or re.search(r"[.!?]$|[.!?][\"')\]}]$", before.group()) or "\n" in text[before.end():m.start()]:
                parts.append([m.start(), []])
            parts[-1][1].append(m.group().translate(cases.LOWER))
            before = m
        if not parts:
            out[k] = (text, 0)
            continue
        parts[0][0] = 0
        gone = [False] * len(parts)
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                n = sum(len(p[1]) for p in parts[a:b])
                if b - a >= 3 and n >= 10 or n >= 25:
                    key = tuple(w for p in parts[a:b] for w in p[1])
                    gone[a:b] = [True] * (b - a) if key in seen else gone[a:b]
                    seen.add(key)
                    break
        bounds = [p[0] for p in parts] + [len(text)]
        out[k] = ("".join(text[bounds[i]:bounds[i + 1]] for i in range(len(parts)) if not gone[i]), sum(gone))
    return out


def brute_passages(texts):
    """Every run of sentences that is long enough, by definition. Sentences end with . here."""
    seen, out = set(), {}
    for k, text in enumerate(texts):
        parts = [s.split() for s in text.split("\n")]
        gone = [False] * len(parts)
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                words = tuple(w.lower() for p in parts[a:b] for w in p)
                if b - a >= 3 and len(words) >= 10 or len(words) >= 25:
                    gone[a:b] = [True] * (b - a) if words in seen else gone[a:b]
                    seen.add(words)
        out[k] = (" ".join(" ".join(p) for p, g in zip(parts, gone, strict=True) if not g), sum(gone))
    return out


def test_sentences_of_every_passage(spark):
    import random

    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n)) + "."
    passages = [[line(n) for n in sizes] for sizes in ((31, 6, 16), (30, 20), (3, 3, 3, 3), (20, 30, 2, 2), (24,), (12, 12), (25,), (2, 2, 40, 1, 1))]
    passages += [[line(rng.choice((1, 2, 4, 9, 14, 26))) for _ in range(rng.randint(1, 7))] for _ in range(60)]
    texts = ["\n".join([line(7), *p, line(7)]) for p in passages * 2] + ["\n".join(passages[0][1:] * 3), "\n".join(passages[3] + passages[7][1:])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {k: (" ".join(r["text"].split()), r["n_removed"]) for k, r in by_id(sentences.remove_passages(frame, counts=True)).items()}
    assert found == brute_passages(texts)
    assert [found[len(passages) + k][1] for k in range(8)] == [3, 2, 4, 4, 0, 0, 1, 5]


# -- quality

def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(40)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.QualityModel.fit(docs, labels)
    found = model.transform(docs).collect()
    assert len(found) == docs.count()
    texts = cases.texts()
    for r in found:
        text = texts[r["doc_id"]] or ""
        words = cases.words(text)
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        number = Counter(windows)
        repeats = len({j for i, w in enumerate(windows) if number[w] > 1 for j in range(i, i + 8)})
        lines, dup = set(), 0
        for line in text.split("\n"):
            if cases.words(line):
                dup += line in lines
                lines.add(line)
        failed = len(words) < 20 or 100 * repeats > 30 * len(words)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeats, failed)
        assert r["kept"] == (not failed and r["score"] >= model.threshold)
    assert model.transform(empty).count() == 0
    free = quality.QualityModel.fit(empty, labels)
    assert all(r["kept"] != r["base_failed"] for r in free.transform(docs).collect())
    assert quality.QualityModel.fit(no_id(spark), labels.limit(0)).transform(no_id(spark)).count() == 2


def test_threshold():
    import numpy as np

    assert -1 < quality.best_threshold(np.array([-2.0, -1, 1, 2]), np.array([False, False, True, True])) < 1
    assert quality.best_threshold(np.array([1.0, 2]), np.array([True, True])) == -math.inf


# -- near duplicates

def shingles(text, n):
    words = cases.words((text or "").translate(cases.LOWER))
    return frozenset([tuple(words)] if 0 < len(words) < n else (tuple(words[i:i + n]) for i in range(len(words) - n + 1)))


def brute_components(sets, percent):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(x) for x in range(len(sets))]


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, spark, n, percent):
    sets = [shingles(t, n) for t in cases.texts()]
    expected = brute_components(sets, percent)
    assert len(set(expected)) < len(expected)
    found = minhash.near_duplicates(docs, n, percent).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (
            len(sets[r["doc_id"]]), expected[r["doc_id"]], expected[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(empty).count() == 0
    assert {(r["component_id"], r["kept"]) for r in minhash.near_duplicates(no_id(spark)).collect()} == {(None, True)}


def test_group_without_a_common_hub(spark, monkeypatch):
    """Copies of a text that is not there itself, in small blocks: links between members other than the hub count."""
    import random

    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 16)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(150)]
    texts = []
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(150)] = f"y{rng.randint(0, 9999)}"
        texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = by_id(minhash.near_duplicates(frame, 3, 85))
    expected = brute_components([shingles(t, 3) for t in texts], 85)
    assert 2 < len(set(expected)) < 90
    assert [found[k]["component_id"] for k in range(90)] == expected


def test_components(spark):
    from tillsight.llm.components import connected_components

    chain = [(k, k + 1) for k in range(1, 60)] + [(100, 7), (200, 201), (201, 202), (202, 200), (5, 5), (None, 3), (300, 300)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 1 for k in range(1, 61)}, 100: 1, 200: 200, 201: 200, 202: 200}


# -- suffixes

def test_suffixes(single, docs, empty, spark, monkeypatch):
    texts = cases.texts()
    expected, seen = {}, set()
    for k, text in enumerate(texts):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(data[p:p + 100])
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        expected[k] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert sum(e[1] > 0 for e in expected.values()) > 5
    for hot in (64, 1):
        monkeypatch.setattr(suffixes, "HOT_RUNS", hot)
        found = by_id(suffixes.remove_repeats(single))
        assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in found.items()} == expected
    again = suffixes.remove_repeats(docs).collect()
    assert len(again) == docs.count()
    assert {(r["doc_id"], r["kept_sha256"]) for r in again} == {(k, e[3]) for k, e in expected.items()}
    assert suffixes.remove_repeats(empty).count() == 0
    assert [r["n_removed"] for r in suffixes.remove_repeats(no_id(spark)).collect()] == [0, 0]


# -- pieces

def test_pieces(docs, empty, spark):
    import sentencepiece

    model = pieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = cases.texts()
    found = pieces.encode_documents(docs, model, "doc_id", digests=True)
    for r in found.collect():
        text = texts[r["doc_id"]] or ""
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(r["begins"], r["ends"], strict=True)) == data
    back = pieces.decode_ids(found, model, "doc_id").collect()
    assert all(r["text"] == library.decode(library.encode(texts[r["doc_id"]] or "")) for r in back)
    assert pieces.encode_documents(empty, model, "doc_id").count() == 0


@pytest.mark.parametrize("squeeze", [True, False])
def test_normaliser_follows_the_character_map(squeeze):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(
        rule_name="nmt_nfkc_cf", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    mine = pieces.Normaliser({"charsmap": proto.normalizer_spec.precompiled_charsmap, "prefix": True, "squeeze": squeeze, "escape": True})
    for text in ["Hello  World", "  ＡＢＣ　①② ﬁne ｶﾞ é  ", "", "   ", "日本語㌔ é x", "a\tb\nc", "​x ½", "İß"]:
        data, origin = mine(text.encode())
        assert data.tobytes().decode() == library.normalize(text)
        assert len(origin) == len(data) + 1 and (origin[1:] >= origin[:-1]).all()


# -- language-model scores

@pytest.mark.parametrize("hot", [0, 5, 500_000])
def test_backoff(docs, single, empty, spark, monkeypatch, hot):
    monkeypatch.setattr(backoff, "HOT_WORDS", hot)
    monkeypatch.setattr(backoff, "HOT_PAIRS", hot)
    lists = [cases.words((t or "").translate(cases.LOWER)) for t in cases.texts()]
    one = Counter(w for words in lists for w in words)
    two = Counter(p for words in lists for p in zip(words, words[1:], strict=False))
    model = backoff.BackoffModel.fit(single)
    assert model.words.count() == len(one) and model.pairs.count() == len(two)
    for own in (True, False):
        found = by_id(model.transform(single, own))
        for k, words in enumerate(lists):
            score = brute_backoff(words, one, two, int(own))
            assert found[k]["n_words"] == len(words)
            assert found[k]["log_score"] == pytest.approx(score, abs=1e-6)
            assert found[k]["perplexity"] == (pytest.approx(math.exp(-score / len(words)), rel=1e-6) if words else None)
    # Texts that the model has not seen: words and pairs, known and unknown, beside junk.
    texts = ["never-seen words-here zzz-zzz", f"{lists[3][0]} never-seen {lists[3][0]}", "never-seen " * 50, ""]
    other = cases.documents(spark, [(k, t, "en", "s", len(t), 0.0, "", 0) for k, t in enumerate(texts)])
    found = by_id(model.transform(other))
    for k, text in enumerate(texts):
        assert found[k]["log_score"] == pytest.approx(brute_backoff(cases.words(text), one, two, 0), abs=1e-6)
    assert backoff.BackoffModel.fit(docs).transform(docs, own=True).count() == single.count()
    assert backoff.BackoffModel.fit(empty).transform(empty).count() == 0
    assert backoff.BackoffModel.fit(empty).transform(single).count() == single.count()
    assert backoff.BackoffModel.fit(no_id(spark)).transform(no_id(spark)).count() == 1


def brute_backoff(words, one, two, own):
    total, alpha = max(sum(one.values()) - own, 1), backoff.BACKOFF
    score = 0.0
    for at, w in enumerate(words):
        pair = (words[at - 1], w) if at else None
        if pair and two[pair] > own:
            score += math.log((two[pair] - own) / (one[pair[0]] - own))
        else:
            score += math.log((alpha if at else 1) * max(one[w] - own, alpha) / total)
    return score


def test_backoff_rare_words_are_no_fluent_text(spark):
    """Words that occur once score below words that recur, alone and in a row."""
    common = "the cat sat on the mat and the dog sat on the rug"
    texts = [common] * 6 + [" ".join(f"junk{k}x{i}" for i in range(13)) for k in range(6)]
    docs = cases.documents(spark, [(k, t, "en", "s", len(t), 0.0, "", 0) for k, t in enumerate(texts)])
    found = by_id(backoff.BackoffModel.fit(docs).transform(docs, own=True))
    assert max(found[k]["perplexity"] for k in range(6)) * 20 < min(found[k]["perplexity"] for k in range(6, 12))


# -- languages

def test_languages(docs, empty, spark):
    words = {"en": "the and of with that this from", "de": "der und die mit das nicht für", "fr": "le et la avec que pas une"}
    rows = [(k, " ".join(words[lang].split()[(k + j) % 7] for j in range(12)), lang)
            for k in range(120) for lang in [("en", "de", "fr")[k % 3]]]
    frame = spark.createDataFrame([*rows, (None, "der und die", None), (500, None, "en"), (501, "12 34 !", "de"), (502, "", "fr")],
                                  "doc_id long, text string, lang string")
    found = langid.identify(frame).collect()
    assert len(found) == 124
    import zlib

    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    names = {r["doc_id"]: r["lang_pred"] for r in found}
    assert [names[k] for k in range(120)] == [lang for _, _, lang in rows]
    assert names[None] == "de" and names[500] == names[501] == names[502] == "und"
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs).count() == docs.count()
