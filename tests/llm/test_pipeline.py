"""The pipeline's stages on awkward documents."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import cases  # noqa: E402
import corpus_pipeline  # noqa: E402
from test_operators import brute_components, brute_sentences, shingles  # noqa: E402


@pytest.mark.parametrize("repeat", [True, False])
def test_stages_one_by_one(spark, repeat):
    docs = cases.documents(spark, cases.rows(repeat))
    texts = cases.texts()
    lettered = {k for k, t in enumerate(texts) if any(c.isalpha() for c in t or "")}

    first = corpus_pipeline.identify_languages(spark, docs, "").cache()
    assert first.columns == docs.columns
    assert {r["doc_id"] for r in first.collect()} == lettered
    assert first.where("lang IS NULL").count() == 0

    second = corpus_pipeline.drop_near_duplicates(spark, first, "").cache()
    expected = brute_components([shingles(t, 5) if k in lettered else frozenset() for k, t in enumerate(texts)], 80)
    assert second.columns == docs.columns
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(k for k in lettered if expected[k] == k)

    third = corpus_pipeline.drop_repeated_passages(spark, second, "").cache()
    kept = sorted(r["doc_id"] for r in second.collect())
    cleaned = brute_sentences([texts[k] for k in kept])
    assert third.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in third.collect()} == {
        k: (cleaned[i][0], len(cleaned[i][0])) for i, k in enumerate(kept)}

    fourth = corpus_pipeline.mix_sources(spark, third, "").cache()
    assert fourth.columns == docs.columns
    before = {r["doc_id"]: r.asDict() for r in third.collect()}
    assert all(before[r["doc_id"]] == r.asDict() for r in fourth.collect())

    last = corpus_pipeline.encode_pieces(spark, fourth, "")
    assert last.count() == fourth.count()


def test_run_and_empty_table(spark, tmp_path):
    cases.documents(spark).write.parquet(str(tmp_path / "full/documents.parquet"))
    cases.documents(spark, []).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert 0 < corpus_pipeline.run(spark, str(tmp_path / "full")).count() <= len(cases.texts())
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "repeated_passages", "mixing", "encoding"]


def test_language_stage_rejects_junk_and_contradiction(spark):
    import random

    rng = random.Random(3)
    words = {"en": "the and of with that this from house water which people".split(), "de": "der und die mit das nicht für haus wasser welche".split()}
    text = lambda lang, n=40: " ".join(rng.choice(words[lang]) for _ in range(n))
    clean = [(k, text(lang), None if k % 7 == 0 else lang) for k in range(600) for lang in [("en", "de")[k % 2]]]
    clean += [(600, "the", "en"), (601, "a", "en"), (602, "und", None)]
    junk = [(700 + k, "".join(rng.choice("qxzjkvyp ") for _ in range(200)), (None, "en")[k % 2]) for k in range(4)]
    foreign = [(710, "Это русский текст о погоде и городе. " * 5, "en"), (711, "これは日本語の文章です。" * 9, None)]
    contrary = [(720 + k, text("de"), "en") for k in range(3)]
    frame = spark.createDataFrame(clean + junk + foreign + contrary, "doc_id long, text string, lang string").repartition(3)
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_languages(spark, frame, "").collect()}
    assert sorted(kept) == [k for k, _, _ in clean]
    assert all(kept[k] == ("en", "de")[k % 2] for k in range(600))
