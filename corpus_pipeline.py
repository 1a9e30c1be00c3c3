"""From raw documents to token ids: language ID, near duplicates, repeated passages, mixing, SentencePiece encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; between stages the documents are written as Parquet to the
checkpoint folder and read again. All stages but the last return the columns of ``documents``. Stages keep clean documents: they
take out what they are for and leave the rest as it is.

Defined results: every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns,
as its operator's docstring says. A null or empty text has no language and is left out by the first stage, as are texts
that no learned language makes likely or that contradict a given ``lang``. Of rows that share an id, the near-duplicate stage keeps one.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillsight.llm.langid import EVIDENCE, LanguageModel, held_out
from tillsight.llm.minhash import BROADCAST_IDS, near_duplicates
from tillsight.llm.mixing import sample_documents
from tillsight.llm.pieces import default_model, encode_documents
from tillsight.llm.sentences import remove_passages
from tillsight.session import cut_lineage, ensure_checkpoint_dir


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text of a learned language, and of the given one; ``lang`` is predicted where it is null."""
    learned = docs.where(~held_out())
    model = LanguageModel.fit(learned)
    if not model.languages:
        # Without a single given language nothing can be learned, and nothing is rejected.
        return docs
    # The prediction's columns may have names that the documents have as well.
    names = [f"_c{k}" if c in ("lang_pred", "score", *EVIDENCE) else c for k, c in enumerate(docs.columns)]
    found = model.judge(docs.toDF(*names), *names, limits=model.limits(learned))
    return found.select(*[(F.coalesce("lang", "lang_pred") if c == "lang" else F.col(f"`{n}`")).alias(c)
                          for n, c in zip(names, docs.columns, strict=True)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one of the smallest id."""
    verdict = cut_lineage(near_duplicates(docs.select("doc_id", "text"), 5, 80))
    dropped = verdict.where("NOT kept").select("doc_id").distinct()
    number = dropped.count()
    kept = docs.join(F.broadcast(dropped) if number <= BROADCAST_IDS else dropped, "doc_id", "left_anti").select(docs.columns)
    twice = cut_lineage(verdict.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    # Rows that share an id: the first by a hash of the row.
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    place = next(f"_row{k}" for k in range(len(docs.columns) + 1) if f"_row{k}" not in docs.columns)
    one = kept.join(twice, "doc_id", "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(one.select(docs.columns))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without sentences of passages that an earlier document has; ``n_chars`` follows the text."""
    cleaned = remove_passages(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.length("text").cast(kind)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the target weights of sources, languages and topics."""
    return sample_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with the digests of ids and of the text decoded from them."""
    return encode_documents(docs, default_model(), "doc_id", "lang", "source", spans=False, digests=True)


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]

#: Language model, shingle hashes and SentencePiece merges are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = f"{folder}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
