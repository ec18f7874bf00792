"""From raw documents to packed token windows: five stages, each of which works on all that its predecessor kept.

All stages but the last return the columns of their input, whatever columns there are beside doc_id and text. Null texts
count as empty ones. Rows without a doc_id go through every stage that can judge them by their text. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thicketry.llm import common, langid, packing, passages, setjoin, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted to the labelled ones among them scores below 0.5.

    Empty texts score by the bias alone. If none is labelled there is nothing to judge by, and all stay. Repeated rows are judged alike.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one of the corpus's languages is found; texts without letters, empty ones too, or like none of them, go.

    Languages are those of the rows with a lang. If there are none, nothing can be rejected, and all stay.
    """
    prototypes = langid.train(docs)
    return langid.accepted(docs, prototypes, langid.least_scores(docs, prototypes))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by a similarity of 0.8 on shingles of five words.

    Documents without words are linked with nothing and stay, as do those without an id. Of equal rows one stays; different
    texts under one id are different documents.
    """
    return setjoin.representatives(docs, size=5, threshold=(80, 100))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which nothing is left go. Rows without an id are untouched."""
    return passages.remove(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, each with its place in a window of 2048. An empty text is its end id alone."""
    return packing.pack(docs, common.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("near_copies", drop_near_copies),
    ("passages", cut_repeats),
    ("packing", pack_windows),
]

#: A fitted model, a similarity join and packing have no SQL of the same rows; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
