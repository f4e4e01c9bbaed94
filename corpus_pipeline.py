"""Corpus pipeline: quality rules, near-duplicates, personal data, source mixture, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the
next stage's documents.  All but the last give the columns of ``documents``, whatever they are, and each works on all
rows.  What becomes of nulls, empty and very long texts, ties, repeated rows, empty tables and other columns is told in
the docstring of the operator that a stage calls, and repeated in short in the stage's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import curriculum, minhash, packing, pii, risk
from lexspark.llm.common import discard, materialize, table

#: Session setting with the secret of the surrogates, in hexadecimal digits; Spark's logs redact what is named so.
KEY_SETTING = "spark.lexspark.surrogates.secret"


def surrogate_key(spark: SparkSession) -> bytes:
    """The session's secret; without one the public key of the queries, which protects nobody."""
    told = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(told) if told else pii.demo_key()


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified rules don't reject (:func:`lexspark.llm.risk.keep_documents`).

    Null and empty texts count as blank; a null language is a stratum of its own; repeated rows are decided alike; an
    empty table stays empty; very long texts are measured whole.
    """
    return risk.keep_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (:func:`lexspark.llm.minhash.drop_near_duplicates`).

    The least id stays; of rows that repeat an id and a text one stays; rows without a text stay, and equal empty texts
    are copies; rows with a null id come last; very long texts are compared whole; an empty table stays empty.
    """
    return minhash.drop_near_duplicates(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced (:func:`lexspark.llm.pii.pseudonymise_documents`); ``n_chars`` follows.

    Null and empty texts stay as they are; repeated rows are rewritten alike; ids don't matter; very long texts are
    rewritten whole; an empty table stays empty.
    """
    return pii.pseudonymise_documents(docs, surrogate_key(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the weights ask (:func:`lexspark.llm.curriculum.mix_documents`).

    A null source is one of its own; texts without tokens take a position where their turn comes, but a source without
    tokens gets none; repeated rows take positions each; ties go by id; an empty table stays empty.
    """
    return curriculum.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins (:func:`lexspark.llm.packing.pack_in_order`), filled in the stored order of ``docs``.

    ``ordinal`` is a document's place in training and tells the copies of one apart; a bin comes when its first piece
    does.  Texts without tokens are in no bin; very long ones fill several; an empty table gives no rows.
    """
    return packing.pack_in_order(docs)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("surrogates", surrogates), ("mixture", mixture), ("packing", packed)]

#: MinHash groups and keyed surrogates have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    What lies between them is written to the shared folder, and removed when the next stage is written.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
