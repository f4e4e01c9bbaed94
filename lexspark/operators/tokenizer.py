"""Tokenizer and sentence splitter.  Both are narrow: no shuffle, legal on streams, and a document is never one task's all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import text as T


def tokens(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep``, then ``pos, token, type``: a row for each token, ``pos`` from 0 in its text."""
    exploded = docs.select(*keep, F.posexplode(T.lex(F.col(text))).alias("pos", "token"))
    return exploded.withColumn("type", T.token_type(F.col("token")))


def sentences(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep``, then ``sent_id, tokens``: a row for each sentence with its ``token, type`` structs.

    In Arrow batches, as expressions within arrays are interpreted token by token.
    """
    kept = docs.select(*keep)
    narrow = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = StructType([*kept.schema.fields, *_parse_datatype_string("sent_id int, tokens array<struct<token:string,type:int>>").fields])
    n, names = len(kept.columns), [*kept.columns, "sent_id", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = T.Types()
        for batch in batches:
            for a, b in T.slices(batch.column(n)):
                tokens, kinds, offsets, of = T.py_sentences(batch.column(n)[a:b].to_pylist(), types)
                at = pa.array(of + a, pa.int64())
                cut = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(kinds, pa.int32())], ["token", "type"]))
                nth = np.arange(len(of)) - np.searchsorted(of, of)
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[:n]], pa.array(nth, pa.int32()), cut], names=names)

    return narrow.mapInArrow(run, schema)


def sentence_tokens(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep``, then ``sent_id, idx, token, type``, ``idx`` from 0 in the sentence."""
    rows = sentences(docs, keep, text).select(*keep, "sent_id", F.posexplode("tokens").alias("idx", "t"))
    return rows.select(*keep, "sent_id", "idx", "t.token", "t.type")


def type_counts(docs: DataFrame, by: tuple = ("lang",), text: str = "text") -> DataFrame:
    """``by, type, n``: how many tokens there are of each type."""
    return tokens(docs, by, text).groupBy(*by, "type").agg(F.count("*").alias("n"))
