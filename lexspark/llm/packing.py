"""Harmonic packing of documents into sequences of fixed capacity.

A document of ``n`` tokens is cut into ``n // capacity`` full pieces and a remainder of ``r`` tokens.  A full piece
has a bin of its own.  The remainder belongs to class ``j = capacity // r``, that is ``r`` lies in
``(capacity / (j + 1), capacity / j]``, and each bin of class ``j`` takes exactly ``j`` pieces, which always fit.
Classes are filled independently in shards, told by the document's id: a bin never needs another shard's state, and a
document more changes the bins of its own shard only.  At most one bin of each class and shard is part-filled.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SQL_N_TOKENS, materialize, n_tokens, small_side

CAPACITY = 2048
#: Shards of each class.  A choice for a corpus, to be kept while it grows: about a 100,000th of the documents it will
#: have.  The output depends on it, and on nothing else about the corpus's size.
SHARDS = 64


def stored_order(docs: DataFrame, columns: tuple = ("doc_id", "text")) -> DataFrame | None:
    """``columns`` of ``docs``, then ``ordinal``, the place of each row in the files it is read from: by number of the file, then by row.

    A table that was written in a sorted order so keeps it without another column.  None where ``docs`` isn't read from
    Parquet files as it is.  Only the rows of each file are counted; nothing is sorted or shuffled.
    """
    name = F.col("_metadata.file_name")
    file = F.struct(F.coalesce(F.regexp_extract(name, r"^part-([0-9]+)", 1).try_cast("bigint"), F.lit(0)).alias("part"), name.alias("name"))
    try:
        placed = docs.select(*columns, file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException as error:
        if error.getCondition() != "UNRESOLVED_COLUMN.WITH_SUGGESTION":
            raise
        return None
    # a row for each file of the table
    files = docs.groupBy(file.alias("__of")).agg(F.count("*").alias("n"))
    ahead = files.select("__of", F.coalesce(F.sum("n").over(W.orderBy("__of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    ahead = small_side(materialize(ahead, "files"))
    return placed.join(ahead, F.col("__file") == F.col("__of")).select(*columns, (F.col("__ahead") + F.col("__row")).alias("ordinal"))


def pack(docs: DataFrame, capacity: int = CAPACITY, shards: int = SHARDS, length: Column | None = None, order: Column | None = None) -> DataFrame:
    """``doc_id, piece, start_token, n_tokens, class, shard, bin_id, slot``: one row for each piece of each document.

    ``piece`` counts from 0, ``start_token`` is where it begins in the document, ``slot`` its place in the bin from 0.
    Bins are filled by id, or by ``order`` (a BIGINT), which then is the column ``ordinal``, the second one.

    A document without tokens (null, empty or blank text) has one row of 0 tokens, class 0 and null ``bin_id`` and
    ``slot``.  Very long texts are cut into as many pieces as they need.  Rows with a null id are told to shards by their
    length.  Repeated rows are packed each; rows alike in all of these columns may swap slots.  Extra columns are
    ignored, whatever their names, and an empty table gives no rows.  Only ids, order and lengths are shuffled, never texts.
    """
    if capacity < 1 or shards < 1:
        raise ValueError("capacity and shards must be positive")
    n = (n_tokens(F.col("text")) if length is None else F.coalesce(length, F.lit(0))).cast("bigint")
    first = ["doc_id"] if order is None else ["doc_id", "ordinal"]
    narrow = docs.select("doc_id", *([] if order is None else [order.cast("bigint").alias("ordinal")]), n.alias("n")).withColumn("shard", F.pmod(F.coalesce(F.col("doc_id").cast("bigint"), F.col("n")), F.lit(shards)).cast("bigint"))
    cap = F.lit(capacity).cast("bigint")
    last = F.greatest(F.floor((F.col("n") + cap - 1) / cap), F.lit(1)) - 1
    pieces = narrow.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    pieces = pieces.withColumn("start_token", F.col("piece") * cap).withColumn("n_tokens", F.least(cap, F.col("n") - F.col("piece") * cap))
    pieces = pieces.withColumn("class", F.when(F.col("n_tokens") > 0, F.floor(cap / F.greatest(F.col("n_tokens"), F.lit(1)))).otherwise(F.lit(0)).cast("bigint"))
    full = F.col("class") > 0
    # pieces without tokens go in no bin: they aren't brought together, however many they are
    apart = F.when(~full, F.xxhash64(*first))
    at = F.row_number().over(W.partitionBy("class", "shard", apart).orderBy(*reversed(first), "piece", "n_tokens")).cast("bigint") - 1
    numbered = pieces.withColumn("at", at)
    per = F.greatest(F.col("class"), F.lit(1))
    return numbered.select(
        *first, "piece", "start_token", "n_tokens", "class", "shard",
        F.when(full, F.concat_ws("-", "class", "shard", F.floor(F.col("at") / per).cast("bigint"))).alias("bin_id"),
        F.when(full, F.col("at") % per).cast("bigint").alias("slot"),
    )


def pack_in_order(docs: DataFrame, **how) -> DataFrame:
    """:func:`pack` in the stored order of ``docs``, by id where it has none; ``ordinal`` then is null."""
    placed = stored_order(docs)
    return pack(docs, order=F.lit(None), **how) if placed is None else pack(placed, order=F.col("ordinal"), **how)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {SQL_N_TOKENS} AS n FROM documents),
p AS (SELECT doc_id, ((coalesce(doc_id, n) % {SHARDS}) + {SHARDS}) % {SHARDS} AS shard, n, unnest(range(0, greatest((n + {CAPACITY - 1}) // {CAPACITY}, 1)))::BIGINT AS piece FROM d),
q AS (SELECT doc_id, shard, piece, piece * {CAPACITY} AS start_token, least({CAPACITY}, n - piece * {CAPACITY}) AS n_tokens FROM p),
c AS (SELECT *, CASE WHEN n_tokens > 0 THEN {CAPACITY} // n_tokens ELSE 0 END::BIGINT AS class FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY class, shard ORDER BY doc_id NULLS FIRST, piece, n_tokens) - 1 AS pos FROM c)
SELECT doc_id, piece, start_token::BIGINT AS start_token, n_tokens::BIGINT AS n_tokens, class, shard::BIGINT AS shard,
       CASE WHEN class > 0 THEN class || '-' || shard || '-' || (pos // class) END AS bin_id,
       CASE WHEN class > 0 THEN pos % class END::BIGINT AS slot
FROM r"""
