"""Models too large to be broadcast: what a block of sentences may use of them is joined to the block, not to each sentence."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

#: Two to this power sentences, of at most 1,023 tokens, are a block.
BLOCK_BITS = 9


def blocked(sents: DataFrame, name: str) -> DataFrame:
    """``sents`` with the number ``__block`` of a few hundred neighbouring rows, written to the shared folder."""
    return materialize(sents.withColumn("__block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), name)


def together(held: DataFrame, known: DataFrame, run, schema) -> DataFrame:
    """What ``run(sentences, rows of known)`` gives for each block, as Arrow tables; one block at a time is in memory."""

    def one(sents: pa.Table, rows: pa.Table) -> pa.Table:
        return run(sents.combine_chunks(), rows)

    # another name, as both may come from one table
    return held.groupBy("__block").cogroup(known.withColumnRenamed("__block", "__of").groupBy("__of")).applyInArrow(one, schema)


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a table in one piece."""
    found = table.column(name)
    return found.chunk(0) if found.num_chunks == 1 else pa.concat_arrays(found.chunks) if found.num_chunks else pa.array([], found.type)
