"""The analysis on streams: stateless stages run as they are, counts as running aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokenizer
from ..scratch import forget, fresh_path


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the Parquet table ``name`` of a folder, a single file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/{name}.parquet*")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stateless stream over what there is now, into a table in the shared folder; it resumes after a loss."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    forget(spark, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def token_types(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, type, n``: token types of each document of a stream, without state."""
    kinds = F.transform(tokenizer.T.lex(F.col("text")), tokenizer.T.token_type)
    # exploding an array of one element computes what it holds once, however often it is used then
    each = docs.select("doc_id", "lang", F.explode(F.array(kinds)).alias("kinds"))
    found = each.select("doc_id", "lang", "kinds", F.explode(F.array_distinct("kinds")).alias("type"))
    return found.select("doc_id", "lang", "type", F.aggregate("kinds", F.lit(0).cast("bigint"), lambda n, k: n + (k == F.col("type")).cast("bigint")).alias("n"))
