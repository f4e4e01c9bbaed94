"""Shared helpers of the training-data operators: scratch tables, checked broadcasts, text measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, fresh_path, materialize, shared_dir  # noqa: F401

#: Most rows of a narrow table that are sent to every executor; beyond it joins shuffle instead.
BROADCAST_ROWS = 1_000_000

#: A token is a maximal run of characters other than blank, tab, CR and LF.
TOKEN_RE = r"[^ \t\r\n]+"


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow, materialised table for broadcast if a count shows at most ``rows`` rows; else leave it."""
    return F.broadcast(df) if df.count() <= rows else df


def n_tokens(text: Column) -> Column:
    """Token count as BIGINT; null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_RE)), F.lit(0)).cast("bigint")


SQL_N_TOKENS = r"coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0)::BIGINT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measures(text: Column) -> dict[str, Column]:
    """Surface measures of a text, each a DOUBLE and 0 for null or empty text.

    ``symbols`` and ``digits`` and ``upper`` are shares of characters, ``pipes`` and ``bangs`` counts per word,
    ``repeats`` is 1 - distinct words / words, ``word_len`` characters per word, ``line_len`` log of characters
    per line, ``log_chars`` the log of the length.  Words are separated by single blanks.
    """
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.split(t, " ")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    return {
        "symbols": count(r"[*#%&$@^~=+<>{}_]") / chars,
        "digits": count(r"[0-9]") / chars,
        "upper": count(r"[A-ZÀ-ÖØ-Þ]") / chars,
        "pipes": count(r"[|]") / n,
        "bangs": count(r"!") / n,
        "repeats": F.lit(1.0) - F.size(F.array_distinct(words)).cast("double") / n,
        "word_len": F.length(t).cast("double") / n,
        "line_len": F.log1p(F.length(t) / (count(r"\n") + 1.0)),
        "log_chars": F.log1p(F.length(t).cast("double")),
    }
