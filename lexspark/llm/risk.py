"""Quality rules with risk-controlled thresholds.

Every document has four measures (:func:`..common.measures`): shares of symbols and capitals, pipes per word and
repeated words.  A *level* is one row of :data:`LEVELS`, a cutoff for each measure; levels run from lenient to
strict, and a document is rejected at a level if any measure exceeds its cutoff or the text is blank.

A labelled holdout decides per stratum how strict the rules may be.  With ``n`` good documents of a stratum, ``k``
of them rejected at a level, the level is certified if the exact one-sided binomial test gives
``P(Bin(n, alpha) <= k) <= delta / m``: then the Clopper-Pearson upper bound of the false-rejection rate at
confidence ``1 - delta / m`` is at most ``alpha``.  ``m`` is the number of strata that have good labelled documents
(Bonferroni); within a stratum levels are tested in the fixed order lenient to strict and testing stops at the first
failure, which needs no further correction.  So with probability at least ``1 - delta`` the false rejections of
*all* strata stay within ``alpha``.  A stratum without a certified level rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, measures

RULES = ("symbols", "upper", "pipes", "repeats")
#: Cutoffs of :data:`RULES` by level, lenient first.
LEVELS = (
    (0.50, 0.90, 3.00, 0.97),
    (0.30, 0.70, 1.00, 0.93),
    (0.20, 0.55, 0.60, 0.90),
    (0.12, 0.40, 0.35, 0.87),
    (0.07, 0.25, 0.20, 0.84),
    (0.04, 0.16, 0.12, 0.81),
    (0.025, 0.11, 0.07, 0.78),
)
#: Most strata whose levels are written into the plan as literals; beyond it they are joined.
LITERAL_STRATA = 10_000


def binomial_tail(n: int, k: int, p: float) -> float:
    """Exact ``P(Bin(n, p) <= k)``: the terms are summed downward from ``k`` until they no longer count."""
    if k >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0:
        total += term
        if i == 0 or (i < n * p and term < total * 1e-17):
            break
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return min(1.0, total)


def _rejections(values: dict[str, Column], blank: Column) -> Column:
    """Number of the first level (from 1) that rejects the row; one more than the levels if none does."""
    first = F.lit(len(LEVELS) + 1)
    for at in range(len(LEVELS), 0, -1):
        hit = blank
        for name, cut in zip(RULES, LEVELS[at - 1]):
            hit = hit | (values[name] > F.lit(cut))
        first = F.when(hit, F.lit(at)).otherwise(first)
    return first


def _blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"[^ \t\r\n]"), F.lit(True))


def scored(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``doc_id, stratum, first_level`` and the measures, for each row; nothing is shuffled."""
    narrow = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), _blank(F.col("text")).alias("blank"), *[c.alias(k) for k, c in measures(F.col("text")).items() if k in RULES])
    return narrow.select("doc_id", "stratum", *RULES, _rejections({k: F.col(k) for k in RULES}, F.col("blank")).alias("first_level"))


def certify(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.1) -> DataFrame:
    """``stratum, level, n_good``: the strictest certified level of each stratum with good labels, 0 for none.

    The unit is the document: one whose id has several labels is good if all are, and counts once; so does one of
    several rows in a stratum, as the first level that rejects any of them.  Labels that are null, of a null id or of no
    document don't count.  All labels are used.  Where the good ids are few enough to be broadcast, only labelled
    documents are measured; otherwise a narrow projection of all documents meets them.
    """
    good = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__good")).agg(F.min("quality").alias("q")).filter("q = 1").select("__good")
    good = materialize(good, "good")
    if good.count() <= BROADCAST_ROWS:
        rows = scored(docs.join(F.broadcast(good), docs["doc_id"] == F.col("__good"), "left_semi"), stratum).select("doc_id", "stratum", "first_level")
    else:
        rows = scored(docs, stratum).select("doc_id", "stratum", "first_level").join(good, F.col("doc_id") == F.col("__good"), "left_semi")
    per = rows.groupBy("doc_id", "stratum").agg(F.min("first_level").alias("first_level"))
    counts = per.groupBy("stratum").agg(F.count("*").alias("n_good"), *[F.sum((F.col("first_level") <= i + 1).cast("bigint")).alias(f"k{i + 1}") for i in range(len(LEVELS))])
    counts = counts.withColumn("m", F.count("*").over(W.partitionBy()))

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for size, strata, *row in zip(*(c.to_pylist() for c in batch.columns[1:])):
                at = 0
                while at < len(row) and binomial_tail(size, row[at], alpha) <= delta / strata:
                    at += 1
                out.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32()), batch.column(1)], names=["stratum", "level", "n_good"])

    return counts.select("stratum", "n_good", "m", *[f"k{i + 1}" for i in range(len(LEVELS))]).mapInArrow(levels, "stratum string, level int, n_good bigint")


def _level_of(docs: DataFrame, cuts: DataFrame, stratum: Column) -> tuple[DataFrame, Column]:
    known = cuts.select("stratum", "level").limit(LITERAL_STRATA + 1).collect()
    if len(known) <= LITERAL_STRATA:
        pairs = [F.lit(x) for row in known for x in (row[0], row[1])]
        found = F.coalesce(F.create_map(*pairs)[stratum], F.lit(0)) if pairs else F.lit(0)
        return docs, found
    named = cuts.select(F.col("stratum").alias("__stratum"), F.col("level").alias("__level"))
    return docs.join(named, stratum == named["__stratum"], "left"), F.coalesce(named["__level"], F.lit(0))


def decide(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.1) -> DataFrame:
    """One row for each document: ``doc_id, stratum, level, symbols, upper, pipes, repeats, keep``.

    ``keep`` is false where the certified level of the stratum rejects the document.  Null text counts as blank,
    a null stratum as ``''``, a null id has no label; texts are measured whole, of any length, and a measure equal to a
    cutoff doesn't reject; extra columns are ignored and repeated rows stay; empty tables give empty results, and without
    labels all documents are kept.
    """
    cuts = certify(docs, labels, stratum, alpha, delta)
    rows, level = _level_of(scored(docs, stratum), cuts, F.col("stratum"))
    return rows.select("doc_id", "stratum", level.cast("int").alias("level"), *[F.round(r, 9).alias(r) for r in RULES], (F.col("first_level") > level).alias("keep"))


def keep_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.1) -> DataFrame:
    """``docs`` without those that :func:`decide` rejects, all columns unchanged; texts are never shuffled.

    Nulls, empty and long texts, ties, repeated rows, empty tables and other columns: as there.
    """
    cuts = certify(docs, labels, stratum, alpha, delta)
    known = {k: c for k, c in measures(F.col("text")).items() if k in RULES}
    rows, level = _level_of(docs, cuts, F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    # as a variable of a function each measure is computed once, however often the levels name it
    once = F.transform(F.array(F.struct(*[c.alias(k) for k, c in known.items()], _blank(F.col("text")).alias("blank"))), lambda m: _rejections({k: m[k] for k in RULES}, m["blank"]))
    return rows.filter(F.get(once, F.lit(0)) > level).select(*[docs[c] for c in docs.columns])


def _sql() -> str:
    hit = lambda row: " OR ".join(["blank", *[f"{r} > {c}" for r, c in zip(RULES, row)]])
    first = " ".join(f"WHEN {hit(row)} THEN {i + 1}" for i, row in enumerate(LEVELS))
    return rf"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, coalesce(NOT regexp_matches(text, '[^ \t\r\n]'), true) AS blank,
         string_split(coalesce(text, ''), ' ') AS w FROM documents),
m AS (
  SELECT doc_id, stratum, blank,
    len(regexp_extract_all(t, '[*#%&$@^~=+<>{{}}_]'))::DOUBLE / greatest(length(t), 1)::DOUBLE AS symbols,
    len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]'))::DOUBLE / greatest(length(t), 1)::DOUBLE AS upper,
    len(regexp_extract_all(t, '[|]'))::DOUBLE / greatest(len(w), 1)::DOUBLE AS pipes,
    1.0::DOUBLE - len(list_distinct(w))::DOUBLE / greatest(len(w), 1)::DOUBLE AS repeats FROM words),
s AS (SELECT *, CASE {first} ELSE {len(LEVELS) + 1} END AS first_level FROM m),
g AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
good AS (SELECT s.doc_id, s.stratum, min(s.first_level) AS first_level FROM s JOIN g ON g.doc_id = s.doc_id GROUP BY s.doc_id, s.stratum),
cnt AS (SELECT stratum, lvl, count(*) AS n, sum((first_level <= lvl)::INT) AS k FROM good, range(1, {len(LEVELS) + 1}) r(lvl) GROUP BY ALL),
tail AS (SELECT stratum, lvl, list_sum(list_transform(range(0, (k + 1)::BIGINT), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95))))
                               <= 0.1 / (SELECT count(DISTINCT stratum) FROM good) AS ok FROM cnt),
cut AS (SELECT stratum, coalesce(min(lvl) FILTER (NOT ok), {len(LEVELS) + 1}) - 1 AS level FROM tail GROUP BY stratum)
SELECT doc_id, s.stratum, coalesce(level, 0)::INT AS level, round(symbols, 9) AS symbols, round(upper, 9) AS upper, round(pipes, 9) AS pipes,
       round(repeats, 9) AS repeats, first_level > coalesce(level, 0) AS keep
FROM s LEFT JOIN cut ON cut.stratum = s.stratum"""


ORACLE_SQL = _sql()
