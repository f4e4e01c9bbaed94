"""Mixing sources to target weights that change during training.

Each source has a weight at every knot of training time ``t`` in [0, 1]; between knots weights run linearly.  At a
knot the share of a source is its weight over the sum of all; shares stay normalised between knots.  Integrated
over time and multiplied by the token budget, the share gives the cumulative demand ``D(t)`` of a source.  Its
documents, in the keyed order of their ids' MD5, supply it: the document whose tokens run from ``c`` to ``c + n``
meets the demand at ``D(t) = c + n / 2``, so ``t``, the inverse, is its training position.  A demand beyond the
supply starts the source over (``copy`` 1, 2, ...); a supply beyond the demand leaves documents out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SQL_N_TOKENS, materialize, n_tokens, small_side

KNOTS = (0.0, 0.5, 1.0)
#: Multipliers at the knots by source; the base weight of a source is its tokens to the power of ALPHA.
TILTS = {"src0": (1.3, 1.0, 0.7), "src1": (0.5, 1.0, 2.0), "src2": (2.0, 1.0, 0.5)}
DEFAULT_TILT = (1.0, 1.0, 1.0)
ALPHA = 0.7
#: Rows of one prefix-sum bucket, about.
BUCKET_DOCS = 65_536


def _tilt(source: Column, k: int, tilts: dict, default: tuple) -> Column:
    out = F.lit(float(default[k]))
    for name, row in tilts.items():
        out = F.when(source == F.lit(name), F.lit(float(row[k]))).otherwise(out)
    return out


def targets(supply: DataFrame, knots: tuple = KNOTS, tilts: dict | None = None, default: tuple = DEFAULT_TILT, alpha: float = ALPHA, budget: float | None = None) -> DataFrame:
    """``__source, supply, budget``, shares ``s0..`` at the knots and cumulative demand ``d0..`` there, by source.

    ``supply`` has ``__source, supply``.  ``budget`` is the number of training tokens, by default all tokens there are.
    """
    tilts = TILTS if tilts is None else tilts
    if knots[0] != 0 or knots[-1] != 1 or any(b <= a for a, b in zip(knots, knots[1:])):
        raise ValueError("knots must rise from 0 to 1")
    w = supply.select("__source", "supply", *[(F.pow(F.col("supply").cast("double"), F.lit(alpha)) * _tilt(F.col("__source"), k, tilts, default)).alias(f"w{k}") for k in range(len(knots))])
    total = w.agg(F.sum("supply").cast("double").alias("tokens"), *[F.sum(f"w{k}").alias(f"t{k}") for k in range(len(knots))])
    out = w.crossJoin(F.broadcast(total))  # one row
    out = out.select("__source", "supply", (F.lit(float(budget)) if budget is not None else F.col("tokens")).alias("budget"), *[F.try_divide(f"w{k}", f"t{k}").alias(f"s{k}") for k in range(len(knots))])
    out = out.withColumn("d0", F.lit(0.0))
    for k in range(1, len(knots)):
        out = out.withColumn(f"d{k}", F.col(f"d{k - 1}") + F.col("budget") * F.lit((knots[k] - knots[k - 1]) / 2) * (F.col(f"s{k - 1}") + F.col(f"s{k}")))
    return out


def _invert(x: Column, knots: tuple) -> Column:
    """Position at which the demand of the row's source reaches ``x``; the stable root of the quadratic."""
    out = F.lit(None).cast("double")
    for k in range(len(knots) - 2, -1, -1):
        h = F.lit(knots[k + 1] - knots[k])
        a, b = F.col(f"s{k}"), F.col(f"s{k + 1}")
        y = (x - F.col(f"d{k}")) / F.col("budget")
        root = F.sqrt(F.greatest(a * a + F.lit(2.0) * (b - a) * y / h, F.lit(0.0)))
        t = F.lit(knots[k]) + F.when(y <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * y / (a + root))
        out = t if k == len(knots) - 2 else F.when(x < F.col(f"d{k + 1}"), t).otherwise(out)
    return F.least(out, F.lit(1.0))


def assign(docs: DataFrame, knots: tuple = KNOTS, tilts: dict | None = None, default: tuple = DEFAULT_TILT, alpha: float = ALPHA, budget: float | None = None, keep: tuple = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` (with ``source``, as it is), then ``source, copy, n_tokens, position``: a row for each training position of each document.

    A null source counts as ``''``, a null id as ``''`` in the order, null text as 0 tokens; a document of 0 tokens
    takes a position where its turn comes; a source without tokens gets none.  Repeated rows take positions each.
    Very long texts count with all their tokens, an empty table gives no rows, and extra columns don't matter, whatever
    their names.  The running token sum is exact and two-level: sums of the buckets of each source
    (a prefix of the MD5) first, then within a bucket, so no task holds a whole source.
    """
    bits, count = 0, docs.count()
    while count > BUCKET_DOCS * 16**bits and bits < 6:
        bits += 1
    taken = [c for c in keep if c != "source"]
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(*[F.col(c).alias(f"__k_{c}") for c in taken], F.col("source").alias("__raw"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"), key.alias("__md5"), F.col("doc_id").alias("__id"), n_tokens(F.col("text")).alias("__n"))
    rows = rows.withColumn("__bucket", F.substring("__md5", 1, bits))
    if "__row" not in taken:
        rows = materialize(rows, "lengths")  # narrow: tokens are counted once, and the sort at the end can sample what's there
    sums = materialize(rows.groupBy("__source", "__bucket").agg(F.sum("__n").alias("sum")), "sums")
    ahead = W.partitionBy("__source").orderBy("__bucket")
    sums = sums.withColumn("ahead", F.coalesce(F.sum("sum").over(ahead.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("supply", F.sum("sum").over(W.partitionBy("__source")))
    want = targets(sums.groupBy("__source").agg(F.max("supply").alias("supply")), knots, tilts, default, alpha, budget)
    offsets = materialize(sums.select("__source", "__bucket", "ahead").join(want, "__source"), "offsets")
    inside = W.partitionBy("__source", "__bucket").orderBy("__md5", "__id", "__n").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("__c", F.sum("__n").over(inside))
    placed = placed.join(small_side(offsets), ["__source", "__bucket"])
    mid = (F.col("ahead") + F.col("__c")).cast("double") - F.col("__n").cast("double") / F.lit(2.0)
    demand = F.col(f"d{len(knots) - 1}")
    copies = F.coalesce(F.ceil(F.try_divide(demand - mid, F.col("supply").cast("double"))), F.lit(0))
    placed = placed.withColumn("__mid", mid).filter(copies > 0)
    placed = placed.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), (copies - 1).cast("bigint"))))
    x = F.col("__mid") + F.col("__copy").cast("double") * F.col("supply").cast("double")
    return placed.select(*[F.col(f"__k_{c}").alias(c) for c in taken], F.col("__raw" if "source" in keep else "__source").alias("source"), F.col("__copy").alias("copy"), F.col("__n").alias("n_tokens"), F.round(_invert(x, knots), 9).alias("position"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """:func:`assign`, range-sorted by position, then id and copy.  Texts are read once, and never shuffled."""
    return assign(docs, **how).orderBy("position", "doc_id", "copy")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents with all their columns, in training order; a document of several copies is several rows.

    Nulls, empty and long texts, ties, repeated rows, empty tables and other columns: see :func:`assign`.  Written as it
    comes, the table keeps the order: by number of the file, then by row (:func:`.packing.stored_order`).
    """
    whole = docs.select("doc_id", "source", "text", F.struct("*").alias("__row"))  # names of other columns can't clash
    return assign(whole, keep=("doc_id", "__row"), **how).orderBy("position", "doc_id", "copy").select("__row.*")


def _sql() -> str:
    weight = "CASE source " + " ".join(f"WHEN '{s}' THEN {{{i}}}" for i, s in enumerate(TILTS)) + " ELSE {default} END"
    cols = ", ".join("pow(supply::DOUBLE, 0.7) * (" + weight.format(*[r[k] for r in TILTS.values()], default=DEFAULT_TILT[k]) + f")::DOUBLE AS w{k}" for k in range(3))
    root = lambda k: f"{KNOTS[k]}::DOUBLE + CASE WHEN x <= d{k} THEN 0 ELSE 2 * ((x - d{k}) / budget) / (s{k} + sqrt(greatest(s{k} * s{k} + 2 * (s{k + 1} - s{k}) * ((x - d{k}) / budget) / 0.5, 0))) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, {SQL_N_TOKENS} AS n, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h, doc_id, n ROWS UNBOUNDED PRECEDING)::DOUBLE - n / 2.0::DOUBLE AS mid FROM d),
s AS (SELECT source, sum(n)::DOUBLE AS supply FROM d GROUP BY source),
w AS (SELECT source, supply, {cols} FROM s),
f AS (SELECT source, supply, sum(supply) OVER () AS budget, w0 / sum(w0) OVER () AS s0, w1 / sum(w1) OVER () AS s1, w2 / sum(w2) OVER () AS s2 FROM w),
g AS (SELECT *, 0::DOUBLE AS d0, budget * 0.25 * (s0 + s1) AS d1, budget * 0.25 * (s0 + s1) + budget * 0.25 * (s1 + s2) AS d2 FROM f),
p AS (SELECT c.doc_id, c.n, c.mid, g.*, unnest(range(0, greatest(0, ceil((d2 - mid) / supply)::BIGINT))) AS copy FROM c JOIN g ON g.source = c.source WHERE supply > 0),
q AS (SELECT *, mid + copy * supply AS x FROM p)
SELECT doc_id, source, copy::BIGINT AS copy, n AS n_tokens, round(least(CASE WHEN x < d1 THEN {root(0)} ELSE {root(1)} END, 1), 9) AS position FROM q"""


ORACLE_SQL = _sql()
