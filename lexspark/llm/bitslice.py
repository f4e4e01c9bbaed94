"""Exact top-k search by inner product over a bit-sliced index.

Attributes (vector dimensions) are quantised to ``BITS`` bits; the index of a block of rows holds, for each attribute
and bit, a bitmap over the rows.  A query's weights are quantised too and written in signed binary digits: a digit
``2**j`` adds the attribute's slices, shifted by ``j``; a digit ``-2**j`` adds their complements.  Carry-save adders
on whole bitmaps sum all of them into the slices of the approximate score of every row at once.  The k best rows are
found from the most significant slice downward.  The quantisation error of a score is bounded by Cauchy-Schwarz, so
every row that could be among the exact k best has an approximate score no less than the k-th by twice the bound; only
those boundary rows are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

BITS, WEIGHT_BITS = 6, 6
#: Numbers of one block of the index, and queries of one task.
BLOCK_VALUES, QUERY_ROWS = 1 << 21, 4_096
K = 10
QUERY_STEP = 50
INDEX = "dims int, block int, ids binary, low double, step double, residual double, norm double, vectors binary, slices binary"


def digits(w: int) -> list[tuple[int, int]]:
    """``sign, exponent`` of the non-adjacent form of ``w``, the signed binary form with the fewest digits."""
    out, j = [], 0
    while w:
        if w & 1:
            s = 2 - (w & 3)
            out.append((s, j))
            w -= s
        w >>= 1
        j += 1
    return out


class Index:
    """Bit slices of a block of vectors, and the vectors, which are kept in single precision."""

    #: What a row of the index table holds, in this order.
    FIELDS = ("dims", "low", "step", "residual", "norm", "vectors", "slices")

    def __init__(self, x: np.ndarray, low: float, step: float, residual: float, norm: float, bits: np.ndarray) -> None:
        self.x, self.rows, self.dims, self.words = x, len(x), x.shape[1], bits.shape[2]
        self.low, self.step, self.residual, self.norm = low, step, residual, norm
        self.slices = np.stack([bits, ~bits])  # polarity, attribute, bit, word
        self.all = np.packbits(np.arange(self.words * 64) < self.rows, bitorder="little").view(np.uint64)

    @classmethod
    def build(cls, x: np.ndarray, low: float, high: float) -> Index:
        x = x.astype(np.float32)
        exact, step = x.astype(float), max((high - low) / (1 << BITS), 1e-12)
        level = np.clip(np.floor((exact - low) / step), 0, (1 << BITS) - 1).astype(np.uint8)
        padded = np.zeros((max(1, -(-len(x) // 64)) * 64, x.shape[1]), np.uint8)
        padded[: len(x)] = level
        bits = np.stack([np.packbits((padded >> i & 1).T.copy(), axis=1, bitorder="little").view(np.uint64) for i in range(BITS)], 1)
        residual = float(np.sqrt(((exact - (low + (level + 0.5) * step)) ** 2).sum(1).max(initial=0)))
        return cls(x, low, step, residual, float(np.sqrt((exact**2).sum(1).max(initial=0))), bits)

    def packed(self) -> tuple:
        return self.dims, self.low, self.step, self.residual, self.norm, self.x.tobytes(), self.slices[0].tobytes()

    @classmethod
    def unpacked(cls, dims: int, low: float, step: float, residual: float, norm: float, vectors: bytes, slices: bytes) -> Index:
        return cls(np.frombuffer(vectors, np.float32).reshape(-1, dims), low, step, residual, norm, np.frombuffer(slices, np.uint64).reshape(dims, BITS, -1))

    def total(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum of weights times levels plus a constant of the query's."""
        columns: dict[int, list[tuple[int, int, int]]] = {}
        for d, w in enumerate(weights.tolist()):
            for sign, j in digits(w):
                for i in range(BITS):
                    columns.setdefault(i + j, []).append((0 if sign > 0 else 1, d, i))
        out: list[np.ndarray] = []
        carried = np.empty((0, self.words), np.uint64)
        p = 0
        while p <= max(columns, default=-1) or len(carried):
            own = columns.get(p)
            stack = np.concatenate([carried, self.slices[tuple(np.array(own).T)]]) if own else carried
            carries = []
            while len(stack) > 2:
                n = len(stack) // 3
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                u = a ^ b
                carries.append((a & b) | (u & c))
                u ^= c
                stack = np.concatenate([u, stack[3 * n :]]) if len(stack) > 3 * n else u
            if len(stack) == 2:
                carries.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            carried = np.concatenate(carries) if carries else np.empty((0, self.words), np.uint64)
            p += 1
        return out

    def candidates(self, q: np.ndarray, k: int, slack: float = 0.0) -> np.ndarray:
        """Row numbers of a superset of the k rows with the largest inner products, all ties within ``slack`` included."""
        gain = float(np.abs(q).max(initial=0)) / ((1 << (WEIGHT_BITS - 1)) - 1)
        if gain == 0 or self.rows <= k:
            return np.arange(self.rows)
        weights = np.rint(q / gain).astype(int)
        slices = self.total(weights)
        sure, tied, need = np.zeros(self.words, np.uint64), self.all, k
        cut = 0  # the k-th largest sum
        for s in reversed(slices):
            ones = tied & s
            n = int(np.bitwise_count(ones).sum())
            cut <<= 1
            if n >= need:
                tied, cut = ones, cut + 1
            else:
                sure, tied, need = sure | ones, tied & ~s, need - n
        rounded = weights * gain
        bound = float(np.linalg.norm(q - rounded)) * self.norm + float(np.linalg.norm(rounded)) * self.residual
        least = cut - int(np.ceil((2 * bound + slack) / (gain * self.step))) - 1
        if least <= 0:
            return np.arange(self.rows)
        over, equal = np.zeros(self.words, np.uint64), self.all
        for i in range(len(slices) - 1, -1, -1):
            if least >> i & 1:
                equal = equal & slices[i]
            else:
                over, equal = over | (equal & slices[i]), equal & ~slices[i]
        if least >> len(slices):
            return np.arange(0)
        return np.flatnonzero(np.unpackbits((over | equal).view(np.uint8), bitorder="little")[: self.rows])


def search(index: Index, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The exact k best rows of a block for each query, the query's own id left out; ties go to lower ids."""
    out = []
    for own, q in zip(query_ids, queries):
        rows = index.candidates(q, k + 1, 2e-6)
        rows = rows[ids[rows] != own]
        score = np.round(index.x[rows].astype(float) @ q, 6) + 0.0
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), own), ids[rows][best], score[best]))
    columns = [np.concatenate(c) if out else [] for c in (zip(*out) if out else ((), (), ()))]
    return pd.DataFrame({"query_id": np.asarray(columns[0], np.int64), "neighbour_id": np.asarray(columns[1], np.int64), "score": np.asarray(columns[2], float)})


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, dims`` of the rows that can be compared, one for each id."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter("vec_id IS NOT NULL AND size(embedding) > 0").filter(~bad).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dims", F.size("embedding"))


def build_index(vectors: DataFrame) -> DataFrame:
    """The bit-sliced index as a table, :data:`INDEX`: a row for each block of vectors of one length.

    Every usable row of ``vectors`` is indexed once, whatever queries come.  A block has about BLOCK_VALUES numbers, so
    its row is some 10 MB, of short and of long vectors alike.
    """
    rows = _usable(vectors)
    seen = rows.groupBy("dims").agg(F.count("*").alias("n"), F.min(F.array_min("embedding")).alias("low"), F.max(F.array_max("embedding")).alias("high"))
    blocks = F.greatest(F.ceil(F.col("n") * F.col("dims") / F.lit(BLOCK_VALUES)), F.lit(1))
    # a row for each length of vectors: few, but joined by hash whatever their number
    placed = rows.join(seen, "dims").withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))

    def block(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("vec_id")
        index = Index.build(np.stack(x["embedding"].to_list()), float(x["low"].iloc[0]), float(x["high"].iloc[0]))
        return pd.DataFrame([(x["block"].iloc[0], x["vec_id"].to_numpy(np.int64).tobytes(), *index.packed())], columns=["block", "ids", *Index.FIELDS])[[c.split()[0] for c in INDEX.split(", ")]]

    return placed.groupBy("dims", "block").applyInPandas(block, INDEX)


def search_index(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, neighbour_id, score``: the exact k best indexed rows of each query vector; see :func:`top_k`.

    Each part of QUERY_ROWS queries meets each block once.  A pair of part and block is a task of bounded memory, and
    sends on only k rows for each query.
    """
    asked = _usable(queries)
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    spread = F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(parts)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    data = index.select("*", each.alias("part"))
    # a query goes to every block of vectors of its length; the numbers of the blocks are a narrow table
    blocks = index.select(F.col("dims").alias("of"), F.col("block").alias("at"))
    sent = asked.select("dims", spread.alias("part"), "vec_id", "embedding").join(blocks, F.col("dims") == F.col("of")).select("dims", F.col("at").alias("block"), "part", "vec_id", "embedding")

    def task(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return search(Index.build(np.zeros((0, 1)), 0, 1), np.empty(0, int), np.empty(0, int), np.empty((0, 1)), k)
        block = Index.unpacked(*(x[c].iloc[0] for c in Index.FIELDS))
        return search(block, np.frombuffer(x["ids"].iloc[0], np.int64), q["vec_id"].to_numpy(), np.stack(q["embedding"].to_list()).astype(float), k)

    keys = ("dims", "block", "part")
    found = data.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(task, "query_id bigint, neighbour_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = K) -> DataFrame:
    """``query_id, rank, neighbour_id, score``: for each row of ``queries`` the k rows of ``vectors`` of the largest inner
    product, its own id left out.  Without ``queries`` every row is one, and the work grows with the square of the rows.

    ``score`` is rounded to 6 decimals, ties go to the lower id, ranks count from 1.  Rows with a null id, or a null,
    empty or not finite vector, are left out; of rows of one id the least vector counts; vectors are compared with
    those of their length only, so there may be fewer than k.  Empty tables give no rows, vectors of any length are
    taken whole, extra columns are ignored.  The index is written to the shared folder.
    """
    index = materialize(build_index(vectors), "index")
    return search_index(index, vectors if queries is None else queries, k)


def stated_queries(vectors: DataFrame) -> DataFrame:
    """The query set of the registered query: every row whose id is divisible by QUERY_STEP, against all rows."""
    return vectors.filter(F.col("vec_id") % QUERY_STEP == 0)


ORACLE_SQL = f"""
WITH e AS (SELECT vec_id, min(embedding)::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, x.vec_id AS neighbour_id, round(list_dot_product(q.v, x.v), 6) + 0.0 AS score
      FROM e q JOIN e x ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id)::INT AS rank FROM p)
SELECT query_id, rank, neighbour_id, score FROM r WHERE rank <= {K}"""
