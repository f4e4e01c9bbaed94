"""Part-of-speech tagging: hidden Markov model, CRF, and CRF over the tags that the Markov model has seen."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import text as T
from ..scratch import BROADCAST_ROWS, MODEL_ROWS, ModelTooLarge, discard, gather, materialize, ship
from .blocks import blocked, column, together
from .crf import Crf, sentence_features
from .segment import per_sentence

BOS = "-BOS-"
BEAM = 3
#: A word seen so often is held to the tags it was seen with.
TRUSTED_COUNT = 5


def emissions(corpus: DataFrame) -> DataFrame:
    """``word, tag, cost, total_count`` from rows ``word, tag``: cost is -ln of the tag's share of the word."""
    return emissions_of(corpus.groupBy("word", "tag").agg(F.count("*").alias("n")))


def emissions_of(counts: DataFrame) -> DataFrame:
    """:func:`emissions` from ``word, tag, n``, a row for each word and tag."""
    total = F.sum("n").over(W.partitionBy("word"))
    return counts.withColumn("total_count", total).select("word", "tag", T.cost(F.col("n").cast("double") / F.col("total_count").cast("double")).alias("cost"), "total_count")


def transitions(corpus: DataFrame, keys: tuple = ("doc_id", "sent_id")) -> DataFrame:
    """``left, right, cost`` for all pairs of tags, the sentence mark included, from rows ``keys, idx, tag``.

    cost = -ln((1 + c(left, right)) / (tags + c(left))); each sentence begins and ends with the mark.  Sentences are
    gathered into arrays first, so there is one shuffle of narrow rows.
    """
    sents = corpus.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "tag"))).alias("s"))
    return transitions_of(sents.select(F.col("s.tag").alias("tags")))


def transitions_of(sents: DataFrame) -> DataFrame:
    """:func:`transitions` from an array ``tags`` for each sentence; nothing but counts is shuffled."""
    bos = F.array(F.lit(BOS))
    pairs = sents.filter(F.size("tags") > 0).select(F.explode(F.arrays_zip(F.concat(bos, "tags").alias("left"), F.concat("tags", bos).alias("right"))).alias("p"))
    return transitions_from(pairs.select("p.left", "p.right").groupBy("left", "right").agg(F.count("*").alias("n")))


def transitions_from(pairs: DataFrame) -> DataFrame:
    """:func:`transitions` from ``left, right, n``, a row for each pair."""
    # written once, all else is derived from it
    counts = materialize(pairs, "pairs")
    ends = counts.groupBy("left").agg(F.sum("n").alias("of"))
    size = ends.agg(F.count("*").cast("double").alias("y"))
    grid = ends.crossJoin(F.broadcast(ends.select(F.col("left").alias("right")))).crossJoin(F.broadcast(size))  # tag sets are small
    found = grid.join(counts, ["left", "right"], "left")
    return found.select("left", "right", T.cost((F.coalesce("n", F.lit(0)) + 1).cast("double") / (F.col("y") + F.col("of"))).alias("cost"))


@dataclass(frozen=True)
class Hmm:
    emission: dict  # word: (total count, [(tag, cost)])
    transition: dict  # (left, right): cost

    @staticmethod
    def seen(emission: list[tuple]) -> dict[str, tuple[int, list]]:
        """Total count, and tags in byte order with their costs, by word."""
        words: dict[str, tuple[int, list]] = {}
        for word, tag, cost, total in emission:
            words.setdefault(word, (int(total), []))[1].append((tag, float(cost)))
        for _, tags in words.values():
            tags.sort(key=lambda r: r[0].encode())
        return words

    @classmethod
    def build(cls, emission: list[tuple], transition: list[tuple]) -> Hmm:
        out = cls(cls.seen(emission), {(a, b): float(c) for a, b, c in transition})
        known = {a for a, _ in out.transition}
        for tag in ("PU", "NN", "CD", BOS):
            if tag not in known:
                raise ValueError(f"the Markov model lacks the tag {tag}")
        return out

    @classmethod
    def load(cls, emission: DataFrame, transition: DataFrame, most: int = MODEL_ROWS) -> Hmm:
        return cls.build(gather(emission.select("word", "tag", "cost", "total_count"), most), gather(transition.select("left", "right", "cost")))

    def open_tags(self, word: str, kind: int) -> list[tuple[str, float]]:
        own = self.emission.get(word)
        if own:
            return own[1]
        return [("PU" if kind in (T.WORD_PUNCTUATION, T.WORD_SYMBOL, T.WORD_OTHER) else "CD" if kind == T.WORD_NUMBER else "NN", 0.0)]

    def decode(self, words: list[str], kinds: list[int]) -> list[str]:
        """Tags of a sentence: the cheapest path, with the BEAM cheapest tags kept at each word; earlier tags win ties."""
        nodes: list[tuple] = [(0.0, BOS, None)]
        move = self.transition
        for word, kind in zip(words, kinds):
            if len(nodes) > BEAM:
                nodes = sorted(nodes, key=lambda n: n[0])[:BEAM]
            following = []
            for tag, cost in self.open_tags(word, kind):
                best, least = None, 1e38
                for node in nodes:
                    c = node[0] + move[node[1], tag] + cost
                    if c < least:
                        best, least = node, c
                following.append((least, tag, best))
            nodes = following
        nodes = sorted(nodes, key=lambda n: n[0])[:BEAM]
        node = min(nodes, key=lambda n: n[0] + move[n[1], BOS])
        out = []
        while node[2] is not None:
            out.append(node[1])
            node = node[2]
        return out[::-1]


@dataclass(frozen=True)
class HmmTables:
    """A Markov model of any number of words: ``emission`` is a table, joined to each sentence, ``rest`` has the transitions."""

    emission: DataFrame
    rest: Hmm


def load_hmm(emission: DataFrame, transition: DataFrame) -> Hmm | HmmTables:
    """Dictionaries where a count shows the words to be few enough to be broadcast, otherwise tables; results are the same."""
    try:
        return Hmm.load(emission, transition, BROADCAST_ROWS)
    except ModelTooLarge:
        return HmmTables(emission.select("word", "tag", "cost", "total_count"), Hmm.build([], gather(transition.select("left", "right", "cost"))))


def surface(word: str, kind: int) -> tuple:
    """The four features of :func:`..functions.text.surface_features`."""
    if kind == T.WORD_CHINESE:
        return word, word[:1], word[-1:], str(len(word.encode()) // 3)
    return ("A", "A", "A", "1") if kind in (T.WORD_ENGLISH, T.WORD_SYMBOL) else ("1",) * 4 if kind == T.WORD_NUMBER else (".", ".", ".", "1")


def crf_tags(words: list[str], kinds: list[int], crf: Crf, hmm: Hmm | None = None) -> list[str]:
    """Tags of a sentence by CRF; with a Markov model only tags seen with a well-known word are open to it."""
    if not words:
        return []
    allowed = None
    if hmm is not None:
        at = crf.cache.get("tags")
        if at is None:
            at = crf.cache["tags"] = {t: i for i, t in enumerate(crf.tags)}
        allowed = []
        for word, kind in zip(words, kinds):
            own = hmm.emission.get(word)
            if own and own[0] >= TRUSTED_COUNT:
                allowed.append([at[t] for t, _ in own[1]])
            else:
                allowed.append([at["PU"]] if kind in (T.WORD_PUNCTUATION, T.WORD_OTHER) else None)
    return [crf.tags[y] for y in crf.decode([surface(w, k) for w, k in zip(words, kinds)], 0, len(words), allowed=allowed)]


def split_words(column: pa.ListArray) -> Iterator[tuple[list[str], list[int]]]:
    """Words and word types of each sentence of an Arrow column of arrays of ``word, n_tokens, word_type, term_id``."""
    flat = column.flatten()
    words, kinds = flat.field("word").to_pylist(), flat.field("word_type").to_pylist()
    ends = np.cumsum([0, *(len(x) if x.is_valid else 0 for x in column)]).tolist()
    for a, b in zip(ends, ends[1:]):
        yield words[a:b], kinds[a:b]


def tag(segmented: DataFrame, method: str, hmm: Hmm | HmmTables | None = None, crf: Crf | None = None) -> DataFrame:
    """``segmented`` with an array ``tags`` next to ``words``.  ``method``: hmm, crf, mixed or none."""
    if method == "none":
        return segmented.withColumn("tags", F.transform("words", lambda w: F.lit("none")))
    need = {"hmm": (hmm,), "crf": (crf,), "mixed": (crf, hmm)}
    if method not in need or any(m is None for m in need[method]):
        raise ValueError(f"no models for the tagger {method!r}" if method in need else f"no tagger {method!r}")
    if crf is not None and method != "hmm" and "PU" not in crf.tags:
        raise ValueError("the tag model lacks the tag PU")
    def one(markov, tagger):
        if method == "hmm":
            return markov.decode
        return lambda words, kinds: crf_tags(words, kinds, tagger, markov if method == "mixed" else None)

    if isinstance(hmm, HmmTables) and segmented.isStreaming and method != "crf":
        hmm = Hmm(Hmm.seen(gather(hmm.emission)), hmm.rest.transition)
    if isinstance(hmm, HmmTables) and method != "crf":
        return _joined(segmented, one, hmm, crf)
    shared = ship(segmented.sparkSession, (hmm if method != "crf" else None, crf))
    return _decoded(segmented, one, shared)


def _decoded(segmented: DataFrame, one, shared) -> DataFrame:
    doubled = segmented.withColumn("__w", F.col("words"))
    return per_sentence(doubled, lambda: one(*shared()), "tags", "array<string>", pa.list_(pa.string()), "__w", split_words)


def _joined(segmented: DataFrame, one, tables: HmmTables, crf: Crf | None) -> DataFrame:
    """:func:`tag` with what the model knows of the words that there are: broadcast where they are few, else joined to blocks of sentences."""
    held = blocked(segmented, "words")
    each = held.select("__block", F.explode(F.array_distinct("words.word")).alias("word")).distinct()
    known = materialize(each.select("word").distinct().join(tables.emission, "word").select("word", "tag", "cost", "total_count"), "seen")
    try:
        few = Hmm(Hmm.seen(gather(known, BROADCAST_ROWS)), tables.rest.transition)
    except ModelTooLarge:
        pass
    else:
        discard(known)
        return _decoded(held.drop("__block"), one, ship(segmented.sparkSession, (few, crf)))
    shared = ship(segmented.sparkSession, (tables.rest, crf))
    kept = segmented.columns
    schema = StructType([*held.drop("__block").schema.fields, *_parse_datatype_string("tags array<string>").fields])

    def run(block: pa.Table, rows: pa.Table) -> pa.Table:
        rest, tagger = shared()
        seen = Hmm.seen(list(zip(*[rows.column(c).to_pylist() for c in ("word", "tag", "cost", "total_count")])))
        tags = one(Hmm(seen, rest.transition), tagger)
        done = pa.array([tags(*s) for s in split_words(column(block, "words"))], pa.list_(pa.string()))
        return pa.table([*[block.column(c) for c in kept], done], names=[*kept, "tags"])

    return together(held, each.join(known, "word"), run, schema)


def crf_weights(corpus: DataFrame, templates: tuple, keys: tuple, places: str, tags: str) -> DataFrame:
    """``feature, left, right, weight`` of a CRF set from counts: log of the smoothed share of each tag.

    ``corpus`` has for each sentence an array of feature arrays ``places`` and an array ``tags``.  One pass for unigram
    features, one for pairs of tags; only counts are shuffled.
    """
    unigram = [t for t in templates if t.startswith("u")]
    each = corpus.filter(F.size(tags) > 0).select(F.explode(F.arrays_zip(sentence_features(F.col(places), unigram).alias("f"), F.col(tags).alias("right"))).alias("z"))
    rows = each.select(F.explode("z.f").alias("feature"), "z.right")
    seen = rows.groupBy("feature", "right").agg(F.count("*").alias("n"))
    if not any(t.startswith("b") for t in templates):
        return weights_of(seen)
    pairs = corpus.filter(F.size(tags) > 1).select(F.explode(F.arrays_zip(F.slice(tags, F.lit(1), F.size(tags) - 1).alias("left"), F.slice(tags, F.lit(2), F.size(tags) - 1).alias("right"))).alias("p")).select("p.left", "p.right")
    return weights_of(seen, pairs.groupBy("left", "right").agg(F.count("*").alias("n")))


def weights_of(seen: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """:func:`crf_weights` from ``feature, right, n`` and, where pairs of tags have weights, ``left, right, n``."""
    weight = lambda n, of: F.round(F.log((n + 1).cast("double") / (of + 20).cast("double")), 6)
    one = seen.withColumn("of", F.sum("n").over(W.partitionBy("feature"))).select("feature", F.lit(None).cast("string").alias("left"), "right", weight(F.col("n"), F.col("of")).alias("weight"))
    if pairs is None:
        return one
    counts = pairs.withColumn("of", F.sum("n").over(W.partitionBy("left")))
    return one.unionByName(counts.select(F.lit("b").alias("feature"), "left", "right", weight(F.col("n"), F.col("of")).alias("weight")))


def accuracy(pairs: DataFrame, by: tuple = ()) -> DataFrame:
    """``correct, total, accuracy`` of rows ``gold, predicted``."""
    return accuracy_of(pairs.withColumn("n", F.lit(1).cast("bigint")), by)


def accuracy_of(counts: DataFrame, by: tuple = ()) -> DataFrame:
    """:func:`accuracy` from ``gold, predicted, n``: ``n`` rows of a kind."""
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n"))
    out = counts.groupBy(*by).agg(F.coalesce(F.sum(hit), F.lit(0)).alias("correct"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return out.withColumn("accuracy", F.round(F.try_divide(F.col("correct").cast("double"), F.col("total").cast("double")), 9))


def corpus_words(corpus: DataFrame, keys: tuple = ("line_no",)) -> DataFrame:
    """``keys, words, gold`` of rows ``keys, idx, word, tag``: words as a segmenter gives them, and their tags."""
    lexed = T.lex(F.col("word"))
    kind = F.when(F.size(lexed) > 1, F.lit(T.WORD_CHINESE)).otherwise(T.word_type(T.token_type(F.col("word"))))
    word = F.struct("word", F.greatest(F.size(lexed), F.lit(1)).alias("n_tokens"), kind.alias("word_type"), F.lit(None).cast("bigint").alias("term_id"))
    rows = corpus.select(*keys, F.struct("idx", word.alias("w"), "tag").alias("s")).groupBy(*keys).agg(F.array_sort(F.transform(F.collect_list("s"), lambda s: F.struct(s["idx"].alias("idx"), s["w"].alias("w"), s["tag"].alias("tag")))).alias("s"))
    return rows.select(*keys, F.col("s.w").alias("words"), F.col("s.tag").alias("gold"))


def evaluate(corpus: DataFrame, method: str, hmm: Hmm | None = None, crf: Crf | None = None, keys: tuple = ("line_no",)) -> DataFrame:
    """``correct, total, accuracy`` of a tagger on a tagged corpus ``keys, idx, word, tag``, its words taken as they are."""
    done = tag(corpus_words(corpus, keys), method, hmm, crf)
    return accuracy(done.select(F.explode(F.arrays_zip(F.col("gold").alias("gold"), F.col("tags").alias("predicted"))).alias("p")).select("p.*"))
