"""Word segmentation: best paths through a lattice of dictionary words, character tagging, and their combination.

Decoders work on one sentence; tables of sentences go through them in Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import text as T
from ..scratch import ship
from .blocks import blocked, column, together
from .crf import Crf
from .lexicon import Lexicon, Tables

UNKNOWN_COST = 20.0
OOV_ID, NO_ID = -1, -2
BEGIN_OF_WORD, END_OF_WORD, FILTERED = 1, 2, 3
NO, DO, NEVER = 0, 1, 2

#: Word, number of tokens, word type, id.
Word = tuple[str, int, int, int]


def lattice(tokens: list[str], types: list[int], lexicon: Lexicon, beam: int) -> list[Word]:
    """Cheapest words of a sentence; at each place the ``beam`` cheapest partial paths go on.

    A token that is no word, at whose end no word ends either, is an unknown word.  With ``beam`` 1 and no bigrams the
    path is the cheapest there is.  Of equal costs the longer last word, then the earlier path comes first.
    """
    n = len(tokens)
    at: list[list[tuple]] = [[] for _ in range(n + 1)]  # cost, start, id, node before
    at[0].append((0.0, -1, 0, None))
    index, costs, unigram, bigrams = lexicon.index, lexicon.costs, lexicon.unigram, lexicon.bigrams
    top = 10 * beam
    price = lambda node: node[0]
    for p in range(n):
        nodes = at[p]
        if len(nodes) > beam:
            nodes.sort(key=price)
            del nodes[beam:]
        spelled = ""
        for q in range(p, n):
            spelled = tokens[q] if q == p else spelled + tokens[q]
            term = index.get(spelled)
            if term is not None and term >= 0:
                own = costs[spelled]
                if bigrams is None:
                    best = nodes[0]
                    for node in nodes:
                        if node[0] < best[0]:
                            best = node
                    total = best[0] + own
                else:
                    best, total = None, 1e38
                    for node in nodes:
                        pair = bigrams.get((node[2], term))
                        c = node[0] + (own if pair is None else pair - unigram.get(node[2], 0.0))
                        if c < total:
                            best, total = node, c
                ends = at[q + 1]
                ends.append((total, p, term, best))
                if len(ends) >= top:
                    ends.sort(key=price)
                    del ends[beam:]
            elif q == p and not at[p + 1]:
                best = min(nodes, key=price)
                at[p + 1].append((best[0] + UNKNOWN_COST, p, 0, best))
            if term is None:
                break
    out: list[Word] = []
    node, end = min(at[n], key=price), n
    while node[3] is not None:
        start = node[1]
        kind = T.WORD_CHINESE if end - start > 1 else T.WORD_TYPE[types[start]]
        out.append(("".join(tokens[start:end]), end - start, kind, node[2] or OOV_ID))
        node, end = node[3], start
    return out[::-1]


#: Which position tag may follow which within a sentence.
FOLLOWS = {"S": ("S", "B"), "B": ("B1", "E"), "B1": ("B2", "E"), "B2": ("M", "E"), "M": ("M", "E"), "E": ("S", "B")}


def tagged_words(tokens: list[str], types: list[int], crf: Crf, begin: int = 0, end: int | None = None) -> list[Word]:
    """Words of a range of a sentence from position tags; tokens that aren't Chinese stand alone.

    As places of a single tag part the best path, each run of Chinese tokens is decoded by itself.
    """
    end = len(tokens) if end is None else end
    at = {t: i for i, t in enumerate(crf.tags)}
    single, last = at["S"], at["E"]
    moves = crf.cache.get("moves")
    if moves is None:
        moves = crf.cache["moves"] = np.array([[right in FOLLOWS.get(left, ()) for right in crf.tags] for left in crf.tags])
    places = crf.cache.get("places")
    if places is None or places[0] is not tokens:
        places = crf.cache["places"] = (tokens, [(t,) for t in tokens])
    tags: list[int] = []
    p = begin
    while p < end:
        if types[p] != T.CJK:
            tags.append(single)
            p += 1
            continue
        q = p
        while q < end and types[q] == T.CJK:
            q += 1
        # inside a range the step from the token before is held to the moves: that token is part of the decoding
        from_ = p - 1 if p > begin else p
        to = q + 1 if q < end else q
        allowed = [None] * len(tokens)
        if from_ < p:
            allowed[from_] = [single]
        if to > q:
            allowed[q] = [single]
        found = crf.decode(places[1], from_, to, single if from_ == p else None, single if to == q else None, allowed, moves)
        tags += found[p - from_ : q - from_]
        p = q
    out: list[Word] = []
    start = begin
    for i, tag in enumerate(tags, begin):
        if tag in (single, last):
            out.append(("".join(tokens[start : i + 1]), i + 1 - start, T.WORD_TYPE[types[i]] if tag == single else T.WORD_CHINESE, NO_ID))
            start = i + 1
    if start < end:
        out.append(("".join(tokens[start:end]), end - start, T.WORD_CHINESE, NO_ID))
    return out


def recognition(words: list[Word], properties: dict[str, int]) -> list[int]:
    """For each word whether it may be part of an unknown word: NO, DO or NEVER.

    Only single Chinese characters tell: one without a property does, one that begins or ends words does and says so of
    its neighbour, and a filtered one never does.  What comes later in the sentence overrules, but for NEVER before.
    """
    out = [NO] * len(words)
    for i, (word, size, kind, _) in enumerate(words):
        if size > 1 or kind != T.WORD_CHINESE:
            continue
        own = properties.get(word, -1)
        if own == FILTERED:
            out[i] = NEVER
        elif own < 0 or own in (BEGIN_OF_WORD, END_OF_WORD):
            out[i] = DO
            if own == BEGIN_OF_WORD and i + 1 < len(words):
                out[i + 1] = DO
            if own == END_OF_WORD and i and out[i - 1] != NEVER:
                out[i - 1] = DO
    return out


def mixed_words(tokens: list[str], types: list[int], lexicon: Lexicon, beam: int, crf: Crf, properties: dict[str, int]) -> list[Word]:
    """The lattice's words, of which runs of two or more that may be unknown words are cut again by position tags."""
    words = lattice(tokens, types, lexicon, beam)
    flags = recognition(words, properties)
    if DO not in flags:
        return words
    out: list[Word] = []
    begin = at = 0
    run: list[Word] = []
    for word, flag in [*zip(words, flags), (None, NO)]:
        if flag == DO:
            run.append(word)
        else:
            out += tagged_words(tokens, types, crf, begin, at) if len(run) > 1 else run
            run = []
            if word:
                out.append(word)
                begin = at + word[1]
        at += word[1] if word else 0
    return out


def oov_flags(words: DataFrame, properties: DataFrame, keys: tuple = ("doc_id", "sent_id")) -> DataFrame:
    """``keys, idx, word, flag`` for rows ``keys, idx, word, n_tokens, word_type``: :func:`recognition`, declared.

    ``properties`` is ``word, property``.
    """
    p = properties.select(F.col("word"), F.col("property"))
    lone = (F.col("n_tokens") == 1) & (F.col("word_type") == T.WORD_CHINESE)
    found = words.join(p, "word", "left").withColumn("__p", F.when(lone, F.coalesce("property", F.lit(-1))))
    w = W.partitionBy(*keys).orderBy("idx")
    before, behind = F.lag("__p").over(w), F.lead("__p").over(w)
    own = F.col("__p")
    flag = (
        F.when((own == FILTERED), NEVER).when(own.isNotNull() & ((own < 0) | own.isin(BEGIN_OF_WORD, END_OF_WORD)), DO)
        .when((before == BEGIN_OF_WORD) | (behind == END_OF_WORD), DO).otherwise(NO)
    )
    return found.select(*keys, "idx", "word", flag.alias("flag"))


def oov_runs(flags: DataFrame, keys: tuple = ("doc_id", "sent_id")) -> DataFrame:
    """``keys, first_idx, n_words, run``: maximal runs of words flagged DO, by gaps and islands."""
    w = W.partitionBy(*keys).orderBy("idx")
    island = F.col("idx") - F.row_number().over(w)
    do = flags.filter(F.col("flag") == DO).withColumn("__i", island)
    grouped = do.groupBy(*keys, "__i").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n_words"), F.array_sort(F.collect_list(F.struct("idx", "word"))).alias("w"))
    return grouped.select(*keys, "first_idx", "n_words", F.array_join("w.word", "").alias("run"))


WORDS = "array<struct<word:string,n_tokens:int,word_type:int,term_id:bigint>>"
_WORDS = pa.list_(pa.struct([("word", pa.string()), ("n_tokens", pa.int32()), ("word_type", pa.int32()), ("term_id", pa.int64())]))


def split_sentences(column: pa.ListArray) -> Iterator[tuple[list[str], list[int]]]:
    """Tokens and types of each sentence of an Arrow column of arrays of ``token, type``."""
    flat = column.flatten()
    tokens, types = flat.field(0).to_pylist(), flat.field(1).to_pylist()
    ends = np.cumsum([0, *(len(x) if x.is_valid else 0 for x in column)]).tolist()
    for a, b in zip(ends, ends[1:]):
        yield tokens[a:b], types[a:b]


def per_sentence(sents: DataFrame, decode, name: str, kind: str, arrow: pa.DataType, column: str = "tokens", split=split_sentences, build=pa.array) -> DataFrame:
    """``sents`` with ``column`` replaced by ``name``: what ``decode(*split(...))`` gives for each sentence.

    ``decode`` is a broadcast variable's factory: called once in a task, it gives the function for one sentence.
    ``build`` makes the Arrow array of what it gives.
    """
    kept = [c for c in sents.columns if c != column]
    narrow = sents.select(*kept, column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    schema = f"{schema}, `{name}` {kind}" if schema else f"`{name}` {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = decode()
        for batch in batches:
            done = build([one(*s) for s in split(batch.column(len(kept)))], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], done], names=[*kept, name])

    return narrow.mapInArrow(run, schema)


def words_array(done: list[list[Word]], arrow: pa.DataType = _WORDS) -> pa.ListArray:
    """Words of each sentence as an Arrow array."""
    ends = np.cumsum([0, *map(len, done)])
    columns = zip(*[w for words in done for w in words]) if ends[-1] else ((),) * 4
    kinds = list(arrow.value_type)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], fields=kinds))


def _decoder(method: str, lexicon: Lexicon | None, crf: Crf | None, properties: dict):
    """The function from tokens and types of a sentence to its words."""
    if method == "unigram":
        plain = Lexicon(lexicon.index, lexicon.costs, lexicon.unigram, None)
        return lambda tokens, types: lattice(tokens, types, plain, 1)
    if method == "bigram":
        return lambda tokens, types: lattice(tokens, types, lexicon, 3)
    if method == "crf":
        return lambda tokens, types: tagged_words(tokens, types, crf)
    return lambda tokens, types: mixed_words(tokens, types, lexicon, 3, crf, properties)


def segment(sents: DataFrame, method: str, lexicon: Lexicon | Tables | None = None, crf: Crf | None = None, properties: dict[str, int] | None = None) -> DataFrame:
    """``sents`` with ``words`` instead of ``tokens``.  ``method``: unigram, bigram, crf or mixed.

    Models are broadcast once; what builds them checks their size.  A lexicon of tables is joined instead.  An empty
    sentence has no words.
    """
    need = {"unigram": (lexicon,), "bigram": (lexicon,), "crf": (crf,), "mixed": (lexicon, crf)}
    if method not in need or any(m is None for m in need[method]):
        raise ValueError(f"no models for the segmenter {method!r}" if method in need else f"no segmenter {method!r}")
    if isinstance(lexicon, Tables) and sents.isStreaming and method != "crf":
        lexicon = lexicon.whole()
    if isinstance(lexicon, Tables) and method != "crf":
        return _joined(sents, method, lexicon, crf, properties or {})
    shared = ship(sents.sparkSession, (lexicon if method != "crf" else None, crf, properties or {}))
    return per_sentence(sents, lambda: _decoder(method, *shared()), "words", WORDS, _WORDS, build=words_array)


def _joined(sents: DataFrame, method: str, tables: Tables, crf: Crf | None, properties: dict) -> DataFrame:
    """:func:`segment` with the words and bigrams of each block of sentences brought to it by joins."""
    shared = ship(sents.sparkSession, (crf, properties))
    kept = [c for c in sents.columns if c != "tokens"]
    held = blocked(sents.select(*kept, "tokens"), "sentences")
    if method == "unigram":
        tables = Tables(tables.words, None)
    schema = StructType([*held.select(*kept).schema.fields, *_parse_datatype_string(f"words {WORDS}").fields])

    def run(block: pa.Table, rows: pa.Table) -> pa.Table:
        tagger, props = shared()
        at = rows.column("word").is_valid()
        told = [rows.filter(at).column(c).to_pylist() for c in ("word", "term_id", "cost", "own")]
        near = [rows.filter(rows.column("word").is_null()).column(c).to_pylist() for c in ("left_id", "right_id", "cost")]
        one = _decoder(method, Lexicon.of_block(list(zip(*told)), list(zip(*near)) if method != "unigram" else None), tagger, props)
        done = words_array([one(*s) for s in split_sentences(column(block, "tokens"))])
        return pa.table([*[block.column(c) for c in kept], done], names=[*kept, "words"])

    return together(held, tables.local(held), run, schema)


def exploded(segmented: DataFrame, keys: tuple = ("doc_id", "sent_id")) -> DataFrame:
    """``keys, idx, word, n_tokens, word_type, term_id``: a row for each word."""
    return segmented.select(*keys, F.posexplode("words").alias("idx", "w")).select(*keys, "idx", "w.*")


def plain_words() -> Column:
    """Each token of ``tokens`` as a word of its own, for pipelines that start from tokens."""
    return F.transform("tokens", lambda t: F.struct(t["token"].alias("word"), F.lit(1).alias("n_tokens"), T.word_type(t["type"]).alias("word_type"), F.lit(NO_ID).cast("bigint").alias("term_id")))
