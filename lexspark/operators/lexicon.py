"""Lexicons: unigram and bigram models from counts, user dictionaries, dictionary lookup and matching."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import BROADCAST_ROWS, MODEL_ROWS, ModelTooLarge, gather, materialize
from .blocks import column, together

USER_ID_START = 0x40000000
DEFAULT_COST = 6.0
#: Least ids of words begin here, 0 is a word that isn't known.
FIRST_ID = 1


def words(text: Column) -> Column:
    """Array of the maximal runs without blanks, tabs and line ends."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\r\n]+"), F.lit(0))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, count`` of the words between white space."""
    return docs.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``left, right, count`` of neighbouring words of a text."""
    rows = docs.select(words(F.col(text)).alias("w")).filter(F.size("w") > 1)
    pairs = rows.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("left"), F.slice("w", F.lit(2), F.size("w") - 1).alias("right"))).alias("p"))
    return pairs.select("p.left", "p.right").groupBy("left", "right").agg(F.count("*").alias("count"))


def rank_by_bytes(df: DataFrame, column: str, name: str, first: int = FIRST_ID) -> DataFrame:
    """``df`` with ids counted from ``first`` in byte order of a column of distinct values.

    Two levels: values that share their first three bytes are numbered by themselves, and the few prefixes carry the
    offset, so no task sorts all values.
    """
    data = F.col(column).cast("binary")
    cut = df.withColumn("__p", F.substring(data, 1, 3))
    ahead = cut.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__ahead", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = cut.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(data)))
    return numbered.join(ahead.select("__p", "__ahead"), "__p").withColumn(name, (F.col("__ahead") + F.col("__r") - 1 + first).cast("bigint")).select(*df.columns, name)


def unigram_model(counts: DataFrame) -> DataFrame:
    """``word, term_id, cost`` from ``word, count``: counts of a word are added up, cost is -ln of its share."""
    # written once: the total, the offsets of the ids and the ids are derived from it
    summed = materialize(counts.groupBy("word").agg(F.sum("count").alias("count")), "counts")
    total = summed.agg(F.sum("count").cast("double").alias("total"))
    shared = summed.crossJoin(F.broadcast(total))  # one row
    return rank_by_bytes(shared, "word", "term_id").select("word", "term_id", T.cost(F.col("count").cast("double") / F.col("total")).alias("cost"))


def bigram_model(pairs: DataFrame, unigrams: DataFrame) -> DataFrame:
    """``left_id, right_id, cost`` from ``left, right, count``; pairs with an unknown word go, after the total is taken."""
    summed = materialize(pairs.groupBy("left", "right").agg(F.sum("count").alias("count")), "pairs")
    total = summed.agg(F.sum("count").cast("double").alias("total"))
    unigrams = materialize(unigrams.select("word", "term_id"), "ids")
    known = lambda side: unigrams.select(F.col("word").alias(side), F.col("term_id").alias(f"{side}_id"))
    found = summed.join(known("left"), "left").join(known("right"), "right").crossJoin(F.broadcast(total))  # one row
    return found.select("left_id", "right_id", T.cost(F.col("count").cast("double") / F.col("total")).alias("cost"))


def user_dictionary(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    """``word, term_id, cost`` from lines ``word[ cost]``, ids by first line.

    White space at the ends goes, blank lines too; the first blank separates; without a cost it is DEFAULT_COST, a cost
    that is no number stops the query.  Of lines with one word the last counts.
    """
    line = T.trim(F.col(value))
    parts = lines.select(F.col(order).alias("at"), line.alias("line")).filter("line <> ''")
    text = F.when(F.instr("line", " ") > 0, F.substring_index("line", " ", 1)).otherwise(F.col("line"))
    rest = F.when(F.instr("line", " ") > 0, T.trim(F.expr("substring(line, instr(line, ' ') + 1)")))
    parts = parts.select("at", text.alias("word"), rest.alias("rest"))
    number = F.col("rest").try_cast("double")
    checked = F.when(F.col("rest").isNull(), F.lit(DEFAULT_COST)).when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("unexpected cost field: "), F.col("rest"))).cast("double"))
    kept = parts.select("word", "at", checked.alias("cost")).groupBy("word").agg(F.max_by("cost", "at").alias("cost"), F.max("at").alias("at"))
    # user dictionaries are written by hand: small enough to be numbered in one task
    return kept.select("word", (F.row_number().over(W.orderBy("at")) - 1 + USER_ID_START).cast("bigint").alias("term_id"), "cost")


def resolve(system: DataFrame, user: DataFrame) -> DataFrame:
    """``word, term_id, cost`` of both dictionaries: the system's id stays, a user's cost counts unless it's the default."""
    u = user.select("word", F.col("term_id").alias("user_id"), F.col("cost").alias("user_cost"))
    both = system.select("word", F.col("term_id").alias("sys_id"), F.col("cost").alias("sys_cost")).join(u, "word", "full_outer")
    own = F.col("sys_id").isNull() | (F.col("user_cost") != DEFAULT_COST)
    return both.select("word", F.coalesce("sys_id", "user_id").alias("term_id"), F.when(F.col("user_id").isNotNull() & own, F.col("user_cost")).otherwise(F.col("sys_cost")).alias("cost"))


def matches(sents: DataFrame, lexicon: DataFrame, keys: tuple = ("doc_id", "sent_id"), extra: tuple = ()) -> DataFrame:
    """``keys, start, n_tokens, word, term_id``, then the columns ``extra`` of the lexicon: all places where tokens spell
    a word of the lexicon, however many tokens it has.  ``sents`` has an array ``tokens``.

    Only equi-joins, so that the lexicon may be of any size.  Single tokens are looked up as they are.  Longer words are
    spelled only where their first two tokens stand, and only as far as the longest word that begins with these goes.
    """
    held = materialize(sents.select(*keys, F.col("tokens.token").alias("t")).withColumn("__sent", F.monotonically_increasing_id()), "sentences")
    wanted = lexicon.select("word", "term_id", *extra)
    one = held.select(*keys, F.posexplode("t").alias("start", "word")).join(wanted, "word")
    lexed = lexicon.select("word", T.lex(F.col("word")).alias("w")).filter(F.size("w") > 1)
    reach = lexed.groupBy(F.concat(F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("pair")).agg(F.max(F.size("w")).alias("longest"))
    pairs = F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda x, y: F.concat(x, y))
    met = held.filter(F.size("t") > 1).select("__sent", F.posexplode(pairs).alias("start", "pair")).join(reach, "pair")
    places = met.groupBy("__sent").agg(F.collect_list(F.struct("start", "longest")).alias("p"))  # at most one for each token of a sentence
    ends = F.flatten(F.transform("p", lambda p: F.transform(F.sequence(F.lit(2), F.least(p["longest"], F.size("t") - p["start"])), lambda n: F.struct(p["start"].alias("start"), n.alias("n_tokens"), F.array_join(F.slice("t", p["start"] + 1, n), "").alias("word")))))
    more = held.join(places, "__sent").select(*keys, F.explode(ends).alias("g")).select(*keys, "g.start", "g.n_tokens", "g.word").join(wanted, "word")
    return one.withColumn("n_tokens", F.lit(1)).select(*keys, "start", "n_tokens", "word", "term_id", *extra).unionByName(more.select(*keys, "start", "n_tokens", "word", "term_id", *extra))


def unknown_tokens(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``token, n`` of tokens that are no word of the lexicon, white space left out."""
    counts = tokens.filter(~F.col("type").isin(T.SPACE, T.CRLF)).groupBy("token").agg(F.count("*").alias("n"))
    return counts.join(lexicon.select(F.col("word").alias("token")), "token", "left_anti")


def prefixes(lexicon: DataFrame, keys: DataFrame, column: str = "prefix") -> DataFrame:
    """``prefix, n_words, is_word``: how many words begin with each of the given prefixes; equi-joins by prefix length."""
    wanted = keys.select(column).distinct()
    lengths = wanted.agg(F.collect_set(F.length(column)).alias("__lengths"))  # one row
    cut = lexicon.select("word").crossJoin(F.broadcast(lengths)).select("word", F.explode("__lengths").alias("n")).filter(F.length("word") >= F.col("n"))
    found = cut.select(F.left("word", F.col("n")).alias(column), F.col("word")).groupBy(column).agg(F.count("*").alias("n_words"), F.max((F.col("word") == F.col(column)).cast("int")).alias("hit"))
    joined = wanted.join(found, column, "left")
    return joined.select(column, F.coalesce("n_words", F.lit(0)).cast("bigint").alias("n_words"), (F.coalesce("hit", F.lit(0)) == 1).alias("is_word"))


@dataclass(frozen=True)
class Lexicon:
    """What the segmenter needs, in plain dictionaries.  ``index`` holds -1 for a beginning of a word that is none."""

    index: dict
    costs: dict
    unigram: dict
    bigrams: dict | None

    @classmethod
    def build(cls, system: list[tuple], user: list[tuple] = (), bigrams: list[tuple] | None = None) -> Lexicon:
        """From rows ``word, term_id, cost`` and ``left_id, right_id, cost``."""
        index: dict[str, int] = {}
        costs: dict[str, float] = {}
        for word, term, price in system:
            index[word], costs[word] = int(term), float(price)
        for word, term, price in user:
            if word not in costs:
                index[word], costs[word] = int(term), float(price)
            elif price != DEFAULT_COST:
                costs[word] = float(price)
        for word in list(costs):
            head = ""
            for token in T.py_lex(word)[:-1]:
                head += token
                index.setdefault(head, -1)
        pairs = None if bigrams is None else {(int(a), int(b)): float(c) for a, b, c in bigrams}
        return cls(index, costs, {int(term): float(price) for _, term, price in system}, pairs)

    @classmethod
    def load(cls, system: DataFrame, user: DataFrame | None = None, bigrams: DataFrame | None = None, most: int = MODEL_ROWS) -> Lexicon:
        """From tables, whose sizes are checked (:func:`..scratch.gather`)."""
        three = ("word", "term_id", "cost")
        pairs = gather(bigrams.select("left_id", "right_id", "cost"), most) if bigrams is not None else None
        return cls.build(gather(system.select(*three), most), gather(user.select(*three), most) if user is not None else (), pairs)

    @classmethod
    def of_block(cls, rows: list[tuple], pairs: list[tuple] | None) -> Lexicon:
        """From rows ``word, term_id, cost, own`` of :class:`Tables` and ``left_id, right_id, cost``."""
        index, costs, unigram = {}, {}, {}
        for word, term, price, own in rows:
            index[word], costs[word] = term, price
            if own is not None:
                unigram[term] = own
        for word in list(costs):
            head = ""
            for token in T.py_lex(word)[:-1]:
                head += token
                index.setdefault(head, -1)
        return cls(index, costs, unigram, None if pairs is None else {(a, b): c for a, b, c in pairs})

    def edges(self, tokens: list[str]) -> Iterator[tuple[int, int, int]]:
        """Start, end and id of all words that tokens spell."""
        index = self.index
        for p in range(len(tokens)):
            spelled = ""
            for q in range(p, len(tokens)):
                spelled += tokens[q]
                term = index.get(spelled)
                if term is None:
                    break
                if term >= 0:
                    yield p, q + 1, term


def block_tokens(sents: pa.Table) -> Iterator[list[str]]:
    """Tokens of each sentence of a table with a column ``t`` of arrays."""
    held = column(sents, "t")
    flat, ends = held.flatten().to_pylist(), [0]
    for x in held.value_lengths().to_pylist():
        ends.append(ends[-1] + (x or 0))
    for a, b in zip(ends, ends[1:]):
        yield flat[a:b]


def _block_rows(block: int, columns: dict) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({"__block": pa.array([block] * n, pa.int64())} | columns)


@dataclass(frozen=True)
class Tables:
    """What the segmenter needs, as tables of any size: for each sentence only what it holds is brought to it.

    ``words`` is ``word, term_id, cost, own`` (``own``: the cost that the system dictionary alone gives, null for words
    of the user), ``bigrams`` is ``left_id, right_id, cost``.
    """

    words: DataFrame
    bigrams: DataFrame | None

    @classmethod
    def of(cls, system: DataFrame, user: DataFrame | None = None, bigrams: DataFrame | None = None) -> Tables:
        own = system.select(F.col("word").alias("__w"), F.col("cost").alias("own"))
        words = system.select("word", "term_id", "cost") if user is None else resolve(system, user)
        return cls(words.join(own, F.col("word") == F.col("__w"), "left").select("word", "term_id", "cost", "own"), bigrams)

    def whole(self) -> Lexicon:
        """As dictionaries, for streams, which can't be joined to what they hold; more than MODEL_ROWS are an error."""
        rows = gather(self.words.select("word", "term_id", "cost", "own"), MODEL_ROWS)
        return Lexicon.of_block(rows, gather(self.bigrams.select("left_id", "right_id", "cost"), MODEL_ROWS) if self.bigrams is not None else None)

    def local(self, held: DataFrame) -> DataFrame:
        """``__block, word, term_id, cost, own, left_id, right_id``: the words, then the bigrams that the blocks of ``held`` may use.

        ``held`` has ``__block`` and ``tokens``.  Words of several tokens are spelled only where their first two tokens
        stand, and only as far as the longest word that begins with these goes.  Only equi-joins, so that the lexicon may
        be of any size; a word or pair of a block counts once in it.
        """
        sents = held.select("__block", F.col("tokens.token").alias("t"))
        lexed = self.words.select("word", T.lex(F.col("word")).alias("w")).filter(F.size("w") > 1)
        reach = materialize(lexed.groupBy(F.concat(F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("pair")).agg(F.max(F.size("w")).alias("longest")), "reach")
        spaced = bool(reach.filter(F.col("pair").rlike("[ \\t\\r\\n]")).take(1))
        blank = frozenset() if spaced else frozenset(" \t\r\n")

        def first_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: dict[int, set] = {}
                for block, t in zip(batch.column(0).to_pylist(), block_tokens(pa.Table.from_batches([batch]))):
                    found.setdefault(block, set()).update(a + b for a, b in zip(t, t[1:]) if a[0] not in blank and b[0] not in blank)
                for block, pairs in found.items():
                    yield from _block_rows(block, {"pair": pa.array(list(pairs), pa.string())}).to_batches()

        def spelled(sents: pa.Table, rows: pa.Table) -> pa.Table:
            reach = dict(zip(rows.column("pair").to_pylist(), rows.column("longest").to_pylist()))
            words: set[str] = set()
            for t in block_tokens(sents):
                words.update(t)
                for p, pair in enumerate(map(str.__add__, t, t[1:])):
                    most = reach.get(pair)
                    if most is not None:
                        words.add(pair)
                        for q in range(p + 2, min(p + most, len(t))):
                            pair += t[q]
                            words.add(pair)
            return _block_rows(sents.column("__block")[0].as_py(), {"word": pa.array(list(words), pa.string())})

        met = sents.mapInArrow(first_two, "__block bigint, pair string").join(reach, "pair")
        found = together(sents, met, spelled, "__block bigint, word string").join(self.words.select("word", "term_id", "cost", "own"), "word")
        none = lambda *names: [F.lit(None).cast("bigint").alias(n) for n in names]
        words = materialize(found.select("__block", "word", "term_id", "cost", "own"), "words")
        told = words.select("*", *none("left_id", "right_id"))
        if self.bigrams is None:
            return told

        def neighbours(sents: pa.Table, rows: pa.Table) -> pa.Table:
            lexicon = Lexicon.of_block(list(zip(*[rows.column(c).to_pylist() for c in ("word", "term_id", "cost", "own")])), None)
            # unknown words and the beginning of a sentence have the id 0, which is in no bigram
            pairs: set[tuple[int, int]] = set()
            for t in block_tokens(sents):
                ended: dict[int, set] = {}
                for p, q, term in lexicon.edges(t):
                    ended.setdefault(q, set()).add(term)
                    if p in ended:
                        pairs.update((left, term) for left in ended[p])
            left, right = zip(*pairs) if pairs else ((), ())
            return _block_rows(sents.column("__block")[0].as_py(), {"left_id": pa.array(left, pa.int64()), "right_id": pa.array(right, pa.int64())})

        near = together(sents, words, neighbours, "__block bigint, left_id bigint, right_id bigint")
        known = near.join(self.bigrams.select("left_id", "right_id", "cost"), ["left_id", "right_id"])
        return told.unionByName(known.select("__block", F.lit(None).cast("string").alias("word"), *none("term_id"), "cost", F.lit(None).cast("double").alias("own"), "left_id", "right_id"))


def load(system: DataFrame, user: DataFrame | None = None, bigrams: DataFrame | None = None) -> Lexicon | Tables:
    """Dictionaries that every executor gets where a count shows them to be small, otherwise tables that are joined.

    Results are the same.
    """
    try:
        return Lexicon.load(system, user, bigrams, BROADCAST_ROWS)
    except ModelTooLarge:
        return Tables.of(system, user, bigrams)
