"""Scalar functions on text: lexing, token and word types, surface features, encodings.  All but GBK are Catalyst expressions.

Lexing rules: a run of CR and LF, a run of blanks and tabs, and a maximal run of *block* characters (half- and full-width
letters and digits and ``: / \\ . ? % = & # ! ~ - @``) are one token each; any other character is a token by itself.
The full-width letters W and X count only as the pair WX.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

END, SPACE, CJK, CRLF, PERIOD, NUMBER, ENGLISH, PUNCTUATION, SYMBOL, OTHER = range(10)
WORD_CHINESE, WORD_ENGLISH, WORD_NUMBER, WORD_SYMBOL, WORD_PUNCTUATION, WORD_OTHER = range(6)
#: Word type by token type.
WORD_TYPE = {SPACE: WORD_OTHER, CJK: WORD_CHINESE, CRLF: WORD_OTHER, PERIOD: WORD_PUNCTUATION, NUMBER: WORD_NUMBER, ENGLISH: WORD_ENGLISH, PUNCTUATION: WORD_PUNCTUATION, SYMBOL: WORD_SYMBOL, OTHER: WORD_PUNCTUATION}
TYPE_CODES = ("ZH", "EN", "NUM", "SYM", "PU", "OTH")

_BLOCK = r"A-Za-z0-9０-９Ａ-ＶＹＺａ-ｚ:/\\.?%=&#!~\-@"
#: For RE2 and Python, which match without recursion.
TOKEN_RE = rf"(?s)[\r\n]+|(?:ＷＸ|[{_BLOCK}])+|[ \t]+|."
#: For Java, whose repeated groups recurse: none in texts without the pair, few otherwise.
_JAVA_PLAIN = rf"(?s)[\r\n]++|[{_BLOCK}]++|[ \t]++|."
_JAVA_PAIRS = rf"(?s)[\r\n]++|(?:[{_BLOCK}]++|(?:ＷＸ)++)++|[ \t]++|."
NUMBER_RE = r"[0-9０-９]+(\.[0-9０-９]+)?"
LETTERS_RE = r"[A-Za-zＡ-Ｚａ-ｚ]+"
MARKS = ":/\\.?%=&#!~-@,，\"'“”·"
STOPS = "。！？"
SENTENCE_RE = rf"[^\r\n{STOPS}]*(?:[{STOPS}]|[\r\n]+)|[^\r\n{STOPS}]+"
#: Most tokens of a sentence.
SENTENCE_TOKENS = 1023


def lex(text: Column) -> Column:
    """Array of the tokens of a text; null and empty texts have none."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike("[ＷＸ]"), F.regexp_extract_all(t, F.lit(_JAVA_PAIRS), F.lit(0))).otherwise(F.regexp_extract_all(t, F.lit(_JAVA_PLAIN), F.lit(0)))


def token_type(token: Column) -> Column:
    """Type number of a token, the cheapest tests first."""
    u = F.ascii(token)
    return (
        F.when(u == 32, SPACE).when((u == 10) | (u == 13), CRLF).when(u == 9, SPACE)
        .when(token.rlike(f"^{LETTERS_RE}$") & ~token.isin("Ｗ", "Ｘ"), ENGLISH).when(token.rlike(f"^{NUMBER_RE}$"), NUMBER).when(F.length(token) > 1, SYMBOL)
        .when(token.isin(*STOPS), PERIOD).when(token.isin(*MARKS), PUNCTUATION).when(is_cjk(token), CJK).otherwise(OTHER)
    )


def typed_tokens(text: Column) -> Column:
    """Array of ``token, type``."""
    return F.transform(lex(text), lambda t: F.struct(t.alias("token"), token_type(t).alias("type")))


def sentence_arrays(text: Column) -> Column:
    """Array of sentences, each an array of ``token, type``: cut after a full stop or line end, and at SENTENCE_TOKENS."""

    def chunks(tokens: Column) -> Column:
        last = F.floor((F.size(tokens) - 1) / F.lit(SENTENCE_TOKENS)).cast("int")
        return F.when(F.size(tokens) <= SENTENCE_TOKENS, F.array(tokens)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * SENTENCE_TOKENS + 1, F.lit(SENTENCE_TOKENS))))

    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE_RE), F.lit(0))
    # two steps, so that a sentence's tokens are a variable to the second and computed once
    return F.flatten(F.transform(F.transform(parts, typed_tokens), chunks))


def word_type(kind: Column) -> Column:
    """Word type of a token type."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in WORD_TYPE.items() for x in pair]), kind)


def type_code(kind: Column) -> Column:
    """Two- or three-letter display code of a word type."""
    return F.element_at(F.array(*map(F.lit, TYPE_CODES)), kind + 1)


def is_cjk(word: Column) -> Column:
    """Whether the first character lies in U+4E00..U+9FA5."""
    return F.ascii(word).between(0x4E00, 0x9FA5)


def surface_features(word: Column, kind: Column) -> Column:
    """Four features of a word for the tag model: itself, first and last character, length in units of three bytes.

    Latin words and symbols are ``A``, numbers ``1``, and everything else ``.``.
    """
    same = lambda c: F.array(*[F.lit(c)] * 3, F.lit("1"))
    return (
        F.when(kind == WORD_CHINESE, F.array(word, F.left(word, F.lit(1)), F.right(word, F.lit(1)), F.floor(F.octet_length(word) / 3).cast("string")))
        .when(kind.isin(WORD_ENGLISH, WORD_SYMBOL), same("A")).when(kind == WORD_NUMBER, F.array(*[F.lit("1")] * 4)).otherwise(same("."))
    )


def trim(text: Column) -> Column:
    """Without the blanks, tabs, line ends and form feeds at both ends."""
    return F.btrim(text, F.lit(" \t\r\n\v\f"))


def cost(p: Column) -> Column:
    """-ln(p), without a negative zero."""
    return F.lit(0.0) - F.ln(p)


def _encode(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.encode("gbk", "ignore"))


def _decode(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else bytes(b).decode("gbk", "ignore"))


def to_gbk(text: Column) -> Column:
    """GBK bytes; characters that GBK lacks are left out, null stays null."""
    return F.pandas_udf(_encode, "binary")(text)


def from_gbk(data: Column) -> Column:
    """Text of GBK bytes; invalid bytes are left out, null stays null."""
    return F.pandas_udf(_decode, "string")(data)


def gbk_roundtrip(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep, n_bytes, same``: bytes of the GBK form, and whether the text comes back from it; one text at a time is held twice."""
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, same = [], []
            for a, b in slices(batch.column(n)):
                for t in batch.column(n)[a:b].to_pylist():
                    data = None if t is None else t.encode("gbk", "ignore")
                    sizes.append(None if t is None else len(data))
                    same.append(None if t is None else data.decode("gbk", "ignore") == t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sizes, pa.int32()), pa.array(same, pa.bool_())], names=[*keep, "n_bytes", "same"])

    narrow = docs.select(*keep, F.col(text).alias("__text"))
    return narrow.mapInArrow(run, StructType([*narrow.schema.fields[:n], StructField("n_bytes", IntegerType()), StructField("same", BooleanType())]))


# The same for one text in Python, for decoders and tests.
_TOKEN, _NUMBER, _LETTERS = re.compile(TOKEN_RE), re.compile(NUMBER_RE), re.compile(LETTERS_RE)


def py_lex(text: str) -> list[str]:
    return _TOKEN.findall(text)


def py_token_type(token: str) -> int:
    c = token[0]
    if c in "\r\n":
        return CRLF
    if c in " \t":
        return SPACE
    if _NUMBER.fullmatch(token):
        return NUMBER
    if _LETTERS.fullmatch(token) and token not in ("Ｗ", "Ｘ"):
        return ENGLISH
    if len(token) > 1:
        return SYMBOL
    return PERIOD if c in STOPS else PUNCTUATION if c in MARKS else CJK if 0x4E00 <= ord(c) <= 0x9FA5 else OTHER


class Types(dict):
    """:func:`py_token_type` of tokens, kept for some of them."""

    MOST = 100_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        kind = self[token] = py_token_type(token)
        return kind


def slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of an array of texts that hold about ``most`` bytes each, so that little of a batch is in Python at once."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64) + 16)
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right")))
        yield begin, end
        begin = end


def py_sentences(texts: list, types: Types) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """:func:`sentence_arrays` of several texts: all tokens, their types, where each sentence begins (and where the last
    ends), and the number of the text of each sentence."""
    tokens: list[str] = []
    ends = [0]
    for text in texts:
        if text:
            tokens += _TOKEN.findall(text)
        ends.append(len(tokens))
    kinds = np.fromiter(map(types.__getitem__, tokens), np.int32, len(tokens))
    ends = np.array(ends)
    last = (kinds == CRLF) | (kinds == PERIOD)
    last[ends[1:][ends[1:] > ends[:-1]] - 1] = True
    stops = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], stops])[: len(stops)].astype(np.int64)
    parts = (stops - starts + SENTENCE_TOKENS - 1) // SENTENCE_TOKENS
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(starts, parts) + SENTENCE_TOKENS * nth
    return tokens, kinds, np.append(starts, len(tokens)), np.searchsorted(ends, starts, side="right") - 1
