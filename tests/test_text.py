"""Lexing, sentences, types, features and encodings against plain rules."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import crf, tokenizer

CASES = {
    "3.14": [("3.14", 5)], "3.": [("3.", 8)], "word.": [("word.", 8)], ".": [(".", 7)], "。": [("。", 4)], "！": [("！", 4)], "?": [("?", 7)], "abc1": [("abc1", 8)], "a b": [("a", 6), (" ", 1), ("b", 6)],
    "\r\n\n": [("\r\n\n", 3)], "我é龦": [("我", 2), ("é", 9), ("龦", 9)], "ＷＸ": [("ＷＸ", 6)], "Ｗ": [("Ｗ", 9)], ";(": [(";", 9), ("(", 9)], "": [], "aＷＸ1Ｗ": [("aＷＸ1", 8), ("Ｗ", 9)], "x\ty": [("x", 6), ("\t", 1), ("y", 6)], "１２": [("１２", 5)], "'": [("'", 7)],
}


def slow_lex(text):
    """Character by character."""
    block = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789:/\\.?%=&#!~-@") | {chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]} - {"Ｗ", "Ｘ"}
    out, i = [], 0
    while i < len(text):
        j = i
        if text[i] in "\r\n":
            while j < len(text) and text[j] in "\r\n":
                j += 1
        elif text[i] in " \t":
            while j < len(text) and text[j] in " \t":
                j += 1
        else:
            while j < len(text) and (text[j] in block or text[j : j + 2] == "ＷＸ"):
                j += 2 if text[j : j + 2] == "ＷＸ" else 1
        j = max(j, i + 1)
        out.append(text[i:j])
        i = j
    return out


def slow_sentences(tokens):
    out, now = [], []
    for t in tokens:
        now.append(t)
        if T.py_token_type(t) in (T.PERIOD, T.CRLF) or len(now) == T.SENTENCE_TOKENS:
            out.append(now)
            now = []
    return out + [now] if now else out


def texts():
    rng = random.Random(1)
    return ["".join(rng.choices("aZ09９Ｗ Ｘ\t\r\n.。！?，我龦é;ｂ-", k=rng.randint(0, 40))) for _ in range(3000)] + ["字" * 1024, "a b" * 700, "x" * 200_000, "ＷＸ" * 3000 + "w"]


def test_cases(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "text string")
    got = {r.text: [tuple(t) for t in r.t] for r in df.select("text", T.typed_tokens(F.col("text")).alias("t")).collect()}
    assert got == CASES
    assert {k: [(t, T.py_token_type(t)) for t in T.py_lex(k)] for k in CASES} == CASES


def test_random_texts(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string")
    got = {}
    for r in tokenizer.sentences(df).collect():
        got.setdefault(r.doc_id, {})[r.sent_id] = [tuple(t) for t in r.tokens]
    for i, text in enumerate(texts()):
        tokens = slow_lex(text)
        assert T.py_lex(text) == tokens
        want = [[(t, T.py_token_type(t)) for t in s] for s in slow_sentences(tokens)]
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want


def test_nothing_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a", "z"), (3, "a", "t"), (3, "a", "t")], "doc_id int, text string, tokens string").withColumn("type", F.lit(1)).withColumn("pos", F.lit(1))
    assert sorted((r.doc_id or 0, r.pos, r.token) for r in tokenizer.tokens(df).collect()) == [(0, 0, "a"), (3, 0, "a"), (3, 0, "a")]
    assert tokenizer.sentences(df).count() == 3 and tokenizer.tokens(df.limit(0)).count() == 0


def test_surface_features_and_trim(spark):
    rows = [("小猫", 0, ["小猫", "小", "猫", "2"]), ("cat", 1, ["A", "A", "A", "1"]), ("7", 2, ["1", "1", "1", "1"]), ("a1", 3, ["A", "A", "A", "1"]), ("。", 4, [".", ".", ".", "1"]), (" ", 5, [".", ".", ".", "1"])]
    df = spark.createDataFrame([r[:2] for r in rows], "w string, k int")
    assert [r.f for r in df.select(T.surface_features(F.col("w"), F.col("k")).alias("f")).collect()] == [r[2] for r in rows]
    assert spark.range(1).select(T.trim(F.lit("\t\v a b \r\n"))).first()[0] == "a b"


def test_gbk(spark):
    df = spark.createDataFrame([("我的猫",), (None,), ("",), ("ab😀c",)], "t string").select(T.to_gbk(F.col("t")).alias("b")).select("b", T.from_gbk(F.col("b")).alias("t"))
    rows = df.collect()
    assert bytes(rows[0].b).hex().upper() == "CED2B5C4C3A8" and [r.t for r in rows] == ["我的猫", None, "", "abc"]
    assert spark.createDataFrame([(bytearray(b"\xce\xd2\xff"),)], "b binary").select(T.from_gbk(F.col("b"))).first()[0] == "我"


def test_templates(spark):
    rng = random.Random(3)
    templates = ("u:%x[0,0]", "u1:%x[-2,1]/%x[1,0]", "u2:%x[5,0]%x[-5,0]", "b")
    sents = [[[rng.choice("abc"), rng.choice("de")] for _ in range(rng.randint(1, 8))] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(sents)), "i int, places array<array<string>>")
    got = {(r.i, r.idx, r.template): r.feature for r in crf.features(df, "places", templates, ("i",)).collect()}
    want = {(i, k, n): crf.expand(crf.parse_template(t), s, k) for i, s in enumerate(sents) for k in range(len(s)) for n, t in enumerate(templates)}
    assert got == want
    assert crf.expand(crf.parse_template("u%x[-1,0]%x[-2,0]%x[1,0]%x[2,0]"), [["a"]], 0) == "u_x+1_x-2_x-1_x+2"
    for bad in ("x:%x[0,0]", "u%x[6,0]", "u%y[0,0]"):
        with pytest.raises(crf.BadTemplate):
            crf.parse_template(bad)
