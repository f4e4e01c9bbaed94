"""Readers, sinks, lexicons, models on disk, the pipeline, streams and the command line."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexspark import cli
from lexspark.operators import lexicon, parse, perceptron, segment, tag, tokenizer
from lexspark.options import METHODS, Options
from lexspark.pipeline import Models, Pipeline
from lexspark.plans import catalogue
from lexspark.plans import fixtures as X
from lexspark.scratch import ModelTooLarge, gather
from lexspark.sources import formats
from lexspark.streaming import tokens as stream

SMALL = "/root/testdata/sf0.001"


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, value string")


def test_user_dictionary(spark):
    got = {r.word: (r.term_id - lexicon.USER_ID_START, r.cost) for r in lexicon.user_dictionary(lines(spark, "雾\n 雨 2.0\n一自 100.0\n\n雾 3\n")).collect()}
    assert got == {"雨": (0, 2.0), "一自": (1, 100.0), "雾": (2, 3.0)}
    with pytest.raises(PySparkException, match="unexpected cost field"):
        lexicon.user_dictionary(lines(spark, "word x1")).collect()
    assert lexicon.user_dictionary(lines(spark, "")).count() == 0


def test_ids_are_in_byte_order(spark):
    rng = random.Random(1)
    words = {"".join(rng.choices("aàé猫😀Zz", k=rng.randint(1, 5))) for _ in range(500)}
    rows = lexicon.unigram_model(spark.createDataFrame([(w, 1) for w in words] + [(w, 2) for w in list(words)[:50]], "word string, count bigint")).collect()
    assert [r.word for r in sorted(rows, key=lambda r: r.term_id)] == sorted(words, key=str.encode) and {r.term_id for r in rows} == set(range(1, len(words) + 1))
    import math

    assert sum(math.exp(-r.cost) for r in rows) == pytest.approx(1)


def test_bigrams_of_unknown_words_count_for_the_total(spark):
    one = lexicon.unigram_model(spark.createDataFrame([("a", 3), ("b", 1)], "word string, count bigint"))
    got = lexicon.bigram_model(spark.createDataFrame([("a", "b", 1), ("a", "b", 1), ("a", "x", 2)], "left string, right string, count bigint"), one).collect()
    assert [(r.left_id, r.right_id, round(r.cost, 6)) for r in got] == [(1, 2, 0.693147)]


def test_matching_is_what_a_walk_through_the_lexicon_finds(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("春夏秋a b.", k=rng.randint(0, 30))) for _ in range(60)]
    words = {"".join(rng.choices("春夏秋ab.", k=rng.randint(1, 4))) for _ in range(60)}
    sents = tokenizer.sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    got = {(r.doc_id, r.sent_id, r.start, r.n_tokens, r.word) for r in lexicon.matches(sents, spark.createDataFrame([(w, 1) for w in words], "word string, term_id bigint")).collect()}
    want = set()
    for s in sents.collect():
        t = [x.token for x in s.tokens]
        want |= {(s.doc_id, s.sent_id, a, b - a, "".join(t[a:b])) for a in range(len(t)) for b in range(a + 1, min(a + 8, len(t)) + 1) if "".join(t[a:b]) in words}
    assert got == want


def test_readers_refuse_bad_lines(spark):
    with pytest.raises(PySparkException, match="bad treebank line"):
        formats.treebank(spark.createDataFrame([("a NN x ROOT",)], "content string"), ()).collect()
    with pytest.raises(PySparkException, match="neither u nor b"):
        formats.crf_text(lines(spark, "x:1\ta\tb\t1.0")).collect()
    with pytest.raises(PySparkException, match="bad dictionary line"):
        formats.dictionary(lines(spark, "lonely")).collect()
    with pytest.raises(PySparkException, match="bad value"):
        formats.dictionary(lines(spark, "a 1.x")).collect()
    rows = formats.treebank(spark.createDataFrame([("\n\r\na NN 0 ROOT\r\n\r\n \n\nb VV 0 ROOT\nc PU 1 P\n\n",)], "content string"), ()).collect()
    assert [(r.sent, r.idx, r.word, r["head"]) for r in rows] == [(0, 1, "a", 0), (1, 1, "b", 0), (1, 2, "c", 1)]
    assert [(r.word, r.tag) for r in formats.tagged_corpus(lines(spark, "a_b_C  plain _D")).collect()] == [("a_b", "C"), ("", "D")]
    assert {(r.word, r["count"]) for r in formats.unigram_counts(lines(spark, "a 2\nb 1.5\n")).collect()} == {("a", 2.0), ("b", 1.5)}
    assert [tuple(r) for r in formats.bigram_counts(lines(spark, "a b 2")).collect()] == [("a", "b", 2)]


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "u.txt").write_text("我的猫\n\nb\r\n", encoding="utf-8")
    (tmp_path / "g.txt").write_bytes("我的猫\n".encode("gbk"))
    assert [(r.line_no, r.value) for r in formats.read_lines(spark, str(tmp_path / "u.txt")).collect()] == [(0, "我的猫"), (1, ""), (2, "b")]
    assert [r.value for r in formats.read_lines(spark, str(tmp_path / "g.txt"), "GBK").collect()] == ["我的猫"]
    formats.write_lines(spark.createDataFrame([("我的猫",)], "line string"), str(tmp_path / "out"), "line", "GBK")
    assert b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part*")).strip() == "我的猫".encode("gbk")


def test_models_too_large_are_refused(spark):
    assert len(gather(spark.range(5), 5)) == 5
    with pytest.raises(ModelTooLarge):
        gather(spark.range(6), 5)


def test_options():
    for bad in ({"segmenter": "x"}, {"tagger": "x"}, {"parser": "x"}, {"encoding": "x"}, {"parser": "beam", "tagger": "none"}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert Options() == Options("mixed", "mixed", "none", "UTF-8") and Options("crf", "none").model_tables == ("segment_crf", "segment_templates")
    assert all(Options(*m) for m in METHODS.values())


def test_markov_rows_sum_to_one(spark):
    corpus = catalogue.weak_corpus(spark.read.parquet(f"{SMALL}/documents.parquet"))
    rows = tag.transitions_of(corpus).toPandas()
    assert rows.assign(p=(-rows.cost).map(__import__("math").exp)).groupby("left").p.sum().round(9).eq(1).all()
    by_rows = corpus.select("doc_id", "sent_id", F.posexplode("tags").alias("idx", "tag"))
    assert sorted(map(tuple, tag.transitions(by_rows).collect())) == sorted(map(tuple, tag.transitions_of(corpus).collect()))


@pytest.fixture(scope="module")
def models(spark, tmp_path_factory):
    """A small model for each use, on disk."""
    path = str(tmp_path_factory.mktemp("models"))
    move = [(a, b, 1.0) for a in ("CD", "NN", "PU", "VV", tag.BOS) for b in ("CD", "NN", "PU", "VV", tag.BOS)]
    rows = parse.train_rows([(["小猫", "睡", "。"], ["NN", "VV", "PU"], [2, 0, 2], ["SBJ", "ROOT", "P"])])
    one = lambda t: spark.createDataFrame(list(enumerate(t)), "line_no int, template string")
    formats.save_model(
        {
            "unigram": spark.createDataFrame([("小", 1, 3.0), ("猫", 2, 3.0), ("睡", 3, 3.0), ("。", 4, 1.0)], "word string, term_id bigint, cost double"), "bigram": spark.createDataFrame([(1, 2, 3.5)], "left_id bigint, right_id bigint, cost double"),
            "segment_crf": spark.createDataFrame(list(X.SEGMENT_CRF), "feature string, left string, right string, weight double"), "segment_templates": one(X.SEGMENT_TEMPLATES),
            "oov_properties": spark.createDataFrame([("睡", 3)], "key string, value int"), "hmm_emission": spark.createDataFrame([("睡", "VV", 0.0, 9), ("。", "PU", 0.0, 9)], "word string, tag string, cost double, total_count bigint"),
            "hmm_transition": spark.createDataFrame(move, "left string, right string, cost double"), "tag_crf": spark.createDataFrame([("u:小猫", None, "NN", 1.0), ("u:x", None, "VV", 1.0), ("u:x", None, "PU", 0.0)], "feature string, left string, right string, weight double"),
            "tag_templates": one(["u:%x[0,0]"]), "parser": spark.createDataFrame(rows, "feature string, label string, weight double"), "parser_templates": one(parse.TEMPLATES),
        }, path,
    )
    return path


@pytest.mark.parametrize("parser", ["greedy", "beam"])
@pytest.mark.parametrize("encoding", ["UTF-8", "GBK"])
def test_golden_sentences(spark, models, parser, encoding):
    text = "小猫睡。小猫睡。"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    if encoding == "GBK":
        df = spark.createDataFrame([(1, bytearray(text.encode("gbk"))), (2, bytearray()), (3, None)], "doc_id int, text binary")
    got = [tuple(r)[1:6] + tuple(r)[6:7] + (r.is_bos,) for r in Pipeline(Options(parser=parser, model_path=models, encoding=encoding)).transform(df).orderBy("sent_id", "idx").collect()]
    one = [(1, "小猫", "NN", 2, "SBJ", True), (2, "睡", "VV", 0, "ROOT", False), (3, "。", "PU", 2, "P", False)]
    assert got == [(s, *w) for s in (0, 1) for w in one]


def test_segmenters_of_the_pipeline(spark, models):
    df = spark.createDataFrame([(1, "小猫睡。")], "doc_id int, text string")
    for method, want in (("unigram", "小 猫 睡 。"), ("bigram", "小 猫 睡 。"), ("mixed", "小猫 睡 。")):
        out = Pipeline(Options(method, "none", model_path=models)).transform(df)
        assert " ".join(r.word for r in out.orderBy("idx").collect()) == want
        assert {(r.pos_tag, r["head"], r.dep_label) for r in out.collect()} == {("none", 0, "none")}
    with pytest.raises(ValueError):
        Pipeline(Options("unigram", "none"), Models()).transform(df)


def test_command_line(spark, models, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("小猫睡。\n\n小猫 睡\n", encoding="utf-8")
    assert cli.main(["-m", "mixed_seg", "-t", "-d", models, str(tmp_path / "in.txt")], spark) == 0
    assert capsys.readouterr().out == "小猫_ZH  睡_ZH  。_PU  \n小猫_ZH  睡_ZH  \n"
    assert cli.main(["-m", "dep", "-d", models, str(tmp_path / "in.txt"), str(tmp_path / "out")], spark) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert text.startswith("1\t小猫\tNN\t2\tSBJ\n2\t睡\tVV\t0\tROOT\n3\t。\tPU\t2\tP\n")
    (tmp_path / "user.txt").write_text("小猫睡 0.5\n", encoding="utf-8")
    cli.main(["-m", "bigram_seg", "-u", str(tmp_path / "user.txt"), "-d", models, str(tmp_path / "in.txt")], spark)
    assert capsys.readouterr().out.startswith("小猫睡  。  ")


def test_partitions_do_not_matter(spark, models):
    rows = [(i, "小猫睡。" * (i % 4) + "abc 12.") for i in range(40)]
    pipe = Pipeline(Options(parser="greedy", model_path=models))
    one, many = (sorted(map(tuple, pipe.transform(spark.createDataFrame(rows, "doc_id int, text string").repartition(n)).collect())) for n in (1, 8))
    assert one == many


def test_streams_give_what_tables_give(spark, models, tmp_path):
    spark.createDataFrame([(1, "小猫睡。"), (2, "a b")], "doc_id int, text string").write.parquet(f"{tmp_path}/t.parquet")
    pipe = Pipeline(Options(model_path=models))
    streamed = stream.drain(pipe.transform(stream.read_table(spark, str(tmp_path), "t")), "test-stream")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, pipe.transform(spark.read.parquet(f"{tmp_path}/t.parquet")).collect()))


def test_training_in_shards(spark):
    trees = formats.tree_rows(formats.treebank(spark.createDataFrame([(X.TREEBANK,)], "content string"), ()))
    assert sorted(parse.train(trees)) == sorted((f, y, round(w, 12)) for f, y, w in parse.train_rows([(r.words, r.tags, r.heads, r.labels) for r in trees.orderBy("sent").collect()]))
    rows = parse.train(trees, shards=2)
    model = perceptron.Perceptron({y for _, y, _ in rows}, rows)
    words = trees.select(F.transform("words", lambda w: F.struct(w.alias("word"), F.lit(1).alias("word_type"))).alias("words"), "tags")
    assert all(sum(h == 0 for h in r.tree["heads"]) == 1 for r in parse.parse(words, "beam", model).collect())


def test_distributed_classification_is_the_same(spark):
    rng = random.Random(3)
    weights = [(f, y, float(rng.randint(-2, 2))) for f in "abcd" for y in ("x", "y", "z")]
    samples = [(i, f) for i in range(50) for f in rng.sample("abcde", 2)]
    got = {r.i: r.label for r in perceptron.classify(spark.createDataFrame(samples, "i int, feature string"), spark.createDataFrame(weights, "feature string, label string, weight double"), ("i",)).collect()}
    model = perceptron.Perceptron("xyz", weights)
    assert got == {i: model.labels[model.classify([f for j, f in samples if j == i])] for i in range(50)}


def test_unigram_words_of_the_table_are_the_cheapest(spark):
    """On short sentences of the table, decoded costs equal the least over all cuts."""
    from test_decoders import cheapest

    lex = catalogue._lexicon(spark, SMALL, False)
    sents = [s.tokens for s in tokenizer.sentences(spark.read.parquet(f"{SMALL}/documents.parquet")).filter(F.size("tokens") < 14).collect()]
    assert len(sents) > 20
    for s in sents:
        tokens, types = [t.token for t in s], [t.type for t in s]
        words = segment.lattice(tokens, types, lex, 1)
        assert sum(lex.costs[w] if i >= 0 else 20.0 for w, _, _, i in words) == pytest.approx(cheapest(tokens, lex.costs))
