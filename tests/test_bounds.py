"""What is read, gathered and shuffled stays small as tables grow, with the same results."""

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import crf, lexicon, perceptron, segment, tag, tokenizer
from lexspark.plans import catalogue, weak
from lexspark.plans import fixtures as X

SMALL = "/root/testdata/sf0.001"
ODD = ["", None, "小猫。和\r\n\r\n x,y! 3.5ＷＸ Ｗ a😀b", "a " * 1500, "\t \n。。", "no end", "。", "7 pm, 3.5"]


def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "doc_id int, text string").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").limit(30).selectExpr("cast(doc_id + 100 as int) doc_id", "text"))


def found(df):
    return sorted(map(str, df.collect()))


def test_sentences_are_those_of_the_expression(spark):
    docs = odd(spark)
    want = docs.select("doc_id", F.posexplode(T.sentence_arrays(F.col("text"))).alias("sent_id", "tokens"))
    got = tokenizer.sentences(docs)
    assert got.columns == want.columns and found(got) == found(want)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_weak_counts_are_those_of_the_corpus(spark):
    docs = odd(spark)
    corpus = catalogue.weak_corpus(docs)
    words = corpus.select(F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("tags").alias("tag"))).alias("p")).groupBy("p.word", "p.tag").agg(F.count("*").alias("n"))
    assert found(weak.word_tags(docs)) == found(words)
    assert found(tag.transitions_from(weak.tag_pairs(docs))) == found(tag.transitions_of(corpus))
    templates = (*X.TAG_TEMPLATES, "u5:%x[2,0]%x[-2,1]")
    want = tag.crf_weights(corpus, templates, ("doc_id",), "places", "tags")
    assert found(tag.weights_of(weak.feature_tags(docs, templates), weak.tag_pairs(docs, False))) == found(want)


def test_large_lexicons_and_markov_models_are_not_gathered(spark, monkeypatch):
    """More words than are broadcast, and fewer than were before: they stay tables, and blocks get what they need."""
    docs = odd(spark)
    corpus = weak.word_tags(docs)
    emission, moves = tag.emissions_of(corpus), tag.transitions_from(weak.tag_pairs(docs))
    sents = tokenizer.sentences(docs).withColumn("words", segment.plain_words()).drop("tokens")
    want = found(tag.tag(sents, "hmm", tag.load_hmm(emission, moves)))
    words = lexicon.unigram_model(lexicon.word_counts(docs))
    pairs = lexicon.bigram_model(lexicon.pair_counts(docs), words)
    assert isinstance(lexicon.load(words, None, pairs), lexicon.Lexicon)
    for module in (lexicon, tag):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 50)
    model = tag.load_hmm(emission, moves)
    assert isinstance(model, tag.HmmTables) and isinstance(lexicon.load(words, None, pairs), lexicon.Tables)
    done = tag.tag(sents, "hmm", model)
    assert "CoGroup" in done._jdf.queryExecution().executedPlan().toString()
    assert found(done) == want


def test_few_weights_leave_no_features_to_shuffle(spark):
    rows = spark.createDataFrame([(1, "f"), (1, "g"), (2, "x"), (None, "f")], "id int, feature string")
    weights = catalogue.values(spark, [("f", "b", 1.0), ("g", "b", 0.5), ("g", "a", 1.5)], "feature string, label string, weight double")
    done = perceptron.classify(rows, weights, ("id",))
    assert found(done) == found(spark.createDataFrame([(1, "a", 1.5), (2, "a", 0.0), (None, "a", 0.0)], "id int, label string, score double"))
    scored = crf.unigram_scores(rows.withColumn("idx", F.lit(0)), weights.withColumnRenamed("label", "tag"), ("id",))
    for df in (done, scored):
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_gbk_in_slices(spark):
    docs = odd(spark)
    want = docs.select("doc_id", F.octet_length(T.to_gbk(F.col("text"))).alias("n_bytes"), (T.from_gbk(T.to_gbk(F.col("text"))) == F.col("text")).alias("same"))
    got = T.gbk_roundtrip(docs)
    assert got.dtypes == want.dtypes and found(got) == found(want)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
