"""Decoders against enumeration of all results, and trees against hand-made derivations."""

import itertools
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import lexicon, parse, segment, tag
from lexspark.operators.crf import Crf
from lexspark.operators.lexicon import Lexicon
from lexspark.operators.perceptron import Perceptron
from lexspark.plans import fixtures as X


def lattice_of(rng, letters="abcd"):
    words = {"".join(rng.choices("春夏秋冬"[: len(letters)], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 7))}
    system = [(w, i + 1, rng.choice([1.0, 2.0, 3.5, 7.0])) for i, w in enumerate(sorted(words))]
    return system


def cheapest(tokens, costs):
    """Least cost over all ways to cut, unknown tokens where no word is or ends."""
    n, ends = len(tokens), {q for p in range(len(tokens)) for q in range(p + 2, len(tokens) + 1) if "".join(tokens[p:q]) in costs}
    best = math.inf
    for cut in itertools.product((0, 1), repeat=n - 1):
        at = [0, *[i + 1 for i, c in enumerate(cut) if c], n]
        total = 0.0
        for a, b in zip(at, at[1:]):
            word = "".join(tokens[a:b])
            total += costs[word] if word in costs else segment.UNKNOWN_COST if b == a + 1 and b not in ends else math.inf
        best = min(best, total)
    return best


def test_unigram_path_is_the_cheapest():
    rng = random.Random(7)
    for _ in range(400):
        lex = Lexicon.build(lattice_of(rng))
        tokens = rng.choices("春夏秋冬", k=rng.randint(1, 8))
        words = segment.lattice(tokens, [2] * len(tokens), lex, 1)
        assert "".join(w for w, *_ in words) == "".join(tokens) and sum(n for _, n, *_ in words) == len(tokens)
        assert sum(lex.costs[w] if i >= 0 else 20.0 for w, _, _, i in words) == pytest.approx(cheapest(tokens, lex.costs))


def test_bigrams_count_and_a_wide_beam_is_exact():
    lex = Lexicon.build([("春", 1, 3.0), ("夏", 2, 3.0), ("春夏", 3, 5.5), ("秋", 4, 3.0)], bigrams=[(1, 2, 3.5), (2, 4, 4.0)])
    assert [w for w, *_ in segment.lattice(list("春夏秋"), [2] * 3, lex, 3)] == ["春", "夏", "秋"]  # 3 + .5 + 1 against 5.5 + 3
    plain = Lexicon(lex.index, lex.costs, lex.unigram, None)
    assert [w for w, *_ in segment.lattice(list("春夏秋"), [2] * 3, plain, 1)] == ["春夏", "秋"]


def test_user_dictionary():
    system = [("第一", 1, 8.0), ("一", 2, 9.0), ("自", 3, 9.0), ("机", 4, 9.0), ("海", 5, 9.0)]
    user = [("海风号", 0x40000000, 6.0), ("一自", 0x40000001, 100.0), ("一", 0x40000002, 6.0), ("自", 0x40000003, 1.0)]
    lex = Lexicon.build(system, user)
    assert lex.costs["一"] == 9.0 and lex.costs["自"] == 1.0 and lex.index["自"] == 3
    assert [w for w, *_ in segment.lattice(list("海风号第一自机"), [2] * 7, lex, 3)] == ["海风号", "第一", "自", "机"]
    cheap = Lexicon.build(system, [("一自", 0x40000001, 0.5), ("第", 0x40000004, 1.0)])
    assert [w for w, *_ in segment.lattice(list("第一自"), [2] * 3, cheap, 3)] == ["第", "一自"]


def test_types_of_words():
    lex = Lexicon.build([("é", 1, 2.0), ("aé", 2, 1.0)])
    assert segment.lattice(["a", "é", " ", "7"], [6, 9, 1, 5], lex, 3) == [("aé", 2, T.WORD_CHINESE, 2), (" ", 1, T.WORD_OTHER, -1), ("7", 1, T.WORD_NUMBER, -1)]
    assert segment.lattice([], [], lex, 3) == []


def random_crf(rng, tags):
    rows = [("u:" + c, None, t, rng.uniform(-2, 2)) for c in "abc" for t in tags if rng.random() < 0.8] + [("b", x, y, rng.uniform(-2, 2)) for x in tags for y in tags]
    rows += [("b2" + c, x, y, rng.uniform(-1, 1)) for c in "ab" for x in tags for y in tags]
    return Crf.build(rows, ["u:%x[0,0]", "b", "b2%x[-1,0]"])


def test_viterbi_is_the_best_path():
    rng = random.Random(8)
    for trial in range(150):
        crf = random_crf(rng, ["X", "Y", "Z"])
        n = rng.randint(1, 5)
        places = [(rng.choice("abc"),) for _ in range(n)]
        begin = rng.randrange(n)
        end = rng.randint(begin + 1, n)
        first, last = rng.choice([None, 0, 2]), rng.choice([None, 1])
        allowed = [rng.choice([None, [0], [1, 2]]) for _ in range(n)]
        moves = np.array([[rng.random() < 0.8 or x == y for y in range(3)] for x in range(3)]) if trial % 2 else None

        def score(path):
            total, left = 0.0, first
            for k, y in enumerate(path):
                at = begin + k
                total += float(np.asarray(crf.scores(places, at) + np.zeros(3))[y])
                if left is not None:
                    if k and moves is not None and not moves[left, y]:
                        return -math.inf
                    total += float((crf.pairs(places, at) + np.zeros((3, 3)))[left, y])
                left = y
            if last is not None:
                if moves is not None and not moves[left, last]:
                    return -math.inf
                total += float((crf.pairs(places, end) + np.zeros((3, 3)))[left, last])
            return total

        options = [p for p in itertools.product(*[allowed[i] if allowed[i] is not None else range(3) for i in range(begin, end)]) if score(p) > -math.inf]
        if options:
            assert score(crf.decode(places, begin, end, first, last, allowed, moves)) == pytest.approx(max(map(score, options)))


def test_character_tags_make_words():
    crf = Crf.build(list(X.SEGMENT_CRF), list(X.SEGMENT_TEMPLATES))
    tokens, types = list("小猫7小帆"), [2, 2, 5, 2, 2]
    words = segment.tagged_words(tokens, types, crf)
    assert [w for w, *_ in words] == ["小猫", "7", "小帆"] and words[1][2] == T.WORD_NUMBER and words[0][1:] == (2, T.WORD_CHINESE, segment.NO_ID)
    assert "".join(w for w, *_ in segment.tagged_words(tokens, types, crf, 1, 4)) == "猫7小"


def test_mixed_segmentation_cuts_runs_again():
    crf = Crf.build(list(X.SEGMENT_CRF), list(X.SEGMENT_TEMPLATES))
    lex = Lexicon.build([("小", 1, 3.0), ("猫", 2, 3.0), ("海风", 3, 2.0)])
    tokens = list("海风小猫")
    assert [w for w, *_ in segment.mixed_words(tokens, [2] * 4, lex, 3, crf, {})] == ["海风", "小猫"]
    assert [w for w, *_ in segment.mixed_words(tokens, [2] * 4, lex, 3, crf, {"猫": segment.FILTERED})] == ["海风", "小", "猫"]
    assert [w for w, *_ in segment.mixed_words(tokens, [2] * 4, lex, 3, crf, {"小": segment.FILTERED, "猫": segment.FILTERED})] == ["海风", "小", "猫"]


def test_flags_in_sentence_order_and_declared_agree(spark):
    rng = random.Random(6)
    properties = {"甲": 1, "乙": 2, "丙": 3}
    sents = [[(w, 1 if len(w) == 1 else 2, 0 if w > "z" else 1, 0) for w in rng.choices(["甲", "乙", "丙", "丁", "甲乙", "x"], k=rng.randint(1, 9))] for _ in range(200)]
    rows = [(s, i, w, n, k) for s, ws in enumerate(sents) for i, (w, n, k, _) in enumerate(ws)]
    df = spark.createDataFrame(rows, "sent_id int, idx int, word string, n_tokens int, word_type int")
    props = spark.createDataFrame(list(properties.items()), "word string, property int")
    got = {(r.sent_id, r.idx): r.flag for r in segment.oov_flags(df, props, ("sent_id",)).collect()}
    assert got == {(s, i): f for s, ws in enumerate(sents) for i, f in enumerate(segment.recognition(ws, properties))}


def test_markov_path_is_the_cheapest():
    rng = random.Random(10)
    tags = ["CD", "NN", "PU"]
    for _ in range(150):
        move = [(a, b, rng.uniform(0, 3)) for a in [*tags, tag.BOS] for b in [*tags, tag.BOS]]
        emit = [(w, t, rng.uniform(0, 3), 5) for w in "ab" for t in rng.sample(tags, 2)]
        hmm = tag.Hmm.build(emit, move)
        words = [(rng.choice("abq"), rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 6))]
        table = {(a, b): c for a, b, c in move}

        def price(path):
            total = sum(dict(hmm.open_tags(*w))[t] for w, t in zip(words, path))
            return total + sum(table[p] for p in zip([tag.BOS, *path], [*path, tag.BOS]))

        best = min(itertools.product(*[[t for t, _ in hmm.open_tags(*w)] for w in words]), key=price)
        assert price(hmm.decode(*map(list, zip(*words)))) == pytest.approx(price(best))
    assert hmm.decode([], []) == []
    with pytest.raises(ValueError):
        tag.Hmm.build([], [("NN", "NN", 1.0)])


def test_mixed_tags_are_those_seen():
    crf = Crf.build([("u0:A", None, "NN", 5.0), ("u0:A", None, "PU", 0.0), ("u0:.", None, "NN", 9.0), ("u0:A", None, "CD", 1.0)], ["u0:%x[0,0]"])
    move = [(a, b, 1.0) for a in ("CD", "NN", "PU", tag.BOS) for b in ("CD", "NN", "PU", tag.BOS)]
    hmm = tag.Hmm.build([("x", "CD", 0.0, 5), ("y", "CD", 0.0, 4)], move)
    assert tag.crf_tags(["x", "y", ","], [1, 1, 4], crf) == ["NN", "NN", "NN"]
    assert tag.crf_tags(["x", "y", ","], [1, 1, 4], crf, hmm) == ["CD", "NN", "PU"]
    assert tag.crf_tags([], [], crf) == []


HEADS, LABELS = [2, 3, 0, 5, 3, 5, 8, 6, 3], "NMOD SBJ ROOT NMOD OBJ NMOD NMOD PMOD P".split()
STEPS = "shift L_NMOD shift L_SBJ shift shift L_NMOD shift shift shift L_NMOD R_PMOD R_NMOD R_OBJ shift R_P R_ROOT shift"


def random_tree(rng, n):
    """Heads of a tree without crossing arcs."""
    heads = [0] * (n + 1)

    def hang(a, b, parent):
        if a > b:
            return
        root = rng.randint(a, b)
        heads[root] = parent
        for lo, hi in ((a, root - 1), (root + 1, b)):
            while lo <= hi:
                mid = rng.randint(lo, hi)
                hang(lo, mid, root)
                lo = mid + 1

    hang(1, n, 0)
    return heads[1:]


def test_gold_actions():
    assert parse.gold_actions(HEADS, LABELS) == [a.replace("L_", parse.LEFT).replace("R_", parse.RIGHT) for a in STEPS.split()]
    rng = random.Random(12)
    for _ in range(300):
        n = rng.randint(1, 9)
        heads = random_tree(rng, n)
        labels = ["ROOT" if h == 0 else rng.choice("XY") for h in heads]
        state = parse.State(n)
        actions = parse.gold_actions(heads, labels)
        assert len(actions) == 2 * n
        for a in actions:
            assert state.allows(parse.split_action(a)[0], a in parse.ROOT_LABELS)
            state = state.moved(*parse.split_action(a))
        assert state.done() and state.tree(n) == (heads, labels)
    assert parse.gold_actions([3, 4, 0, 3], ["A"] * 4)[3:] == ["rightarc_A", "shift", "reduce", "reduce", "reduce"]  # crossing arcs
    with pytest.raises(ValueError):
        parse.split_action("reduce")


def trees():
    out = []
    for block in X.TREEBANK.strip().split("\n\n"):
        words, tags, heads, labels = zip(*[line.split() for line in block.split("\n")])
        out.append((list(words), list(tags), [int(h) for h in heads], list(labels)))
    return out


def test_trained_parsers_know_their_treebank():
    rows = parse.train_rows(trees())
    parser = parse.Parser(Perceptron({y for _, y, _ in rows}, rows))
    for words, tags, heads, labels in trees():
        assert parser.search(words, tags) == (heads, labels)
        assert sum(h == 0 for h in parser.greedy(words, tags)[0]) == 1
    assert parser.greedy([], []) == ([], []) and parser.search([], []) == ([], [])
    assert parse.train_rows(trees()) == rows
    for words, tags, *_ in trees():  # any words give a tree
        heads, labels = parser.search(words[::-1] * 3, tags[::-1] * 3)
        assert sum(h == 0 for h in heads) == 1 and all(h >= 0 for h in heads)


def test_beam_finds_the_best_sequence_of_all():
    rng = random.Random(13)
    labels = ["shift", "leftarc_X", "rightarc_X", "rightarc_ROOT"]
    for _ in range(25):
        words = rng.choices("ab", k=rng.randint(1, 3))
        model = Perceptron(labels, [(f"{t}:{w}", y, rng.uniform(-1, 1)) for t in "ac" for w in ("a", "b", "ROOT", "NULL") for y in labels])
        parser = parse.Parser(model, ("a:[STw]", "c:[N0w]"), 100_000)
        padded = ["ROOT", *words]

        def explore(state, weight, steps):
            options = parser.allowed(state) if steps < 2 * len(words) else []
            if not options:
                return weight
            scores = model.scores(parser.features(state, padded, padded))
            return max(explore(state.moved(*parser.actions[y], y), weight + scores[y], steps + 1) for y in options)

        states = [parse.State(len(words))]
        for _ in range(2 * len(words)):
            states = parser.step(states, padded, padded) or states
        assert states[0].weight == pytest.approx(explore(parse.State(len(words)), 0.0, 0))


def test_templates_of_the_parser():
    assert parse.compile_templates(["x:[STw]/100%[N2t]", ""]) == [("x:%s/100%%%s", (0, 6))]
    for bad in ("[STq]", "a[STw"):
        with pytest.raises(parse.BadTemplate):
            parse.compile_templates([bad])


def test_averaging():
    p = Perceptron(["a", "b"])
    for features, y in ((["f"], 1), (["f", "g"], 0), (["g"], 1)):
        p.learn(features, y)
        p.samples += 1
    p.average()
    assert {(f, y): round(w, 6) for f, y, w in p.rows()} == {("f", "a"): round(-1 + 1 - 1 / 3, 6), ("f", "b"): round(1 - 1 + 1 / 3, 6), ("g", "a"): round(1 - 1 - 1 / 3 + 2 / 3, 6), ("g", "b"): round(-1 + 1 + 1 / 3 - 2 / 3, 6)}


@pytest.mark.parametrize("method", ["unigram", "bigram", "mixed"])
def test_lexicons_of_tables_give_the_same(spark, method):
    """Words and bigrams that are joined to each sentence, and dictionaries that every worker has."""
    from lexspark.plans import catalogue, fixtures

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(-1, "小猫和晴雨表。海风号 and the 海风号, x1-y2 小帆"), (-2, ""), (-3, None)], "doc_id bigint, text string"))
    sents = catalogue.tokenizer.sentences(docs)
    words = lexicon.unigram_model(lexicon.word_counts(docs)).withColumn("cost", F.round("cost", 9))
    pairs = lexicon.bigram_model(lexicon.pair_counts(docs), words).withColumn("cost", F.round("cost", 9))
    user = lexicon.user_dictionary(catalogue._lines(spark, fixtures.USER_DICTIONARY))
    got = []
    for lex in (lexicon.Lexicon.load(words, user, pairs), lexicon.Tables.of(words, user, pairs)):
        done = segment.segment(sents, method, lex, catalogue._segment_crf(), dict(fixtures.OOV_PROPERTIES))
        got.append(sorted(map(str, done.select("doc_id", "sent_id", "words").collect())))
    assert got[0] == got[1] and len(got[0]) > 300
    assert isinstance(lexicon.load(words, user, pairs), lexicon.Lexicon)


@pytest.mark.parametrize("method", ["hmm", "mixed"])
def test_markov_models_of_tables_give_the_same(spark, method):
    from lexspark.plans import catalogue

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    corpus = catalogue.weak_corpus(docs)
    emission = tag.emissions(corpus.select(F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("tags").alias("tag"))).alias("p")).select("p.word", "p.tag"))
    moves = tag.transitions_of(corpus)
    crf = catalogue.crf.Crf.load(tag.crf_weights(corpus, X.TAG_TEMPLATES, ("doc_id",), "places", "tags"), list(X.TAG_TEMPLATES))
    words = catalogue._token_words(spark, "/root/testdata/sf0.001", "conversations", catalogue.CHAT)
    words = words.unionByName(words.limit(5))
    whole = tag.Hmm.load(emission, moves)
    got = [sorted(map(str, tag.tag(words, method, model, crf).collect())) for model in (whole, tag.HmmTables(emission, tag.Hmm({}, whole.transition)))]
    assert got[0] == got[1] and len(got[0]) > 100
