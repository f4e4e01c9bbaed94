"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lexspark.llm import bitslice, curriculum, gam, licenses, mincut, minhash, packing, pii, risk, toolcalls

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "the quick brown fox jumps over the lazy dog near the old river bank " * 6000
KEY = b"k" * 32
CLASH = ("id", "n", "shard", "piece", "key", "sig", "bands", "stratum", "level", "blank", "position", "copy", "n_tokens", "n_entities", "__gone", "__row", "__n", "__source", "__stratum", "__level", "score", "quality", "c0", "bucket", "a", "b")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "A plain text of a few words, for anyone.", "en", "src1", 41), (1, "A plain text of a few words, for anyone.", "en", "src1", 41), (2, None, "en", "src1", None), (3, "", "de", "src2", 0), (4, "   \n\t ", None, None, 6),
        (None, "Released under the MIT License by nobody.", "fr", "src0", 41), (5, LONG, "en", "src9", len(LONG)), (6, LONG + "once more", "en", "src9", len(LONG) + 9), (7, "x", None, "src1", 1), (8, "ü", "de", None, 1), (9, "", "de", "src2", 0),
        (None, None, None, None, None), (10, "Write to Dr. Karl Bauer at karl@firma.de or +49 30 1234567.", "de", "src1", 60),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (3, 0, 0), (3, 0, 0), (None, 1, 1), (7, None, None), (99, 1, 0)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("lang", F.lit("clash"))


def test_license_scan(docs):
    rows = licenses.scan_licenses(docs).collect()
    assert [(r.doc_id, r.license, r.edits) for r in rows] == [(None, "MIT", 0)]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_packing(docs):
    rows = packing.pack(docs, 100).collect()
    per = {}
    for r in rows:
        if r.bin_id is not None:
            per[r.bin_id] = per.get(r.bin_id, 0) + r.n_tokens
    assert max(per.values()) <= 100
    assert sum(r.doc_id == 1 for r in rows) == 2
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert sum(r.n_tokens for r in rows if r.doc_id == 5) == len(LONG.split())
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, 0)


def test_minhash(docs):
    found = {(r.doc_id, r.group_id, r.n_links) for r in minhash.near_duplicates(docs).collect()}
    assert found == {(5, 5, 1), (6, 5, 1), (3, 3, 1), (9, 3, 1)}
    kept = minhash.drop_near_duplicates(docs)
    # 6 is near 5, 9 equals 3, and 1 is a row twice
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text is not None) == sorted((r.doc_id or 0, r.text) for r in docs.filter("text IS NOT NULL AND doc_id NOT IN (6, 9) OR doc_id IS NULL AND text IS NOT NULL").distinct().collect())
    assert kept.filter("text IS NULL").count() == 2
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_minhash_of_null_and_repeated_ids(spark):
    words = LONG.split()[:200]
    text = lambda k: " ".join(w + str(i % 50 + 1000 * k) for i, w in enumerate(words))
    rows = [(None, text(1)), (None, text(1)), (7, text(1)), (8, text(2)), (8, text(3)), (9, text(3)), (8, text(2) + " more"), (None, text(4)), (None, text(4) + " more"), (8, None)] + [(5, text(5))] * 40
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    told = sorted((r.doc_id or 0, next((k for k in range(1, 6) if r.text and r.text.startswith(text(k))), 0)) for r in kept)
    assert told == [(0, 4), (5, 5), (7, 1), (8, 0), (8, 2), (9, 3)]


def test_unlike_members_of_a_bucket_are_compared(spark):
    """Texts of many common words fill buckets with texts unlike the centre; pairs among those are found all the same."""
    import numpy as np

    rng = np.random.default_rng(1)
    core = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(600):
        own = [f"x{i // 2}-{k}" for k in range(40)]  # i and its twin share all, others the core only: Jaccard about 1/3
        rows.append((i, " ".join(core + own + [f"last{i}"])))
    rng.shuffle(rows)
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame([(int(a), b) for a, b in rows], "doc_id bigint, text string")).collect()}
    assert len(got) == 600 and all(g == i - i % 2 for i, g in got.items())


def test_blocks_join_all_that_is_alike():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        n, m = rng.integers(1, 12, 2)
        ids = np.concatenate([rng.permutation(40)[:n], rng.permutation(40)[:m]])
        centres = rng.integers(0, 99, (4, minhash.BINS)).astype(np.uint16)
        sigs = {i: np.where(rng.random(minhash.BINS) < 0.2, 1000 + i, centres[i % 4]).astype(np.uint16) for i in range(40)}
        s = np.stack([sigs[i] for i in ids])
        got = minhash.forest(ids, s[:n], s[n:], n, 0.5)
        assert all(a < b and minhash.similarity(sigs[a], sigs[b]) == v for a, b, v in got)

        def parts(pairs):
            group = {i: i for i in ids.tolist()}
            for a, b in pairs:
                old, new = group[a], group[b]
                group = {k: new if v == old else v for k, v in group.items()}
            return {frozenset(k for k, v in group.items() if v == g) for g in group.values()}

        pairs = [(i, j) for i, j in itertools.product(ids[:n].tolist(), ids[n:].tolist()) if i != j and minhash.similarity(sigs[i], sigs[j]) >= 0.5]
        assert parts((a, b) for a, b, _ in got) == parts(pairs)


def test_risk(docs, labels):
    assert risk.decide(docs, labels).count() == docs.count()
    kept = risk.keep_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()  # too few labels to certify any level
    assert risk.keep_documents(docs, labels.limit(0)).count() == docs.count()
    assert risk.decide(docs.limit(0), labels).count() == 0


def test_repeated_labels_certify_nothing(spark):
    """A document counts once, however often it is labelled or repeated; contradictory labels don't make it good."""
    docs = spark.createDataFrame([(1, "A plain text.", "en")] * 3 + [(i, "Some other plain text.", "de") for i in range(2, 80)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 1)] * 60 + [(i, 1) for i in range(2, 80)] + [(5, 0), (None, 1)], "doc_id bigint, quality int")
    got = {r.stratum: (r.level, r.n_good) for r in risk.certify(docs, labels).collect()}
    assert got == {"en": (0, 1), "de": (len(risk.LEVELS), 77)}


def test_gam(docs, labels):
    rows = gam.classify(docs, gam.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 9)}) == 1
    prior = gam.train(docs, labels.limit(0))
    assert {r.score for r in gam.classify(docs, prior).collect()} == {0.5}
    assert gam.classify(docs.limit(0), prior).count() == 0


def test_curriculum(docs):
    rows = curriculum.mix(docs).collect()
    assert all(r.position is None or 0 <= r.position <= 1 for r in rows)
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    mixed = curriculum.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)
    assert curriculum.mix_documents(docs.limit(0)).count() == 0


def test_pii(docs):
    done = pii.pseudonymise_documents(docs, KEY)
    assert done.columns == docs.columns
    by = {}
    for r in done.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].text is None and by[3][0].text == "" and by[5][0].text == LONG
    assert by[1][0].text == by[1][1].text and by[10][0].n_chars == len(by[10][0].text)
    assert not any(x in by[10][0].text for x in ("Karl", "Bauer", "karl@", "1234567"))
    assert pii.pseudonymise(docs.limit(0), KEY).count() == 0


LONG_VALUE = "".join("aZ3kQ9_xB7-m"[i % 12] for i in range(400))
SECRETS = {
    f"token={LONG_VALUE} end": LONG_VALUE, "password: eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4f end": "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4f",
    "API_KEY=Zk3Lq9Wm2Xc7 end": "Zk3Lq9Wm2Xc7", "Password: hunter2hunter2. end": "hunter2hunter2", '{"token": "Zk3Lq9Wm2Xc7"} end': "Zk3Lq9Wm2Xc7", f"secret = {LONG_VALUE * 50} end": LONG_VALUE * 50,
}


@pytest.mark.parametrize("text", SECRETS, ids=range(len(SECRETS)))
def test_secrets_are_replaced_to_their_end(text):
    value, (out, n) = SECRETS[text], pii.rewrite(text, KEY, {})
    a = text.index(value)
    new = out[a : a + len(value)]
    assert n == 1 and len(out) == len(text) and out[:a] == text[:a] and out.endswith(text[a + len(value) :])
    assert not any(value[i : i + 6] == new[i : i + 6] for i in range(len(value) - 5)) and pii.rewrite(text.replace(value, value[:-1] + "A"), KEY, {})[0] != out


@pytest.mark.parametrize("phone", ["212-555-0187", "212.555.0187", "1-212-555-0187", "(212) 555 0187", "030 1234567", "(030) 1234567", "089/1234567", "020 7946 0958", "01 23 45 67 89", "044 123 45 67"])
def test_phones_without_a_country_code(phone):
    out, n = pii.rewrite(f"Call {phone}, or not.", KEY, {})
    new = out[5:-9]
    assert n == 1 and new != phone and [c.isdigit() for c in new] == [c.isdigit() for c in phone] and pii.entities(out) == pii.entities(f"Call {phone}, or not.")


def test_numbers_that_are_no_phones_stay():
    text = "On 01.02.2023 or 05-06-2024 at 10:30, 1 000 000 people in 2020 2021, 3.141.592 and 0.125 of 1234."
    assert pii.rewrite(text, KEY, {}) == (text, 0)


def test_untitled_mentions_of_a_titled_name_follow_it():
    out, n = pii.rewrite("Huber kam. Frau Anna Huber sagte: Anna geht. Hubers Auto, Huber's Haus, Huberta und Herr Karl Maier-Huber.", KEY, {p: f"{p[0]}x" for p in ("Anna", "Huber", "Karl", "Maier")})
    given, family = out.split("Frau ")[1].split()[:2]
    assert "Anna" not in out and "Huberta" in out and "Huber" not in out.replace("Huberta", "")
    assert n == 6 and out.startswith(f"{family} kam.") and f"sagte: {given} geht. {family}s Auto, {family}'s Haus, Huberta und Herr" in out and out.endswith(f"-{family}.")


def test_top_k(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (None, [1.0, 1.0]), (6, [float("nan"), 1.0]), (7, [2.0, None]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("block", F.lit(1)).withColumn("dims", F.lit("x"))
    got = {(r.query_id, r["rank"]): (r.neighbour_id, r.score) for r in bitslice.top_k(df, k=2).collect()}
    assert got == {(1, 1): (2, 1.0), (1, 2): (3, 0.0), (2, 1): (1, 1.0), (2, 2): (3, 0.0), (3, 1): (1, 0.0), (3, 2): (2, 0.0)}
    assert bitslice.top_k(df.limit(0)).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "again"), (2, 0, "assistant", "orphan"), (None, None, None, None), (3, None, "user", ""), (3, 2, "USER", "x" * 200_000), (3, 3, "alien", "?"), (4, 0, "user", "<tool_call>broken</tool_call>")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("x")).withColumn("nth", F.lit(1)).withColumn("call_id", F.lit("x"))
    got = {r.conv_id: r for r in toolcalls.format_chats(df).collect()}
    assert (got[1].n_calls, got[1].n_linked, got[1].n_orphans) == (1, 1, 1)
    assert (got[2].n_calls, got[2].n_orphans) == (0, 1) and got[3].n_invalid == 1
    assert toolcalls.format_chats(df.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>" + "word " * 50), (3, "u", "<div>" * 3000 + "deep"), (3, "u", "plain"), (4, "u", "<article><p>" + "Many good words here, you see. " * 3000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("x")).withColumn("x", F.lit(1))
    got = mincut.extract_pages(df, mincut.train(df)).collect()
    assert len(got) == len(rows)
    assert {(r.n_blocks, r.text) for r in got if r.page_id in (1, 2)} == {(0, "")}
    assert next(r for r in got if r.page_id == 4).text.startswith("Many good words")
    assert mincut.extract_pages(df.limit(0), mincut.train(df.limit(0))).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    for table in ("labels", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert k == 4 or out.columns == docs.columns
    assert out.count() > 0 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
