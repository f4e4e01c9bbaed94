"""Near-duplicates of texts without ASCII separators."""

import random
import re

from lexspark.llm import minhash


def test_near_copies_without_blanks_are_found(spark):
    rng = random.Random(3)
    chinese = [chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(540)]
    kana = [chr(rng.randrange(0x3042, 0x3093)) for _ in range(300)]
    thai = [chr(rng.randrange(0x0E01, 0x0E2E)) for _ in range(300)]
    wide = [f"слово{rng.randrange(10**6)}，" for _ in range(200)]
    rows = []
    for i, text in enumerate((chinese, kana, thai, wide)):
        near = [*text[:100], "水" if i == 0 else text[0], *text[101:]]
        rows += [(10 * i, "".join(text)), (10 * i + 1, "".join(near)), (10 * i + 2, "\u3000".join(text))]
    rows += [(90, "".join(reversed(chinese)))]
    found = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {10 * i + k: 10 * i for i in range(4) for k in range(3)}


def test_words_are_those_of_a_plain_rule():
    import numpy as np
    import pyarrow as pa

    texts = ["中文，字。abc漢 déjà—vu «x» ١٢٣؛سلام", "plain words, only", "ünïcode…здесь", "", "。。。", "カー 🙂🙂 a"]
    low = minhash.spaced(pa.array(texts, pa.large_string()))
    got = [re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t) for t in low.to_pylist()]
    assert got == [["中", "文", "字", "abc", "漢", "déjà", "vu", "x", "١٢٣", "سلام"], ["plain", "words", "only"], ["ünïcode", "здесь"], [], [], ["カ", "ー", "🙂🙂", "a"]]
    _, offs, data = low.buffers()
    _, counts = minhash.Hasher().words(np.frombuffer(data, np.uint8)[: np.frombuffer(offs, np.int64)[len(texts)]], np.frombuffer(offs, np.int64)[: len(texts) + 1])
    assert counts.tolist() == [len(w) for w in got]
