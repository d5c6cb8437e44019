"""Words that a polynomial hash modulo 2^64 cannot tell apart, whatever its base (Thue-Morse strings)."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from crashlens.llm import fast_minhash, quality_ledger, substring_cover
from crashlens.llm import words as W


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


X = _thue_morse(1024)
Y = X.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1, 7, 8, 9, 64, 255, 256, 257, 1024, 4096])
def test_hashes_differ(size):
    a, b = _thue_morse(size), _thue_morse(size).translate(str.maketrans("ab", "ba"))
    found = W.scan([a, b, a, a + "c"]).hashes()
    assert found[0] != found[1] and found[0] == found[2] and len(set(found.tolist())) == 3


def test_hashes_depend_on_bytes_alone():
    r = np.random.default_rng(2)
    data = r.integers(97, 100, 4000).astype(np.uint8)
    start = r.integers(0, 3900, 3000)
    end = start + r.integers(0, 12, 3000)
    by_bytes = {}
    for a, b, h in zip(start.tolist(), end.tolist(), W.span_hashes(data, start, end).tolist()):
        assert by_bytes.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by_bytes.values())) == len(by_bytes)


def _table(spark, texts):
    return spark.createDataFrame([(i + 1, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_quality(spark):
    text = f"{X}\n{Y}\nthree four five six seven eight nine ten eleven twelve"
    row = quality_ledger.quality(_table(spark, [text])).first()
    assert row.n_dup_lines == 0 and row.n_repeat_words == 0


def test_substring(spark):
    rest = " one two three four five six seven eight nine ten eleven twelve"
    rows = substring_cover.substring_dedup(_table(spark, [X + rest, Y + rest, X + rest])).collect()
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in rows}
    assert got[1][0] == 0 and got[2] == (0, hashlib.sha256((Y + rest).encode()).hexdigest()) and got[3][0] == 13


def test_near_duplicates(spark):
    got = {r.doc_id: r.component_id for r in fast_minhash.near_duplicates(_table(spark, [f"one {X}", f"one {Y}", f"one {X}"]), size=2).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_pipeline_stages(spark):
    tail = " w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"
    table = _table(spark, [f"{X}\n{X[:300]}{tail}", f"{Y}\n{Y[:300]}{tail}"])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, "").collect()} == {1, 2}
    assert [r.text for r in sorted(corpus_pipeline.repeated_passages(spark, table, "").collect())] == [r.text for r in sorted(table.collect())]
