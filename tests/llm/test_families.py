"""Families of near copies without their original."""

import random

import numpy as np
import pytest

from quivra.llm import similar
from tests.llm.test_docs import alike, docs


@pytest.mark.parametrize("unit", [2_000_000, 2_000])
def test_family_without_its_original(spark, unit):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(2):
        first = rng.choices(words, k=200)
        for _ in range(100):
            copy = list(first)
            for at in rng.sample(range(200), 3):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    want = sorted(set(alike(dict(enumerate(texts))).values()))
    assert sorted(r["doc_id"] for r in similar.keep_one(docs(spark, texts), unit=unit).collect()) == want


def test_links_of_a_unit():
    import pyarrow as pa

    sets = [np.arange(0, 100), np.arange(8, 108), np.arange(16, 116), np.arange(500, 510)]
    unit = pa.table({"hashes": sets, "node": [4, 3, 2, 1], "root": [4, 3, 2, 1], "head": [3] * 4})
    found = similar._linked(0.8)(unit)
    assert sorted(zip(found["u"].to_pylist(), found["v"].to_pylist())) == [(3, 2), (4, 3)]
    found = similar._beside_head(0.8)(unit)
    assert sorted(zip(found["u"].to_pylist(), found["v"].to_pylist())) == [(3, 2), (3, 4)]


def test_hashes_are_those_of_words_wherever_they_stand():
    words = [b"a", b"bc", b"a", b"bc", b"a", b"bc", b"\xc3\xa9"]
    node, found = similar.hashed(words, 2)
    assert len(found) == 6 and found[0] == found[2] == found[4] and found[1] == found[3] and len(set(found.tolist())) == 3
    assert similar.hashed([b"x", b"a", b"bc"], 2)[1][1] == found[0] and similar.hashed([b"a"], 2)[1][0] == similar.hashed([b"a", b"a"], 1)[1][0]
    assert node != similar.hashed(words[:-1], 2)[0] and len(similar.hashed([], 2)[1]) == 0
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    want = [similar.votes(np.array(sorted(values.tolist(), key=lambda v, a=int(a): v * a % (1 << 64))[:6], np.uint64)) for a in similar._ODD[:24]]
    assert similar.samples(values, 24, 6).tolist() == want
    assert similar.samples(np.resize(values, 50)[:3], 24, 6).tolist() == [similar.votes(values[:3])] * 24


def test_repeated_rows_clashing_names_and_a_very_long_text(spark):
    names = "doc_id long, text string, node string, rid int, row int, fp int, m int"
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, "a b c d e f g", "x", 1, 2, 3, 4), (1, "a b c d e f g", "x", 1, 2, 3, 4), (2, long, "y", 1, 2, 3, 4), (3, long + " end", "y", 1, 2, 3, 4), (None, None, None, None, None, None, None), (None, "", None, None, None, None, None)]
    df = spark.createDataFrame(rows, names)
    kept = similar.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect()) == [(0, 0), (1, 13), (2, len(long))]
