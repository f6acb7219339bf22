"""Budgets, records a file, clashing names, directories and bounds."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quivra.llm import chat, common, packing, sharding, simhash, token_orc
from quivra.llm.queries import tokenizer_path

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [1024, 4])
def test_windows_keep_the_budget_where_a_turn_fits(spark, block):
    rng = random.Random(block)
    rows = [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), "x" * rng.choice([3, 40, 150, 320])) for c in range(20) for t in range(rng.randint(1, 14))]
    budget, history = 100, 30
    found = chat.windows(spark.createDataFrame(rows, TURNS), budget, history, block).collect()
    cost = lambda role, text: -(-(len(f"<s>{role}\n</s>") + len(text)) // 4)
    system = {c: cost(r, x) for c, t, r, x in rows if t == 0 and r == "system"}
    for w in found:
        lines = w["formatted"].split("</s>")[:-1]
        sizes = [-(-(len(x) + 4) // 4) for x in lines]
        assert sum(sizes) == w["n_tokens"]
        own = sizes[w["n_context"] :]
        first = own[1] if w["conv_id"] in system and w["block"] == w["window"] == 0 and len(own) > 1 else own[0]
        assert w["n_tokens"] <= budget or system.get(w["conv_id"], 0) + first > budget
    # a window ends only where the next turn does not fit beside it, or with its block
    by = {}
    for w in found:
        by.setdefault((w["conv_id"], w["block"]), []).append(w)
    for ws in by.values():
        for a, b in itertools.pairwise(sorted(ws, key=lambda w: w["window"])):
            after = -(-(len(b["formatted"].split("</s>")[b["n_context"]]) + 4) // 4)
            assert a["n_tokens"] + after > budget


def test_a_long_turn_goes_without_history(spark):
    rows = [(0, 0, "system", "s" * 200), (0, 1, "user", "u" * 400), (0, 2, "assistant", "a" * 3600), (0, 3, "user", "u")]
    found = chat.windows(spark.createDataFrame(rows, TURNS), 1024, 128).orderBy("window").collect()
    assert [w["n_tokens"] <= 1024 for w in found] == [True] * len(found)


def test_starts_do_not_depend_on_records_a_file(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word {i} " * (i % 7)) for i in range(300)], "doc_id long, text string")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 10)
    try:
        rows = token_orc.encode_to_orc(df, tokenizer_path("word_bpe_49k.json"), 2, str(tmp_path / "t")).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]


def test_keep_one_leaves_own_columns_alone(spark):
    names = "doc_id long, text string, __fp string, __id int, row int, fp int, rid int"
    rows = [(3, "a b c d e", "x", 1, 2, 3, 4), (1, "A b c d e", "y", 5, 6, 7, 8), (1, "A b c d e", "y", 5, 6, 7, 8), (2, "quite another text here", "z", 9, 9, 9, 9), (None, None, None, None, None, None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, names))
    assert kept.columns == [x.split()[0] for x in names.split(", ")]
    assert sorted(tuple(r) for r in kept.filter("doc_id is not null").collect()) == [rows[1], rows[3]] and kept.count() == 3
    assert simhash.keep_one(spark.createDataFrame([], names)).count() == 0


def test_ids_are_located_by_the_directory(spark):
    df = spark.createDataFrame([(i % 90, "x" * (1 + i % 40)) for i in range(120)], "doc_id long, text string")
    assigned = sharding.assign(df, 300)
    shards = sharding.directory(assigned)
    assert shards.agg(F.max("depth")).first()[0] > 1 and shards.agg(F.max("bytes")).first()[0] <= 300
    want = {(r["doc_id"], r["shard"]) for r in assigned.collect()}
    found = {tuple(r) for r in sharding.locate(df, shards, text_col="text").collect()}
    assert found == want


def test_packings_are_near_the_dual_bound():
    rng = np.random.default_rng(3)
    for made in (lambda: rng.integers(1, 1025, 4000), lambda: rng.integers(513, 700, 2000), lambda: np.minimum(1024, 1 + rng.exponential(200, 5000).astype(int)), lambda: np.full(3000, 342)):
        count = np.bincount(made(), minlength=1025)
        least = packing.bound(count, 1024)
        got = sum(packing.configurations(count, 1024).values())
        assert least - 1e-6 <= got <= 1.03 * least + 2
    assert packing.bound(np.zeros(1025, int), 1024) == 0
    # exact where every packing is known: two a sequence, one a sequence
    assert packing.bound(np.bincount([600] * 50, minlength=1025), 1024) == pytest.approx(50)


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Named:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: {})})  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_dir(Named())
