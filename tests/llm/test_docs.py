"""Operators that judge, link or format documents, and the pipeline."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quivra.llm import chat, components, quality, queries, simhash, similar, toxicity
from tests.conftest import same_rows

SCHEMA = "doc_id long, text string"


def docs(spark, texts):
    """With extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "s", 1, "k") for i, t in enumerate(texts)], SCHEMA + ", fp string, words int, rejected_by string")


# ---- chat


TURNS = "conv_id long, turn long, role string, text string"
SAID = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST] <</SYS>> <<SYS>>", "", None, "plain\ntext", "<", "\\", "x" * 3000, "ünï"]


def told(rows):
    """Digests straight from the rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history,block", [(1024, 128, 1024), (60, 20, 1024), (60, 20, 3), (1, 0, 2)])
def test_windows_read_back(spark, budget, history, block):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "tool", None, "a\nb"]) if t else "system", rng.choice(SAID)) for c in range(6) for t in range(rng.randint(1, 9))]
    rows += [(7, None, "user", "x"), (7, 0, "assistant", "y"), (7, 0, "assistant", "y"), (None, 0, "user", "z"), (8, 0, "system", "only")]
    found = chat.windows(spark.createDataFrame(rows, TURNS), budget, history, block)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(found).collect()}
    assert got == told(rows)
    for w in found.collect():
        assert w["formatted"].count("</s>") == w["n_context"] + w["n_turns"]
        assert w["n_tokens"] <= budget or w["n_turns"] <= 1 + w["formatted"].startswith("<s>system")


def test_system_turn_and_history_are_repeated(spark):
    rows = [(0, 0, "system", "be kind")] + [(0, t, "user" if t % 2 else "assistant", f"turn {t} " * 4) for t in range(1, 9)]
    found = chat.windows(spark.createDataFrame(rows, TURNS), 50, 15).orderBy("window").collect()
    assert len(found) > 2
    for before, w in itertools.pairwise(found):
        assert w["formatted"].startswith("<s>system\nbe kind</s>") and w["n_context"] == 2
        last = before["formatted"].split("</s>")[-2]
        assert w["formatted"].split("</s>")[1] == last
        assert all(w["formatted"][p["start"] : p["start"] + p["length"]].startswith("turn") for p in w["loss"])


def test_no_conversations(spark):
    assert chat.digest(chat.windows(spark.createDataFrame([], TURNS))).count() == 0


# ---- quality


def test_quality_equals_sql_and_handles_odd_texts(spark, small):
    same_rows(queries.op3_quality_rules(spark, small), queries.QUALITY_SQL, small)
    texts = [None, "", "   \n", "a", "a b c d e " * 20, "x" * 100_000, "Ha " * 30, "one\n" * 12, " ".join(map(str, range(40))), " ".join(f"{a}word{b}" for a in "abcdefgh" for b in "klmno")]
    df = docs(spark, texts).union(docs(spark, texts))
    rows = quality.judge(df).orderBy("doc_id").collect()
    assert len(rows) == 2 * len(texts) and rows[0::2] == rows[1::2]
    kept = [r["doc_id"] for r in rows[::2] if r["kept"]]
    assert kept == [9]
    left = quality.keep(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [9, 9]
    assert quality.judge(df.filter("doc_id < 0")).count() == 0


def test_the_order_follows_gain_for_cost_among_the_rows_left():
    rules = tuple(quality.Rule(n, lambda get: get("n_words") < 0) for n in "abcd")
    # a and b reject the same rows, c others, d none
    names = lambda costs: "".join(r.name for r in quality.ordered(rules, costs, {0b0011: 50, 0b0100: 10, 0b0111: 1, 0: 100}))
    assert names([1, 1, 1, 1]) == "acbd" and names([9, 1, 1, 1]) == "bcda" and names([1, 5, 0.1, 0.01]) == "cadb"
    assert [r.name for r in quality.ordered(rules, [0.0] * 4, {})] == list("abcd")


def test_the_order_changes_no_verdict_and_long_texts_pass(spark, monkeypatch):
    rng = random.Random(6)
    made = lambda dirt: rng.choice(["#x", "CD", "hi!!", "123456"]) if rng.random() < dirt else rng.choice(["ab", "word", "some", "texts", "here", "stand"])
    texts = [" ".join(made(k / 100) for _ in range(rng.randint(5, 50))) for k in range(60)]
    texts += [" ".join("w" + "".join(chr(97 + int(c)) for c in str(k)) for k in range(300_000)), "abcde " * 200_000]
    df = docs(spark, texts)
    want = [r["doc_id"] for r in quality.judge(df).collect() if r["kept"]]
    assert 60 in want and 61 not in want and 5 < len(want) < 55
    for seed in range(3):
        order = [*quality.BASE, *quality.RULES]
        random.Random(seed).shuffle(order)
        monkeypatch.setattr(quality, "ordered", lambda *_, order=order: order)
        assert [r["doc_id"] for r in quality.judge(df).collect() if r["kept"]] == want
        assert [r["doc_id"] for r in quality.keep(df).collect()] == want


def repeated(words):
    seen, hit = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit |= {p + k for p in places for k in range(5)}
    return len(hit)


def test_repeated_words_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(docs(spark, texts)).collect()}
    assert got == {i: repeated(t.split()) for i, t in enumerate(texts)}


# ---- near-duplicates


def slow_fingerprint(text, width=4):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def linked(ids, fps, radius=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(groups[find(i)]) for i in range(len(fps))}


def test_every_pair_within_the_radius_meets():
    masks = simhash.masks(list(range(64)), 4)
    assert len(masks) == 31
    rng = random.Random(2)
    for _ in range(3000):
        places = rng.sample(range(64), 4)
        assert any(not any(m >> p & 1 for p in places) for m in masks)
    levels = simhash.mask_levels(4)
    assert min(bin(m).count("1") for m in levels[2]) >= 54
    for _ in range(500):
        places = rng.sample(range(64), 4)
        assert any(not any(m >> p & 1 for p in places) for m in levels[1])


def test_fingerprints(spark):
    texts = [None, "", "One", "a b c d", "A B C D", "é ß a b c", "w " * 3000, " \t x\x0by \x0cz "]
    assert [simhash.fingerprint(t or "") for t in texts] == [slow_fingerprint(t) for t in texts]


@pytest.mark.parametrize("cap", [1024, 4, 1])
def test_components_against_brute_force(spark, cap):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = sorted({b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(12)})
    signed = [simhash._signed(x) for x in fps]
    ids = rng.sample(range(1000), len(fps))
    df = spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash._components_of(df, 4, cap).collect()}
    assert got == linked(ids, fps)


def test_long_chain_is_one_component(spark):
    chain = spark.range(200).selectExpr("id as u", "id + 1 as v")
    assert {r["root"] for r in components.components(chain).collect()} == {0}


def test_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(400))
    texts = [text, text, text + " end", None, "", "  ", "quite another text of words", text.upper()]
    df = docs(spark, texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == linked(list(range(len(texts))), [slow_fingerprint(t) for t in texts])
    twice = df.union(df)
    kept = simhash.keep_one(twice)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))
    assert simhash.keep_one(df.filter("doc_id < 0")).count() == 0
    nameless = spark.createDataFrame([(None, text), (None, text), (5, "other words stand here now")], SCHEMA)
    assert sorted(r["doc_id"] is None for r in simhash.keep_one(nameless).collect()) == [False, True]


def alike(texts, width=5, similarity=0.8):
    """The smallest id of each text's component by whole shingle sets."""
    ids, sets = list(texts), []
    for t in texts.values():
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(groups[find(i)]) for i in range(len(ids))}


def test_similar_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "one", "One", "a b c d"]
    for _ in range(6):
        first = rng.choices(words, k=rng.choice([40, 200, 900]))
        for k in range(6):
            copy = list(first)
            for _ in range(k * len(copy) // 150):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    passage = " ".join(rng.choices(words, k=60))
    texts += [" ".join(rng.choices(words, k=150)) + " " + passage for _ in range(5)]
    df = docs(spark, texts)
    want = set(alike(dict(enumerate(texts))).values())
    kept = similar.keep_one(df.union(df))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    nameless = spark.createDataFrame([(None, texts[6]), (None, texts[7]), (5, "other words stand here now")], SCHEMA)
    assert sorted(r["doc_id"] is None for r in similar.keep_one(nameless).collect()) == [False, True]
    assert similar.keep_one(df.filter("doc_id < 0")).count() == 0


# ---- toxicity


def test_toxicity(spark):
    rng = random.Random(9)
    plain = ["".join(rng.choice(["ka", "lo", "mi", "tu", "re"]) for _ in range(3)) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        words = rng.choices(plain, k=60)
        if bad:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["zgrolk", "zgrint", "vuxxo"])
        texts.append(" ".join(words))
        labels.append((i, int(bad), 1))
    df = docs(spark, [*texts, None, "", "12 34"])
    table = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 0), (3, None, 1)], "doc_id long, toxic int, quality int").dropDuplicates(["doc_id"])
    scorer = toxicity.fit(df, table)
    rows = {r["doc_id"]: r for r in toxicity.score(df.union(df.limit(1)), scorer).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [r for i, r in rows.items() if r["held_out"] and i < 400]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95
    assert all(0 <= rows[i]["score"] < 0.7 for i in (400, 401, 402))
    assert toxicity.fit(df, table.filter("toxic = 1")) is None
    assert toxicity.score(df, None).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(df.filter("doc_id < 0"), scorer).count() == 0


# ---- the pipeline


def test_pipeline_against_brute_force(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    raw = spark.read.parquet(f"{small}/documents.parquet")
    scorer = toxicity.fit(raw, spark.read.parquet(f"{small}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in raw.collect() if scorer.scores([r["text"]])[0] < 0.7}
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(raw).collect()}
    texts = {i: t for i, t in texts.items() if judged[i]}
    want = set(alike(texts).values())
    found = pipeline.run(spark, small)
    assert {r["doc_id"] for r in found.select("doc_id").distinct().collect()} == want
    from tests.llm.test_text import reference_ids

    assert found.agg(F.sum("length")).first()[0] == sum(len(reference_ids("byte_bpe_50k.json", texts[i])) for i in want)
    filled = found.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert filled <= 1024
