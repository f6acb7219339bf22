"""Rare contexts and all labelled rows are evidence; values and scores against plain Python."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np

from quivra.llm import toxicity
from tests.llm.test_docs import docs


def learned(counts, **settings):
    words = [*counts[0], *(w for w in counts[1] if w not in counts[0])]
    return toxicity.kneser_ney(words, tuple(np.array([c.get(w, 0) for w in words]) for c in counts), **settings)


def by_dicts(counts, order, discount=0.75):
    """(log P(word | toxic) - log P(word | ordinary), P(gram | shared)), gram by gram."""
    grams = lambda w: [f"^{w}$"[max(0, e - order) : e] for e in range(2, len(w) + 3)]
    top = [Counter(), Counter()]
    for c in (0, 1):
        for w, n in counts[c].items():
            for g in grams(w):
                top[c][g] += n
    level = top[0] + top[1]
    pieces = {g[i:] for g in level for i in range(len(g))}
    lower = Counter(p[1:] for p in pieces if len(p) > 1)
    lower.update({g: n for g, n in level.items() if len(g) < order})

    def smoothed(table, gram, low):
        of = [n for g, n in table.items() if g[:-1] == gram[:-1] and n]
        return (max(table[gram] - discount, 0) + discount * len(of) * low) / sum(of) if of else low

    def shared(low):
        p = 1 / max(2, len({x[-1] for x in level}))
        for i in range(len(low) - 1, -1, -1):
            p = smoothed(lower, low[i:], p)
        return p

    def word(w):
        value = 0.0
        for g in grams(w):
            p = shared(g[1:] if len(g) == order else g)
            value += math.log(smoothed(top[1], g, p) / smoothed(top[0], g, p))
        return value

    return word, shared


def test_values_are_those_of_all_grams():
    rng = random.Random(4)
    made = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 9)))
    counts = tuple({made(): rng.randint(1, 3) for _ in range(40)} for _ in (0, 1))
    for order in (3, 5):
        model, (want, shared) = learned(counts, order=order, chunk=7), by_dicts(counts, order)
        for w in [*counts[0], *counts[1], *(made() for _ in range(20)), "zz", "a" * 60]:
            assert abs(model.word(w) - want(w)) < 1e-5 * max(1, len(w))
        for context in ("", "a", "ab", "é"):
            assert abs(sum(shared(context + c) for c in "abcdé$") - 1) < 1e-9


def test_an_expression_met_once_is_evidence():
    model = learned(({"kalomi": 9, "turemi": 9}, {"kalomi": 3, "zgrolk": 1}))
    assert model.word("zgrolk") > model.word("zgr") + 0.5


def test_scores_against_plain_python_and_in_any_company(monkeypatch):
    rng = random.Random(8)
    made = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    counts = tuple({made(): rng.randint(1, 3) for _ in range(60)} for _ in (0, 1))
    model, window = learned(counts), 4
    weight = np.array([-0.5, 1.0, 0.3, 0.2, 0.7, -0.2, 0.1, 0.4])
    scorer = toxicity.Scorer(model, np.full(7, 0.1), np.full(7, 2.0), weight, window)
    texts = [None, "", "12 _ 34", "a", "Ab,ÉÉ\nİx3ab"] + [" ".join(made().upper() if rng.random() < 0.2 else made() for _ in range(rng.randint(1, 40))) for _ in range(30)]
    texts += texts[5:9] + ["x" * 5000 + " ab", " " * 5000, "a " * 3000]

    def plain(text):
        x = [model.word(w) for w in toxicity.words_of(text)]
        f = [0.0] * 7
        if x:
            n, size = min(window, len(x)), len(x)
            one, two = sum(max(v - 1, 0) for v in x), sum(max(v - 2, 0) for v in x)
            f = [sum(x) / size, max(sum(x[i : i + n]) for i in range(size - n + 1)) / n, max(x), one / size, two / size, one / size**0.5, two / size**0.5]
        z = weight[0] + sum(w * (v - 0.1) / 2 for w, v in zip(weight[1:], f))
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    got = scorer.scores(texts)
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-9)
    assert all(scorer.scores([t])[0] == s for t, s in zip(texts, got))
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert (scorer.scores(texts) == got).all()


def test_a_very_long_text_is_read_in_pieces():
    model = learned(({"kalomi": 9, "turemi": 9}, {"kalomi": 3, "zgrolk": 1}))
    text = "kalomi turemi, " * 400_000 + "zgrolk " * 9
    began = time.perf_counter()
    values, count = model.of_texts([text, "zgrolk"])
    assert count.tolist() == [800_009, 1] and values[-1] == values[800_000] and time.perf_counter() - began < 30
    assert "".join(toxicity.pieces(text)) == text and max(map(len, toxicity.pieces(text))) < toxicity.PIECE + 20


def test_counts_take_all_rows_but_those_of_the_curve(spark, monkeypatch):
    texts = [f"common {'zgrolk' if i % 3 == 0 else 'kalomi'} w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    table = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    table = table.union(spark.createDataFrame([(0, 0), (2, 0), (2, 0)], "doc_id long, toxic int"))
    seen, whole = [], toxicity.kneser_ney
    monkeypatch.setattr(toxicity, "kneser_ney", lambda words, counts, order: seen.append((words, counts)) or whole(words, counts, order))
    toxicity.fit(docs(spark, texts), table, per_class=10)
    known = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    words, counts = seen[0]
    at = words[0 : len(words)].index("common")
    assert len(known) - 20 <= counts[0][at] + counts[1][at] <= len(known)
