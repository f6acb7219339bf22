"""Operators on text: encoding, packing, files, media, pages, segmentations."""

import hashlib
import html as entities
import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quivra.llm import html_text, ogg, packing, sentencepiece_sampling, sharding, token_orc
from quivra.llm.encoding import ChunkEncoder
from quivra.llm.queries import sharding_sql, tokenizer_path

ODD = [None, "", " ", "a", "a  b \n c", "  lead", "x \n\n y\t z ", "tail  ", "A B  c", "don't  'll x\x1cy", "<|endoftext|> a", "日本 語　x", "Σας ΟΔΟΣ .", "é é", "word, word. word! " * 50, "x" * 5000, "\n\nA\nB\n"]
SCHEMA = "doc_id long, text string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)], SCHEMA + ", piece int, shard string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_as_whole_texts(spark, small, name):
    enc = ChunkEncoder(tokenizer_path(name), max_chunks=500)
    texts = [x or "" for x in ODD] + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert all(enc.encode(x) == enc.whole(x) for x in texts)


def reference_ids(name, text, end=2):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids + [end]


def test_token_files(spark, tmp_path):
    df = docs(spark, ODD).repartition(3)
    df = df.union(df.filter("doc_id = 14")).union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    path = f"file://{tmp_path}/t"
    found = token_orc.encode_to_orc(df, tokenizer_path("word_bpe_49k.json"), path=path, stripe_bytes=1 << 16, row_index_stride=1000)
    rows = sorted(found.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted([r["doc_id"] for r in rows], key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    by = {r["doc_id"]: r for r in rows}
    for i, text in enumerate(ODD):
        ids = np.array(reference_ids("word_bpe_49k.json", text), "<u4")
        assert (by[i]["n_tokens"], by[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    assert token_orc.lookup(spark, path, [3]).first()["ids"] == reference_ids("word_bpe_49k.json", "a")
    assert "PushedFilters: [In(doc_id" in token_orc.lookup(spark, path, [3, 4])._jdf.queryExecution().executedPlan().toString()
    none = token_orc.encode_to_orc(df.filter("doc_id < -5"), tokenizer_path("word_bpe_49k.json"), path=f"file://{tmp_path}/e")
    assert none.count() == 0


def check_packing(spark, texts, df):
    rows = packing.pack(df, tokenizer_path("byte_bpe_50k.json")).collect()
    assert sum(r["length"] for r in rows) == sum(len(reference_ids("byte_bpe_50k.json", t)) for t in texts)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return rows, seqs


def test_packing(spark, small):
    texts = ODD + ["many words here " * 1500] * 2 + ["same text"] * 30
    rows, _ = check_packing(spark, texts, docs(spark, texts))
    long = sorted(r for r in rows if r["doc_id"] == len(ODD))
    assert [r["piece"] for r in long] == list(range(len(long))) and all(r["length"] == 1024 for r in long[1:])
    ids = np.array(reference_ids("byte_bpe_50k.json", texts[len(ODD)]), "<u4")
    assert [r["ids_crc32"] for r in long] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in long]
    assert packing.pack(docs(spark, ["x"]).filter("doc_id < 0"), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_configurations_are_near_the_bound():
    rng = np.random.default_rng(3)
    count = np.bincount(np.minimum(1024, rng.lognormal(5.5, 1.0, 20_000).astype(int) + 1), minlength=1025)
    found = packing.configurations(count)
    used = Counter()
    for config, n in found.items():
        assert sum(config) <= 1024
        for k in config:
            used[k] += n
    assert all(used[k] == count[k] for k in range(1025))
    bound = math.ceil((count * np.arange(1025)).sum() / 1024)
    greedy = sum(packing.best_fit(Counter({k: int(count[k]) for k in np.flatnonzero(count)}), 1024).values())
    assert bound <= sum(found.values()) <= min(1.002 * bound + 5, 1.002 * greedy + 5)
    assert packing.configurations(np.zeros(1025, int)) == Counter()


def test_small_programs_are_optimal():
    for seed in range(8):
        rng = random.Random(seed)
        lengths = [rng.randint(1, 10) for _ in range(6)]
        fits = lambda n, lengths=lengths: any(all(sum(k for b, k in zip(way, lengths) if b == x) <= 10 for x in range(n)) for way in itertools.product(range(n), repeat=len(lengths)))
        best = next(n for n in range(1, 8) if fits(n))
        assert sum(packing.configurations(np.bincount(lengths, minlength=11), 10).values()) <= best + 1


def shard_model(rows, limit):
    def bits(t):
        return bin(int(hashlib.md5(t.encode()).hexdigest()[:15], 16))[2:].zfill(60)

    out, todo = {}, [("", [(i, len((t or "").encode()), bits(str(i))) for i, t in rows])]
    while todo:
        prefix, part = todo.pop()
        if sum(p[1] for p in part) <= limit:
            out |= {p[0]: (prefix, sum(x[1] for x in part)) for p in part}
        else:
            todo += [(prefix + b, [p for p in part if p[2][len(prefix)] == b]) for b in "01"]
    return out


def test_sharding(spark, small):
    from tests.conftest import same_rows

    texts = [None, "", "x" * 900] + ["y" * random.Random(i).randint(1, 400) for i in range(200)]
    found = sharding.assign(docs(spark, texts), 1000, chunk_bits=3).collect()
    assert {r["doc_id"]: (r["shard"], r["shard_bytes"]) for r in found} == shard_model(list(enumerate(texts)), 1000)
    table = spark.read.parquet(f"{small}/documents.parquet")
    same_rows(sharding.assign(table, 20_000), sharding_sql(20_000), small)
    assert sharding.assign(table.filter("doc_id < 0"), 100).count() == 0


def test_one_key_with_most_rows_still_meets_the_limit(spark):
    df = spark.createDataFrame([(7, "same text")] * 300 + [(7, f"other {i}") for i in range(100)] + [(None, "x" * 5000), (1, "a")], SCHEMA)
    found = sharding.assign(df, 90)
    assert found.count() == 402
    shards = sharding.directory(found).collect()
    assert sum(r["rows"] for r in shards) == 402 and all(r["bytes"] <= 90 or r["rows"] == 1 for r in shards)


def test_shards_are_written(spark, tmp_path):
    df = docs(spark, ["t" * 50] * 20)
    listed = sharding.write_shards(df, f"file://{tmp_path}/s", 200)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 20 and listed.agg(F.sum("rows")).first()[0] == 20


def crc_by_bits(data):
    r = 0
    for x in data:
        r ^= x << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else (r << 1) & 0xFFFFFFFF
    return r


def test_ogg(spark):
    assert ogg.checksum(b"OggS and more") == crc_by_bits(b"OggS and more")
    texts = ODD + ["long text " * 60_000]
    stored = ogg.store(docs(spark, texts))
    rows = {r["doc_id"]: r for r in ogg.digest(stored).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[0][1:] == rows[1][1:]
    seen = ogg.streams(stored, "doc_id", "media").filter(f"id = {len(ODD)}").collect()
    assert len(seen) == 2 and all(r["seconds"] == 300_000 / 8000 + (-600_000 % 192) / 2 / 8000 and r["ended"] and not r["lost"] for r in seen)
    nothing = ogg.streams(spark.createDataFrame([(1, None)], "id long, media binary"), "id", "media")
    assert nothing.count() == 0


def test_damaged_pages_lose_only_their_packets():
    payload, n = ogg.padded("abc" * 300_000)
    media = bytearray(ogg.mux(payload, n))
    media[100_000] ^= 1
    streams, bad = ogg.demux(bytes(media))
    assert bad == 1 and sorted(s.lost for s in streams.values()) == [0, 1]
    with pytest.raises(ValueError):
        ogg.payload_of(bytes(media))
    assert ogg.demux(b"OggS") == ({}, 1) and ogg.demux(None) == ({}, 0)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Accept them all now please.</div><main><article><h1>Title &amp; more</h1><p>First <b>bold</b> text,&nbsp;with   space.<p>Second &lt;p&gt; paragraph of it.
<script>var x="</p>";</script><ul><li>One item here.</li><li>Two items here.</li></ul><blockquote>Quoted words are here.</blockquote></article></main><aside class="sidebar"><p>Read also this other story, it is good.</p></aside>
<form><label>Mail</label><input><button>Send</button></form><section id="comments"><p>A reader says that this is nice.</p></section><footer>&copy; 2020 Somebody</footer></body></html>"""


def test_pages(spark, small):
    want = "Title & more First bold text, with space. Second <p> paragraph of it. One item here. Two items here. Quoted words are here."
    assert html_text.main_text(PAGE) == want
    for bad in (None, "", "<", "<div", "<p>", "&", "<!-- <p>x", "<a" * 50, "</p></p>", "<script>x", "<p class='a>b'"):
        html_text.main_text(bad)
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (1, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [(1, want, len(want)), (1, want, len(want)), (2, "", 0)]
    assert html_text.extract(df.filter("page_id = 9")).count() == 0
    import re

    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.main_text(r["html"]) == " ".join(p for p in parts if p)


ARTICLE = "<article><h1>The news</h1><p>First sentence of it, with more words.</p><p>Second sentence of it, and then some.</p></article>"
WANT = "The news First sentence of it, with more words. Second sentence of it, and then some."


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="single has-sidebar no-comments">{ARTICLE}</body>',
        f'<div class="social-science research">{ARTICLE}</div>',
        f"<body><svg/>{ARTICLE}</body>",
        f"<body><svg><path d='x'>{ARTICLE}</body>",
        f"<head><title>x</title>{ARTICLE}",
        f"<html><head><meta charset=x>{ARTICLE}<footer>All rights</footer>",
        f"<div><select><option>a<option>b</div>{ARTICLE}",
        ARTICLE.replace("<h1>The news</h1>", '<div class="entry-header"><h1>The news</h1></div>'),
        ARTICLE.replace("<h1>", "<header><h1>").replace("</h1>", "</h1></header>"),
        f'<div id="siteHeader">Name of it all, with words.</div><div class="cookie-notice">We use cookies here. Accept them.</div>{ARTICLE}<div class="related-stories"><p>Another story that you may like.</p></div>',
        f'{ARTICLE}<ol class="comment-list"><li><article class="comment"><p>I like this very much, well done.</p></article></li></ol><div role="contentinfo">Imprint and more of it.</div>',
        f'<p hidden>This is not to be seen by anyone.</p>{ARTICLE}<div style="display: none">Nor is this one to be seen.</div>',
        f"<script>if (a<b) x('<p>');</script><noscript>Please turn it on.</noscript>{ARTICLE}<script>open",
        f"<!-- <p>x -->{ARTICLE}<!-- open",
    ],
)
def test_articles_in_odd_pages(page):
    assert html_text.main_text(page) == WANT


def test_plain_texts_and_damage():
    assert html_text.main_text("hello") == "hello" and html_text.main_text("<p>1 < 2 &amp; 3") == "1 < 2 & 3"
    assert html_text.main_text('<ul><li><a href="/">Home</a><li><a href="/x">About us</a></ul>') == ""
    assert [b.text for b in html_text.blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><dl><dt>e<dd>f<dt>g</dl><table><tr><td>h<td>i<tr><td>j</table><p>k<p>l<b>m<br>n</b>o").blocks] == [*"abcdefghijk", "lm no"]
    assert [b.linked for b in html_text.blocks("<p><a href=x>ab<p>cd</a>ef<p>gh").blocks] == [2, 0, 0]


@pytest.mark.parametrize("unit", ['<a "', "<a ", "<div>x y", '<a ">"', "<b>x</i>", "<li><ul><div>", "<div></p>", "<p>a b", "<svg>", "<!--", "<script>", "&amp", "<td>x", "<ul><li>x</ul>", "<div><p>Some words of it.</p><p>menu</p>"])
def test_hostile_pages_take_time_in_proportion(unit):
    def seconds(size):
        page = unit * (size // len(unit))
        began = time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - began

    seconds(10_000)
    assert seconds(1_000_000) < 8


def test_minimum_cut_is_minimal():
    for seed in range(150):
        rng = random.Random(seed)
        n = rng.randint(1, 8)
        give, take = ([rng.random() * 3 for _ in range(n)] for _ in range(2))
        links = [(rng.randrange(n), rng.randrange(n), rng.random() * 2) for _ in range(2 * n)]

        def cost(side, n=n, give=give, take=take, links=links):
            return sum(take[i] if side[i] else give[i] for i in range(n)) + sum(w for a, b, w in links if side[a] != side[b])

        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert abs(cost(html_text.minimum_cut(give, take, links)) - best) < 1e-9


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_sampling.Pieces(tokenizer_path("piece_bpe_32k.model"), 0.5)


def every_path(text, theta=0.5):
    """ids of each segmentation -> probability, straight from the model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    n = sp.get_piece_size()
    known = {sp.id_to_piece(i): (i, (10 - sp.get_score(i)) ** -theta) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    line = "▁" + text.replace(" ", "▁") if text else ""

    def paths(at):
        if at == len(line):
            return [((), 1.0)]
        steps = [((known[line[at:e]][0],), known[line[at:e]][1], e) for e in range(at + 1, len(line) + 1) if line[at:e] in known]
        if not any(e == at + 1 for _, _, e in steps):
            raw = line[at].encode()
            steps.append((tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in raw), (10 + n) ** (-theta * len(raw)), at + 1))
        return [((*ids, *rest), w * p) for ids, w, e in steps for rest, p in paths(e)]

    found = dict(paths(0))
    total = sum(found.values())
    return {k: v / total for k, v in found.items()}


def drawn(pieces, texts, keys, k, seed=0):
    out = {}
    for batch in sentencepiece_sampling.segmentations(pieces, keys, texts, k, seed):
        for r in batch.to_pylist():
            out.setdefault(r["doc_id"], []).append((tuple(r["ids"]), r["log_prob"], r["perturbed"], r["inclusion"]))
    return out


@pytest.mark.parametrize("text", ["hello a", "aa  a", "🧿h", "▁▁x ", "é\n1"])
def test_samples_follow_the_exact_distribution(pieces, text):
    exact, n = every_path(text), 4000
    first, weight = Counter(), Counter()
    for key, got in drawn(pieces, [text, "between"] * n, list(range(2 * n)), 2).items():
        if key % 2 == 0:
            assert len({x[0] for x in got}) == min(2, len(exact)) and got == sorted(got, key=lambda x: -x[2])
            first[got[0][0]] += 1
            for ids, p, _, inclusion in got:
                assert abs(math.exp(p) - exact[ids]) < 1e-9
                weight[ids] += 1 / inclusion
    for path in [x for x in exact if exact[x] > 0.02]:
        assert abs(first[path] / n - exact[path]) < 0.03 and abs(weight[path] / n - 1) < 0.15
    if len(exact) < 5000:
        whole = drawn(pieces, [text], [0], len(exact) + 5)[0]
        assert {x[0] for x in whole} == set(exact) and len(whole) == len(exact) and all(x[3] == 1.0 for x in whole)


def test_samples_do_not_depend_on_the_batch(pieces, monkeypatch):
    texts = [x or "" for x in ODD] + ["hello there " * 30, "x" * 400, "x" * 70_000, "", "a b"]
    keys = list(range(len(texts)))
    whole = drawn(pieces, texts, keys, 3)
    assert whole == drawn(pieces, texts[::-1], keys[::-1], 3)
    assert all(drawn(pieces, [t], [i], 3)[i] == whole[i] for i, t in enumerate(texts))
    monkeypatch.setattr(sentencepiece_sampling, "AT_ONCE", 100)
    assert whole == drawn(pieces, texts, keys, 3)
    assert whole != drawn(pieces, texts, keys, 3, seed=1)


def test_segmentations_decode_to_their_text(spark):
    df = docs(spark, ODD).union(docs(spark, ODD))
    found = sentencepiece_sampling.sample_segmentations(df, tokenizer_path("piece_bpe_32k.model"), k=3)
    rows = sentencepiece_sampling.decode(found, tokenizer_path("piece_bpe_32k.model")).collect()
    per = {}
    for r in rows:
        per.setdefault((r["doc_id"], r["rank"]), []).append((tuple(r["ids"]), r["perturbed"], r["decoded"]))
    for (doc, _), same in per.items():
        assert len(same) == 2 and same[0] == same[1]
        assert same[0][2] == (ODD[doc] or "")
    assert len({x[0][0] for (d, _), x in per.items() if d == 14}) == 3
    assert [r["ids"] for r in sentencepiece_sampling.encode(docs(spark, ["hello", None]), tokenizer_path("piece_bpe_32k.model")).orderBy("doc_id").collect()][1] == []
