import os
import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from quivra.operators.knn import DimensionError
from quivra.operators import topology
from quivra.sources import datasets
from quivra.sources.keyvalue import KeyValueStore
from quivra.sources.store import ConflictError, VectorStore
from quivra.streaming import feed

OPS = "pos long, kind string, id long, values array<double>"


def ids(store, generation=None):
    return sorted(r["id"] for r in store.read(generation).collect())


def test_vector_store(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/v", dim=2, shards=3)
    s.bulk_load(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "id long, values array<double>"))
    first = s.catalog["generation"]
    ops = spark.createDataFrame([(0, "upsert", 7, [7.0, 0.0]), (1, "delete", 2, None), (2, "delete", 99, None)], OPS)
    assert s.apply(ops, "one") == {"upserts": 1, "deletes": 1}
    assert s.apply(ops, "one") == {"upserts": 0, "deletes": 0}
    assert ids(s) == [0, 1, 3, 4, 5, 7] and ids(s, first) == [0, 1, 2, 3, 4, 5]
    assert [tuple(r["values"]) for r in s.row(7).collect()] == [(7.0, 0.0)] and s.row(2).isEmpty()
    with pytest.raises(DimensionError):
        s.apply(spark.createDataFrame([(0, "upsert", 1, [1.0])], OPS))
    again = VectorStore(spark, f"file://{tmp_path}/v")
    assert ids(again) == ids(s) and again.healthy()
    with pytest.raises(DimensionError):
        VectorStore(spark, f"file://{tmp_path}/v", dim=3)
    assert again.clean(1) and ids(again) == [0, 1, 3, 4, 5, 7]


def test_key_value_store(spark, tmp_path):
    s = KeyValueStore(spark, f"file://{tmp_path}/k")
    s.write_batch([("put", b"a", b"1"), ("put", b"b", b"2"), ("put", b"d", b"3")])
    pinned = s.snapshot()
    s.write_batch([("rdel", b"b", b"d")])
    values = lambda **k: {bytes(r["user_key"]): bytes(r["value"]) for r in s.scan(**k).collect()}
    assert values() == {b"a": b"1", b"d": b"3"} and values(snapshot=pinned) == {b"a": b"1", b"b": b"2", b"d": b"3"}
    s.compact()
    assert values() == {b"a": b"1", b"d": b"3"} and values(snapshot=pinned)[b"b"] == b"2"
    s.branch("create", "feature")
    s.branch("checkout", "feature")
    s.write_batch([("put", b"a", b"9")])
    assert values()[b"a"] == b"9" and values(branch="main")[b"a"] == b"1"
    assert s.archive("feature") in s.catalog["archives"] and s.clean_archives() == []
    assert s.orphan_files() and s.clean() and s.orphan_files() == []
    assert KeyValueStore(spark, f"file://{tmp_path}/k").head() == s.head()


def test_key_value_files_levels_and_tiers(spark, tmp_path):
    rng = random.Random(3)
    s = KeyValueStore(spark, f"file://{tmp_path}/k", file_rows=40, l0_files=3, level_bytes=1500)
    model, pinned = {}, {}
    for step in range(7):
        ops = []
        for _ in range(30):
            key = f"k{rng.randrange(60):03d}".encode()
            kind = rng.choice(["put", "put", "put", "del", "rdel"])
            if kind == "rdel":
                ops.append((kind, key, key[:-1] + b"~"))
                model = {k: v for k, v in model.items() if not key <= k < key[:-1] + b"~"}
            else:
                ops.append((kind, key, f"{step}".encode() if kind == "put" else None))
                model.pop(key, None)
                if kind == "put":
                    model[key] = f"{step}".encode()
        s.write_batch(ops)
        if step == 2:
            pinned, name = dict(model), s.snapshot()
        if step in (2, 5):
            assert s.auto_compact() >= 1 and max(r["level"] for r in s.catalog["files"].values()) >= 1
    values = lambda df: {bytes(r["user_key"]): bytes(r["value"]) for r in df.collect()}
    assert values(s.scan()) == model and values(s.scan(snapshot=name)) == pinned
    low = sorted(model)[0]
    assert values(s.get(low)) == {low: model[low]} and s.get(b"nothing").isEmpty()
    assert len(s.overlapping(b"k000", b"k003")) < len(s.catalog["files"])
    assert [bytes(r["user_key"]) for r in s.seek(b"k010", 3).collect()] == sorted(k for k in model if k >= b"k010")[:3]
    assert values(s.scan_prefix(b"k02")) == {k: v for k, v in model.items() if k.startswith(b"k02")}
    size = sum(r["size_bytes"] for r in s.catalog["files"].values())
    assert s.rebalance(size // 2) and {r["tier"] for r in s.catalog["files"].values()} == {"hot", "cold"}
    frozen = s.freeze(max(r["level"] for r in s.catalog["files"].values()))
    assert frozen and values(s.scan()) == model
    s.thaw(frozen)
    assert all(r["ok"] for r in s.scrub().collect()) and values(s.scan(snapshot=name)) == pinned
    s.ingest(spark.createDataFrame([(bytearray(b"k000"), "put", bytearray(b"new"))], "user_key binary, kind string, value binary"))
    with pytest.raises(ValueError):
        s.write_batch([("rdel", b"b", b"a")])
    assert values(s.get(b"k000")) == {b"k000": b"new"}
    again = KeyValueStore(spark, f"file://{tmp_path}/k")
    s.clean()
    assert {**model, b"k000": b"new"} == values(again.scan()) and again.head() == s.head()
    broken = s._path(next(iter(s.catalog["files"])))[len("file://") :]
    spark.createDataFrame([(bytearray(b"x"), 1, "put", bytearray(b"y"))], "user_key binary, seqno long, kind string, value binary").coalesce(1).write.parquet(f"{tmp_path}/other")
    os.replace(next(p for p in map(str, tmp_path.glob("other/*.parquet"))), broken)
    for crc in pathlib.Path(broken).parent.glob(".*.crc"):
        crc.unlink()
    assert sum(not r["ok"] for r in s.scrub().collect()) == 1


def test_two_writers_and_crashes(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    a = VectorStore(spark, root, dim=1, shards=2, max_parts=3)
    b = VectorStore(spark, root)
    ops = lambda *rows: spark.createDataFrame([(i, k, key, v) for i, (k, key, v) in enumerate(rows)], OPS)
    a.apply(ops(("upsert", 1, [1.0]), ("upsert", 2, [2.0])), ("w", 1))
    with pytest.raises(ConflictError):
        b.apply(ops(("upsert", 3, [3.0])), ("x", 1))
    # what b wrote is named by no catalog
    again = VectorStore(spark, root, max_parts=3)
    assert ids(again) == [1, 2] and len(again.orphans()) == 1
    assert again.apply(ops(("delete", 1, None)), ("w", 1)) == {"upserts": 0, "deletes": 0}
    for n in range(2, 7):
        again.apply(ops(("upsert", n, [float(n)]), ("delete", n - 1, None)), ("w", n))
    assert ids(again) == [6] and len(again.catalog["parts"]) <= 3 and again.catalog["applied"] == {"w": 6}
    assert again.clean(1) and again.orphans() == [] and ids(VectorStore(spark, root)) == [6]


def test_fencing(spark):
    rows = [(1, 1, 1, "a"), (1, 2, 2, "b"), (1, 2, 2, "b"), (1, 2, 2, "x"), (1, 4, 2, "d"), (1, 3, 1, "c"), (2, 1, 1, "z")]
    found = feed.fenced(spark.createDataFrame(rows, "partition long, seq long, term long, payload string"))
    status = sorted((r["partition"], r["seq"], r["payload"], r["status"]) for r in found.collect())
    assert status == [(1, 1, "a", "applied"), (1, 2, "b", "applied"), (1, 2, "b", "duplicate"), (1, 2, "x", "conflict"), (1, 3, "c", "stale term"), (1, 4, "d", "gap"), (2, 1, "z", "applied")]


def test_replays_beyond_memory(spark, monkeypatch):
    monkeypatch.setattr(feed, "REMEMBERED", 5)
    text = "partition long, seq long, term long, payload string"
    rows = [(1, i, 1, f"p{i}") for i in range(1, 21)]
    first = [*rows, (1, 3, 1, "p3"), (1, 4, 1, "other"), (1, 19, 1, "p19")]
    found = feed.fenced(spark.createDataFrame(first, text))
    assert found.filter("status = 'applied'").count() == 20
    old = spark.createDataFrame([(1, 3, 1, "p3", "replayed"), (1, 4, 1, "other", "replayed"), (1, 19, 1, "p19", "duplicate")], text + ", status string")
    told = {r["seq"]: r["status"] for r in feed.resolved(old, spark.createDataFrame(rows, text)).collect()}
    assert told == {3: "duplicate", 4: "conflict", 19: "duplicate"}


def test_streams(spark, tmp_path):
    source = f"{tmp_path}/in"
    schema = "partition long, seq long, term long, payload string"
    spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "b")], schema).write.parquet(source)
    q = feed.fenced(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("fenced").option("checkpointLocation", f"{tmp_path}/c1").outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame([(1, 2, 1, "b"), (1, 3, 1, "c")], schema).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert sorted(r["status"] for r in spark.table("fenced").collect()) == ["applied", "applied", "applied", "duplicate"]

    store = VectorStore(spark, f"file://{tmp_path}/v", dim=1, shards=2)
    spark.createDataFrame([(0, "upsert", 1, [1.0]), (1, "upsert", 2, [2.0])], OPS).coalesce(1).write.parquet(f"{tmp_path}/m")
    q = feed.into(store, spark.readStream.schema(OPS).parquet(f"{tmp_path}/m"), f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    time.sleep(0.1)
    assert ids(VectorStore(spark, f"file://{tmp_path}/v")) == [1, 2]


def test_placement(spark):
    names = [f"n{i}" for i in range(5)]
    place = lambda order: sorted(map(tuple, topology.place(topology.endpoints(spark, order), 17, 3).collect()))
    assert place(names) == place(names[::-1]) and len(place(names)) == 51
    good = topology.place(topology.endpoints(spark, names), 17, 3)
    assert topology.problems(good, 17, 3).isEmpty() and not topology.problems(good.filter("partition_id != 4"), 17, 3).isEmpty()


def test_datasets(spark, tmp_path):
    base, updates, queries = datasets.uniform(spark, 50, 10, 5, 8)
    low, high = base.select(F.min(F.array_min("values")), F.max(F.array_max("values"))).first()
    assert -1 <= low and high < 1 and updates.count() == 10 and queries.count() == 5
    datasets.write_json(base, f"{tmp_path}/j")
    assert datasets.read_json(spark, f"{tmp_path}/j", 8).count() == 50
    with pytest.raises(ValueError):
        datasets.read_json(spark, f"{tmp_path}/j", 9)
    wide, _ = datasets.anisotropic(spark, 20, 2, 8)
    assert wide.count() == 20


def test_a_journal_is_fenced_in_one_pass(spark):
    import pandas as pd

    class Once:
        exists = False

        def update(self, _):
            pass

    rng = random.Random(8)
    rows = [(p, s, rng.choice([1, 1, 1, 2, 3]) if s > 6 else 1, rng.choice("ab")) for p in range(6) for s in [*range(p % 2, 12), *range(3, 9)]]
    rows = [r for i, r in enumerate(rows) if i not in (70, 71) and (r[0], r[1], r[2]) not in {x[:3] for x in rows[:i]}]
    names = ["partition", "seq", "term", "payload"]
    want = pd.concat([next(feed._fence((p,), iter([g]), Once())) for p, g in pd.DataFrame(rows, columns=names).groupby("partition")])
    got = feed.fenced(spark.createDataFrame(rows, "partition long, seq long, term long, payload string"))
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))
    assert {"applied", "gap", "stale term", "conflict"} <= set(want["status"])
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()  # no group is held as a whole


def test_a_level_just_written_is_not_written_again(spark, tmp_path, monkeypatch):
    s = KeyValueStore(spark, f"file://{tmp_path}/k", file_rows=4, l0_files=1, level_bytes=100)
    s.write_batch([("put", b"k%03d" % (i // 3), b"x") for i in range(60)])
    written, write = [], s._write
    monkeypatch.setattr(s, "_write", lambda rows, level: written.append(level) or write(rows, level))
    assert s.auto_compact() == 8 and written == [1]
    assert {r["level"] for r in s.catalog["files"].values()} == {8} and s.scan().count() == 20
    assert all(r["ok"] for r in s.scrub().collect())


def test_whole_folders_are_read_as_folders(spark, tmp_path):
    s = KeyValueStore(spark, f"file://{tmp_path}/k", file_rows=2)
    s.write_batch([("put", b"k%03d" % i, b"x") for i in range(20)])
    names = list(s.catalog["files"])
    assert len(names) > 5 and s._paths(names) == [s._path(names[0]).rsplit("/", 1)[0]]
    assert s._paths(names[1:]) == sorted(map(s._path, names[1:])) and s.rows(names).count() == 20
    s._move(names[:3], "cold")
    assert len(s._paths(names)) == 2 and s.rows(names).count() == 20
