import random

import pytest

from quivra.operators import kv

OP = "user_key string, seqno long, kind string, value string"


def model(ops, at):
    found = {}
    for key in {o[0] for o in ops if o[2] != "rdel"}:
        points = [o for o in ops if o[0] == key and o[2] != "rdel" and o[1] <= at]
        if points:
            last = max(points, key=lambda o: o[1])
            hidden = any(o[2] == "rdel" and o[0] <= key < o[3] and last[1] <= o[1] <= at for o in ops)
            if last[2] == "put" and not hidden:
                found[key] = last[3]
    return found


def seen(df):
    return {r["user_key"]: r["value"] for r in df.collect()}


def random_ops(seed, n=120):
    rng, keys, out = random.Random(seed), "abcdefgh", []
    for seq in range(1, n + 1):
        kind = rng.choices(["put", "del", "rdel"], [6, 2, 1])[0]
        if kind == "rdel":
            a, b = sorted(rng.sample(keys, 2))
            out.append((a, seq, kind, b))
        else:
            out.append((rng.choice(keys), seq, kind, str(seq) if kind == "put" else None))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_visibility_and_compaction_equal_a_model(spark, seed):
    ops = random_ops(seed)
    log = spark.createDataFrame(ops, OP)
    for at in (1, 17, 60, 120):
        assert seen(kv.visible(log, at)) == model(ops, at)
    kept = kv.compact(log, 61)
    assert kept.count() < log.count()
    for at in (60, 61, 90, 120):
        assert seen(kv.visible(kept, at)) == model(ops, at)


def test_many_ranges_by_intervals(spark, monkeypatch):
    monkeypatch.setattr(kv, "BROADCAST_RANGES", 0)
    ops = random_ops(7)
    log = spark.createDataFrame(ops, OP)
    for at in (30, 120):
        assert seen(kv.visible(log, at)) == model(ops, at)


def test_parser():
    assert kv.parse_op("put:a:b:c") == ("put", "a", "b:c")
    assert kv.parse_op("del:a") == ("del", "a", None) and kv.parse_op("rdel:a:b") == ("rdel", "a", "b")
    for bad in ("put::x", "rdel:b:a", "rdel:a:a", "x:y", "del:"):
        with pytest.raises(ValueError):
            kv.parse_op(bad)


def test_empty_range_is_rejected(spark):
    with pytest.raises(ValueError):
        kv.check_ops(spark.createDataFrame([("b", 1, "rdel", "b")], OP))


def test_prefix_end():
    assert kv.prefix_end(b"a\xff") == b"b"
    with pytest.raises(ValueError):
        kv.prefix_end(b"\xff")


def test_branches():
    b = kv.Branches(head=5)
    b.create("feature", 3)
    b.checkout("feature")
    b.advance(6)
    assert b.heads == {"main": 5, "feature": 6}
    b.drop("feature")
    assert b.current == "main"
    for bad in (lambda: b.create("bad name"), lambda: b.create("x", 99), lambda: b.drop("main")):
        with pytest.raises(ValueError):
            bad()


def test_retention_floor():
    assert kv.retention_floor(9, [], [9]) == 9 and kv.retention_floor(9, [4], [9, 2]) == 2


FILE = "file_id long, level int, smallest string, largest string, size_bytes long"


def test_overlap_without_pairs(spark):
    rng = random.Random(4)
    files = []
    for i in range(300):
        a, b = sorted(f"u{rng.randrange(200):03d}" for _ in range(2))
        files.append((i, rng.choice([0, 1]), a, b, rng.randrange(40)))
    files += [(1000, 2, "a", "b", 5), (1001, 2, "c", "d", 6), (1002, 3, "a", "b", 0), (1003, 3, "b", "c", 7), (1004, 4, "a", "a", 9)]
    want = {}
    for i, x in enumerate(files):
        for y in files[:i]:
            if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]:
                want[x[1]] = want.get(x[1], 0) + min(x[4], y[4])
    got = kv.overlap_bytes(spark.createDataFrame(files, FILE))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["level"]: r["overlap_bytes"] for r in got.collect()} == want and want[3] == 0 and 2 not in want and 4 not in want


@pytest.mark.parametrize("per_bucket", [1, 7, 1000])
def test_sweep_makes_no_pairs(spark, per_bucket):
    rng = random.Random(per_bucket)
    key = lambda: f"k{rng.randrange(400):03d}"
    points = [(key(), s, "put", "x") for s in range(1, 500)]
    ranges = [(a, b, rng.randrange(1, 600)) for a, b in ((sorted((key(), key()))) for _ in range(120))] + [("k000", "k390", 60)]
    p, r = spark.createDataFrame(points, OP), spark.createDataFrame(ranges, "__start string, __end string, __t long")
    got = kv._sweep(p, r, per_bucket)
    assert sorted(x["seqno"] for x in got.collect()) == [s for k, s, _, _ in points if not any(a <= k < b and t >= s for a, b, t in ranges)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # a range is not repeated for every interval that it covers
