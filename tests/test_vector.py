import numpy as np
import pytest
from pyspark.sql import functions as F

from quivra.functions import vector as v
from quivra.operators import ivf, knn, mutations, saq, sharded
from quivra.plans.vector_queries import asked, base

ROW = "id long, values array<double>"
OPS = "pos long, kind string, id long, values array<double>"


def rows(found):
    return [tuple(r) for r in found.orderBy("qid", "rank").collect()]


def test_exact_small(spark):
    b = spark.createDataFrame([(1, [0.0, 0.0], False), (2, [1.0, 0.0], False), (3, [4.0, 0.0], False), (4, [1.1, 0.0], True)], ROW + ", deleted boolean")
    q = spark.createDataFrame([(0, [1.1, 0.0])], "qid long, values array<double>")
    assert [r[2] for r in rows(knn.exact_knn(b, q, 2))] == [2, 1]
    assert rows(knn.exact_knn(b, q, 0)) == []
    bad = spark.createDataFrame([(0, [1.1])], "qid long, values array<double>")
    with pytest.raises(knn.DimensionError):
        knn.exact_knn(b, bad, 2)
    assert rows(knn.exact_knn(b, bad, 2, strict=False)) == []
    assert rows(knn.exact_knn(b.filter("id < 0"), q, 2)) == []


def test_exact_in_blocks_and_ties(spark):
    rng = np.random.default_rng(1)
    data = np.round(rng.random((60, 3)) * 3)
    b = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], ROW).repartition(3)
    q = spark.createDataFrame([(i, data[i].tolist()) for i in range(7)], "qid long, values array<double>")
    want = [(i, r + 1, int(j), float(((data[j] - data[i]) ** 2).sum())) for i in range(7) for r, j in enumerate(np.lexsort((np.arange(60), ((data - data[i]) ** 2).sum(1)))[:5])]
    assert rows(knn.exact_knn(b, q, 5)) == want == rows(knn.exact_knn(b, q, 5, block=3))


def test_recall(spark):
    near = lambda ids: spark.createDataFrame([(0, r, i, 0.0) for r, i in enumerate(ids, 1)], "qid long, rank long, id long, distance double")
    assert knn.recall_at_k(near([1, 2]), near([2, 3]), 2).first()["recall"] == 0.5


def test_probe_counts():
    assert ivf.probes_append_only(4, 10, 16) == 4 and ivf.probes_resident(4, 10, 200) == 80
    assert ivf.probes_diskmeta(4, 10, 16, 3) == 16 and ivf.probes_diskmeta(4, 10, 100, 3, 12) == 12


def test_probing_all_is_exact_and_pruning_loses_nothing(spark, small):
    b = base(spark, small)
    q = asked(b)
    members, centroids = ivf.build(b, 12, 2)
    exact = [r[:3] for r in rows(knn.exact_knn(b, q, 5))]
    assert [r[:3] for r in rows(ivf.search(members, centroids, q, 5, 12))] == exact
    stats = ivf.posting_stats(members, centroids)
    assert [r[:3] for r in rows(ivf.pruned_search(members, centroids, stats, q, 5, 12))] == exact
    hits = [knn.recall_at_k(ivf.search(members, centroids, q, 5, n), knn.exact_knn(b, q, 5), 5).agg(F.avg("recall")).first()[0] for n in (1, 4, 12)]
    assert hits == sorted(hits) and hits[-1] == 1.0
    assert [r[:3] for r in rows(sharded.pruned_search(b, q, 5, 3))] == exact


def test_coarse_candidates(spark):
    centroids = {i: np.array([float(i), 0.0]) for i in range(9)}
    cells, of = ivf.coarse_layer(centroids)
    assert len(cells) == 3 and set(of) == set(centroids)
    assert ivf.coarse_candidates(np.zeros(2), cells, of, 1, 100) == list(range(9))
    assert 0 in ivf.coarse_candidates(np.zeros(2), cells, of, 1, 2)


def test_batches(spark):
    b = spark.createDataFrame([(1, [0.0])], ROW)
    ops = spark.createDataFrame([(0, "upsert", 1, [0.1]), (1, "upsert", 2, [0.2]), (2, "delete", 1, None), (3, "upsert", 1, [0.15]), (4, "delete", 2, None)], OPS)
    assert mutations.counts(b, ops).first().asDict() == {"upserts": 1, "deletes": 0}
    assert [tuple(r) for r in mutations.merge(b, ops).collect()] == [(1, [0.15])]
    wrong = spark.createDataFrame([(0, "upsert", 1, [0.1, 0.2]), (1, "upsert", 1, [0.1])], OPS)
    with pytest.raises(knn.DimensionError):
        mutations.validate(wrong, 1)
    with pytest.raises(ValueError):
        mutations.routed(ops, 8, allow_partial=False)


def test_split_and_merge_keep_every_row(spark):
    b = spark.createDataFrame([(0, i, [float(i), 0.0]) for i in range(20)] + [(1, 50, [99.0, 0.0])], "posting_id long, id long, values array<double>")
    halves = mutations.split(b, 4)
    sizes = {r["posting_id"]: r["count"] for r in halves.groupBy("posting_id").count().collect()}
    assert max(sizes.values()) <= 4 and sum(sizes.values()) == 21 and halves.select("id").distinct().count() == 21
    back = mutations.merge_small(b, {0: np.array([9.5, 0.0]), 1: np.array([99.0, 0.0])}, 3)
    assert back.filter("posting_id = 0").count() == 21


def test_lire_moves_only_to_nearer(spark):
    b = spark.createDataFrame([(10, 1, [0.0]), (11, 2, [10.0]), (10, 3, [4.0]), (5, 4, [9.0])], "posting_id long, id long, values array<double>")
    centroids = {10: np.array([1.0]), 11: np.array([10.0]), 5: np.array([4.5])}
    after = {r["id"]: r["posting_id"] for r in mutations.lire_reassign(b, centroids, np.array([5.0]), (10, 11), 4).collect()}
    assert after == {1: 10, 2: 11, 3: 5, 4: 11}


def test_joint_bits_stay_in_budget():
    found = saq.joint_segments([1.0] * 16, 64, 1, 4, 2, 8)
    assert sum(s.bits * s.count for s in found) <= 64 and sum(s.count for s in found) == 16


def test_more_variance_more_bits():
    found = saq.joint_segments([9.0] * 4 + [0.01] * 4, 24, 1, 8, 2, 4)
    bits = [s.bits for s in found for _ in range(s.count)]
    assert bits[0] > bits[-1]


def test_refinement_keeps_codes_in_range_and_cosine(spark, small):
    b = base(spark, small).limit(40)
    plan = saq.Plan(list(range(64)), [saq.Segment(0, 64, 2)])
    codes = saq.encode(b, plan)
    better = saq.refine(b, codes, plan)
    cos = lambda c: saq.decode(c, plan).join(b, "id").select(F.avg(v.dot("decoded", "values") / F.sqrt(v.norm2("decoded") * v.norm2("values")))).first()[0]
    assert cos(better) > cos(codes)
    assert better.select(F.max(F.array_max("codes")), F.min(F.array_min("codes"))).first() <= (3, 3)


def test_vector_functions(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "a array<double>, b array<double>")
    got = row.select(v.squared_l2("a", "b"), v.dot("a", "b"), v.norm2("a"), v.add("a", "b"), v.scale("a", 2), v.permute("b", [1, 0])).first()
    assert tuple(got) == (13.0, 13.0, 5.0, [4.0, 7.0], [2.0, 4.0], [5.0, 3.0])
    assert v.inverse([2, 0, 1]) == [1, 2, 0]


def test_measures_of_all_pairs_without_an_expression_a_pair(spark, small):
    b = base(spark, small)
    assert "MapInArrow" in knn.measures(b, asked(b))._jdf.queryExecution().executedPlan().toString()
    pairs = b.crossJoin(asked(b).withColumnRenamed("values", "p"))
    want = pairs.select("qid", "id", F.round(v.squared_l2("values", "p"), 6), F.round(v.dot("values", "p"), 6), F.round(v.norm2("values"), 6), F.round(v.dot(v.scale("values", 2), "p"), 6))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, knn.measures(b, asked(b), block=2).collect()))


def test_measures_keep_odd_vectors(spark):
    b = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [None, 1.0]), (4, [-0.0000001, 0.0])], ROW)
    got = {(r["qid"], r["id"]): tuple(r)[2:] for r in knn.measures(b, b.select(F.col("id").alias("qid"), "values")).collect()}
    assert len(got) == 25 and got[0, 0] == (0.0, 5.0, 5.0, 10.0) and got[2, 2] == (0.0, 1.0, 1.0, 2.0)
    assert got[0, 1] == (None, None, None, None) and got[0, 2] == (None, None, 1.0, None) and got[1, 0][2] == 5.0
    assert str(got[0, 4][1]) == "0.0"  # no negative zero


def test_pruned_search_sends_no_list_of_pairs(spark, small):
    from pyspark import cloudpickle

    rng = np.random.default_rng(5)
    points, middle = rng.random((400, 8)), rng.random((2000, 8))
    lists = {p: (c, 0.5, 9.0) for p, c in enumerate(middle)}
    run = ivf._bound_scorer(lists, np.arange(400), points, np.full(400, np.inf), np.zeros((400, 1), np.int64), 3)
    assert len(cloudpickle.dumps(run)) < 1_000_000  # 400 x 2000 pairs as numbers would be 6,400,000
    b = base(spark, small)
    q = asked(b)
    assert "BroadcastNestedLoopJoin" not in sharded.pruned_search(b, q, 5, 3)._jdf.queryExecution().executedPlan().toString()
    exact = [r[:3] for r in rows(knn.exact_knn(b, q, 5))]
    members, centroids = ivf.build(b, 40, 2)
    stats = ivf.posting_stats(members, centroids)
    assert [r[:3] for r in rows(ivf.pruned_search(members, centroids, stats, q, 5, len(centroids)))] == exact
    assert rows(sharded.pruned_search(b, q, 0, 3)) == []
    assert [r[:3] for r in rows(sharded.pruned_search(b, q, 5, 300))] == exact  # shards of fewer than k rows


def test_codes_and_their_search_by_batches(spark, small):
    b = base(spark, small)
    plan = saq.Plan([*range(63, -1, -1)], saq.uniform_segments(64, 256, 4))
    codes = saq.encode(b, plan)
    key = lambda df: sorted((r["id"], r["codes"], r["v_max"], r["norm_sq"]) for r in df.collect())
    assert key(codes) == key(saq._encoded(b, plan))
    found = saq.search(codes, plan, asked(b), 4)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()  # once every pair was a row of a join
    pairs = saq.decode(codes, plan).crossJoin(asked(b).select("qid", v.permute("values", plan.order).alias("q")))
    distance = v.norm2("q") + F.col("norm_sq") - 2 * v.dot("q", "decoded")
    assert rows(found) == rows(knn.ranked(pairs.select("qid", "id", distance.alias("distance")), 4)) == rows(saq.search(codes, plan, asked(b), 4, 2))


def test_split_of_a_large_posting_is_not_quadratic(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(mutations, "farthest_pair", lambda p, f=mutations.farthest_pair: f(p) if len(p) <= 1024 else pytest.fail("all pairs"))
    points = rng.random((3000, 4))
    i, j = mutations.far_pair(points)
    assert ((points[i] - points[j]) ** 2).sum() > 1.5 and mutations.far_pair(np.zeros((2000, 2))) == (0, 1)
