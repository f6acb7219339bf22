"""The stored index against a plain map of its rows."""

import random

import pytest
from pyspark.sql import functions as F

from quivra.operators import knn
from quivra.operators.knn import DimensionError
from quivra.sources.index import StoredIndex

OPS = "pos long, kind string, id long, values array<double>"


def test_random_mutations_against_a_map(spark, tmp_path):
    rng = random.Random(7)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    model = {i: vector() for i in range(120)}
    root = f"file://{tmp_path}/i"
    index = StoredIndex(spark, root, dim=6, cells=4, max_parts=4, split_limit=24, merge_limit=5, scope=4)
    index.build(spark.createDataFrame(list(model.items()), "id long, values array<double>"), 8)
    splits = merges = 0
    for step in range(6):
        ops = []
        for _ in range(50):
            key = rng.randrange(300) if step < 3 else rng.choice(sorted(model))
            if rng.random() < (0.2 if step < 3 else 0.7):
                ops.append(("delete", key, None))
                model.pop(key, None)
            else:
                ops.append(("upsert", key, vector()))
                model[key] = ops[-1][2]
        batch = spark.createDataFrame([(i, *x) for i, x in enumerate(ops)], OPS)
        assert index.apply(batch, ("w", step))["upserts"] == len({k for k in {x[1] for x in ops} if [x[0] for x in ops if x[1] == k][-1] == "upsert"})
        assert index.apply(batch, ("w", step)) == {"upserts": 0, "deletes": 0}
        if step % 2:
            done = index.maintain()
            splits, merges = splits + done["split"], merges + done["merged"]
            index = StoredIndex(spark, root, max_parts=4, split_limit=24, merge_limit=5, scope=4)
        rows = index.members().collect()
        assert {r["id"]: [*r["values"]] for r in rows} == model and len(rows) == len(model)
        lists = index.lists()
        sizes = {r["posting_id"]: r["size"] for r in lists.collect() if r["size"]}
        real = {r["posting_id"]: r["count"] for r in index.members().groupBy("posting_id").count().collect()}
        assert sizes == real
        bad = index.members().join(lists, "posting_id").filter(F.expr("sqrt(aggregate(zip_with(values, centroid, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)) > max_radius + 1e-9"))
        assert bad.isEmpty()
    assert splits and merges and max(sizes.values()) <= 48
    queries = spark.createDataFrame([(q, vector()) for q in range(7)], "qid long, values array<double>")
    base = spark.createDataFrame(list(model.items()), "id long, values array<double>")
    want = [tuple(r) for r in knn.exact_knn(base, queries, 5).orderBy("qid", "rank").collect()]
    assert [tuple(r) for r in index.search_exact(queries, 5).orderBy("qid", "rank").collect()] == want
    assert [tuple(r) for r in index.search(queries, 5, 1000).orderBy("qid", "rank").collect()] == want
    assert index.search(queries, 5, 1).count() <= 35
    some = spark.createDataFrame([(sorted(model)[0],), (9999,)], "id long")
    assert {r["id"]: r["distance"] is None for r in index.distances([0.0] * 6, some).collect()} == {sorted(model)[0]: False, 9999: True}
    assert index.health().first()["members"] == len(model) and index.clean() and index.search_exact(queries, 5).count() == 35
    with pytest.raises(DimensionError):
        index.apply(spark.createDataFrame([(0, "upsert", 1, [1.0])], OPS))


def test_a_search_reads_the_cells_it_probes(spark, tmp_path):
    index = StoredIndex(spark, f"file://{tmp_path}/i", dim=1, cells=8)
    index.build(spark.createDataFrame([(i, [float(i)]) for i in range(64)], "id long, values array<double>"), 8)
    plan = index.members([3])._jdf.queryExecution().executedPlan().toString()
    few = spark.createDataFrame([(0, [3.0])], "qid long, values array<double>")
    assert index.search(few, 2, 2).count() == 2
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:200]
