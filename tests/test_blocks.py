"""Searches with more queries than a block holds."""

import numpy as np

from quivra.operators import knn, saq, sharded


def made(spark, n, dim, name, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=dim).tolist()) for i in range(n)], f"{name} long, values array<double>")


def test_saq_search_goes_through_blocks(spark):
    rows, asked = made(spark, 60, 4, "id", 1), made(spark, 25, 4, "qid", 2)
    plan = saq.Plan(list(range(4)), saq.uniform_segments(4, 16, 4))
    codes = saq.encode(rows, plan)
    key = lambda found: sorted((r["qid"], r["rank"], r["id"], round(r["distance"], 9)) for r in found.collect())
    whole = key(saq.search(codes, plan, asked, 3))
    assert len(whole) == 75
    for size in (7, 25, 24):
        assert key(saq.search(codes, plan, asked, 3, max_queries=size)) == whole
    assert saq.search(codes, plan, asked.filter("qid < 0"), 3).count() == 0


def test_pruned_search_takes_over_4096_queries(spark):
    rows, asked = made(spark, 30, 2, "id", 3), made(spark, 4100, 2, "qid", 4)
    key = lambda found: sorted((r["qid"], r["rank"], r["id"]) for r in found.collect())
    assert key(sharded.pruned_search(rows, asked, 2, 3)) == key(knn.exact_knn(rows, asked, 2))
