from quivra.llm import sharding


def test_written_shards_of_a_repeated_id_meet_the_limit(spark, tmp_path):
    rows = [(7, f"text number {i:03d}") for i in range(60)] + [(7, "the same text")] * 50 + [(i, "x" * 15) for i in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    listed = {(f"s{r['shard']}-{r['page']}"): (r["rows"], r["bytes"]) for r in sharding.write_shards(df, f"file://{tmp_path}/s", 100).collect()}
    found = spark.read.option("recursiveFileLookup", "false").schema("doc_id long, text string, __shard string").parquet(f"file://{tmp_path}/s").collect()
    held = {}
    for r in found:
        n, size = held.get(r["__shard"], (0, 0))
        held[r["__shard"]] = n + 1, size + len(r["text"])
    assert held == listed and max(size for _, size in held.values()) <= 100
    assert sorted((r["doc_id"], r["text"]) for r in found) == sorted(rows)
