"""Registered queries over the events table as an operation log, and over placements."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quivra.operators import kv, topology
from quivra.sources.folders import new_path
from quivra.sources.keyvalue import KeyValueStore
from quivra.streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SNAPSHOT, BRANCH, FLOOR = 700, 420, 600


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def log(spark: SparkSession, d: str) -> DataFrame:
    """(user_key, seqno, kind, value): errors delete, every 97th event is a range delete over three users, others put."""
    e = spark.read.parquet(f"{d}/events.parquet")
    key = lambda u: F.concat(F.lit("u"), F.lpad(u.cast("string"), 6, "0"))
    kind = F.when(F.col("event_id") % 97 == 0, "rdel").when(F.col("event_type") == "error", "del").otherwise("put")
    value = F.when(kind == "rdel", key(F.col("user_id") + 3)).when(kind == "put", F.col("event_type"))
    return e.select(key(F.col("user_id")).alias("user_key"), (F.col("event_id") + 1).alias("seqno"), kind.alias("kind"), value.alias("value"))


LOG = """o AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS user_key, event_id + 1 AS seqno,
  CASE WHEN event_id % 97 = 0 THEN 'rdel' WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS kind,
  CASE WHEN event_id % 97 = 0 THEN 'u' || lpad(CAST(user_id + 3 AS VARCHAR), 6, '0') WHEN event_type = 'error' THEN NULL ELSE event_type END AS value FROM events)"""


def seen(at: str = "9223372036854775807", log: str = "o") -> str:
    """SQL for what is visible at a sequence number."""
    return f"""SELECT user_key, seqno, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC) AS r FROM {log} WHERE kind <> 'rdel' AND seqno <= {at}) p
WHERE r = 1 AND kind = 'put' AND NOT EXISTS (SELECT 1 FROM {log} t WHERE t.kind = 'rdel' AND t.seqno <= {at} AND t.user_key <= p.user_key AND p.user_key < t.value AND t.seqno >= p.seqno)"""


@query(f"WITH {LOG} {seen()}")
def kv_scan(spark, d):
    return kv.visible(log(spark, d))


@query(f"WITH {LOG} {seen(str(SNAPSHOT))}")
def kv_snapshot_scan(spark, d):
    return kv.scan(log(spark, d), SNAPSHOT)


@query(f"WITH {LOG} {seen(str(BRANCH))}")
def kv_branch_scan(spark, d):
    branches = kv.Branches(head=1000)
    branches.create("feature", BRANCH)
    branches.checkout("feature")
    return kv.scan(log(spark, d), branches.heads["feature"])


@query(f"WITH {LOG} SELECT * FROM ({seen()}) WHERE user_key >= 'u000010' AND user_key < 'u000060'")
def kv_range_scan(spark, d):
    return kv.scan(log(spark, d), None, "u000010", "u000060")


@query(f"WITH {LOG} SELECT * FROM ({seen(str(SNAPSHOT))}) WHERE user_key = 'u000007'")
def kv_get(spark, d):
    return kv.get(log(spark, d), "u000007", SNAPSHOT)


KEYS = [(i, f"u{k:06d}") for i, k in enumerate((5, 3, 999999, 8, 5, 21))]


@query(f"WITH {LOG}, keys AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}')" for i, k in KEYS)}) t(pos, user_key)) SELECT CAST(keys.pos AS BIGINT) AS pos, keys.user_key, s.value FROM keys LEFT JOIN ({seen()}) s ON keys.user_key = s.user_key")
def kv_multi_get(spark, d):
    return kv.multi_get(log(spark, d), spark.createDataFrame(KEYS, "pos long, user_key string"))


@query(f"WITH {LOG} SELECT user_key, count(*) AS hidden FROM o p WHERE kind = 'put' AND EXISTS (SELECT 1 FROM o t WHERE t.kind = 'rdel' AND t.user_key <= p.user_key AND p.user_key < t.value AND t.seqno >= p.seqno) GROUP BY user_key")
def kv_range_delete(spark, d):
    rows = log(spark, d)
    puts = rows.filter("kind = 'put'")
    left = kv._hide(puts, rows.filter("kind = 'rdel'"))
    both = puts.groupBy("user_key").agg(F.count("*").alias("n")).join(left.groupBy("user_key").agg(F.count("*").alias("m")), "user_key", "left")
    return both.select("user_key", (F.col("n") - F.coalesce("m", F.lit(0))).alias("hidden")).filter("hidden > 0")


KEPT = f"""newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC) AS r FROM o WHERE kind <> 'rdel' AND seqno < {FLOOR}) p WHERE r = 1 AND kind <> 'del'
  AND NOT EXISTS (SELECT 1 FROM o t WHERE t.kind = 'rdel' AND t.seqno < {FLOOR} AND t.user_key <= p.user_key AND p.user_key < t.value AND t.seqno >= p.seqno))"""


@query(f"WITH {LOG}, {KEPT} SELECT user_key, seqno, kind, value FROM o WHERE seqno >= {FLOOR} UNION ALL SELECT user_key, seqno, kind, value FROM newest")
def kv_compaction(spark, d):
    return kv.compact(log(spark, d), FLOOR)


@query(f"WITH {LOG} SELECT least((SELECT max(seqno) FROM o), {SNAPSHOT}, {BRANCH}) AS floor")
def kv_retention_floor(spark, d):
    last = log(spark, d).agg(F.max("seqno")).first()[0]
    return spark.createDataFrame([(kv.retention_floor(last, [SNAPSHOT], [last, BRANCH]),)], "floor long")


@query(f"WITH {LOG} SELECT user_key, CAST({BRANCH} AS BIGINT) AS seqno, 'put' AS kind, value FROM ({seen(str(BRANCH))})")
def kv_archive(spark, d):
    return kv.archive(log(spark, d), BRANCH)


# ---- the stored log: files with key ranges in levels


def stored(spark, d) -> tuple[KeyValueStore, str]:
    """The log written in two batches with a snapshot between them, and compacted."""
    store = KeyValueStore(spark, new_path(spark, "log"), file_rows=2000, l0_files=2)
    ops = log(spark, d).selectExpr("seqno as pos", "kind", "cast(user_key as binary) user_key", "cast(value as binary) value")
    store.write(ops.filter(F.col("pos") <= SNAPSHOT))
    name = store.snapshot()
    store.write(ops.filter(F.col("pos") > SNAPSHOT))
    store.auto_compact()
    return store, name


def plain(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_key").cast("string").alias("user_key"), "seqno", F.col("value").cast("string").alias("value"))


@query(f"WITH {LOG} {seen()}")
def kv_store_scan(spark, d):
    return plain(stored(spark, d)[0].scan())


@query(f"WITH {LOG} {seen(str(SNAPSHOT))}")
def kv_store_snapshot(spark, d):
    store, name = stored(spark, d)
    return plain(store.scan(snapshot=name))


@query(f"WITH {LOG} SELECT * FROM ({seen()}) WHERE user_key LIKE 'u00000%'")
def kv_store_prefix(spark, d):
    return plain(stored(spark, d)[0].scan_prefix(b"u00000"))


@query(f"WITH {LOG} SELECT * FROM ({seen()}) WHERE user_key >= 'u000020' ORDER BY user_key LIMIT 5")
def kv_store_seek(spark, d):
    return plain(stored(spark, d)[0].seek(b"u000020", 5))


@query(f"WITH {LOG} SELECT * FROM ({seen(str(SNAPSHOT))}) WHERE user_key = 'u000007'")
def kv_store_get(spark, d):
    store, name = stored(spark, d)
    return plain(store.get(b"u000007", snapshot=name))


@query("SELECT CAST(count(*) AS BIGINT) AS entries, CAST(0 AS BIGINT) AS bad FROM events")
def kv_store_scrub(spark, d):
    """Of files as written: every entry read and held against its file's record."""
    store = KeyValueStore(spark, new_path(spark, "log"), file_rows=2000)
    store.write(log(spark, d).selectExpr("seqno as pos", "kind", "cast(user_key as binary) user_key", "cast(value as binary) value"))
    return store.scrub().agg(F.sum("entries").cast("long").alias("entries"), F.count_if(~F.col("ok")).alias("bad"))


@query(f"WITH {LOG} {seen()}")
def kv_store_tiers(spark, d):
    """After half of the bytes went to the cold tier and the deepest level was frozen and thawed."""
    store, _ = stored(spark, d)
    store.rebalance(sum(r["size_bytes"] for r in store.catalog["files"].values()) // 2)
    store.thaw(store.freeze(max(r["level"] for r in store.catalog["files"].values())))
    return plain(store.scan())


INGESTED = "o2 AS (SELECT * FROM o UNION ALL SELECT 'u' || lpad(CAST(vec_id AS VARCHAR), 6, '0'), vec_id * 3, 'put', 'ingested' FROM embeddings)"


@query(f"WITH {LOG}, {INGESTED} {seen(log='o2')}")
def kv_ingest(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    table = e.select(F.concat(F.lit("u"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("user_key"), (F.col("vec_id") * 3).alias("seqno"), F.lit("put").alias("kind"), F.lit("ingested").alias("value"))
    # at equal sequence numbers of one key the log's entry and the table's would tie
    rows = log(spark, d)
    return kv.visible(kv.ingest(rows, table.join(rows.select("user_key", "seqno"), ["user_key", "seqno"], "left_anti")))


ORACLES["kv_ingest"] = ORACLES["kv_ingest"].replace("FROM embeddings)", "FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.seqno = e.vec_id * 3 AND o.user_key = 'u' || lpad(CAST(e.vec_id AS VARCHAR), 6, '0')))")

FILES = f"""f0 AS (SELECT CAST(floor(seqno / 100.0) AS BIGINT) AS file_id, min(user_key) AS smallest, max(user_key) AS largest, max(seqno) AS max_seqno, count(*) AS entries,
  CAST(sum(length(user_key) + coalesce(length(value), 0) + 9) AS BIGINT) AS size_bytes FROM o GROUP BY 1),
f AS (SELECT *, CASE WHEN file_id > (SELECT max(file_id) FROM f0) - 4 THEN 0 ELSE 1 END AS level FROM f0),
ov AS (SELECT a.level, CAST(sum(least(a.size_bytes, b.size_bytes)) AS BIGINT) AS overlap_bytes FROM f a JOIN f b ON a.level = b.level AND a.file_id < b.file_id AND a.smallest <= b.largest AND b.smallest <= a.largest GROUP BY a.level),
me AS (SELECT f.level, count(*) AS files, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(size_bytes) AS BIGINT) AS bytes, coalesce(max(overlap_bytes), 0) AS overlap_bytes FROM f LEFT JOIN ov ON f.level = ov.level GROUP BY f.level),
sc AS (SELECT level, CASE WHEN level = 0 THEN greatest(files / 4.0, bytes / 268435456.0) ELSE bytes / 1048576.0 + overlap_bytes / CAST(greatest(bytes, 1) AS DOUBLE) END AS score FROM me)"""


def table(spark, d):
    return kv.files(log(spark, d), 100)


@query(f"WITH {LOG}, {FILES} SELECT file_id, level, smallest, largest, max_seqno, entries, size_bytes FROM f")
def file_catalog(spark, d):
    return table(spark, d).select("file_id", "level", "smallest", "largest", "max_seqno", "entries", "size_bytes")


@query(f"WITH {LOG}, {FILES} SELECT * FROM me")
def level_metrics(spark, d):
    return kv.level_metrics(table(spark, d))


@query(f"WITH {LOG}, {FILES} SELECT * FROM ov")
def overlap_bytes(spark, d):
    return kv.overlap_bytes(table(spark, d))


@query(f"WITH {LOG}, {FILES} SELECT level, round(score, 6) AS score FROM sc")
def compaction_score(spark, d):
    return kv.compaction_scores(kv.level_metrics(table(spark, d))).select("level", F.round("score", 6).alias("score"))


@query(f"WITH {LOG}, {FILES} SELECT level, round(score, 6) AS score FROM sc WHERE score >= 1 ORDER BY score DESC, level LIMIT 1")
def compaction_candidate(spark, d):
    return kv.compaction_candidate(kv.compaction_scores(kv.level_metrics(table(spark, d)))).select("level", F.round("score", 6).alias("score"))


@query(f"WITH {LOG}, {FILES} SELECT file_id FROM f WHERE file_id % 3 = 1")
def orphan_files(spark, d):
    files = table(spark, d)
    return kv.orphans(files.select("file_id"), files.filter("file_id % 3 != 1"))


@query(f"WITH {LOG}, {FILES} SELECT level, count(*) AS files, CAST(sum(entries) AS BIGINT) AS entries FROM f GROUP BY level")
def scrub_report(spark, d):
    return kv.scrub(table(spark, d))


@query(f"WITH {LOG}, {FILES} SELECT file_id, 'sequence number' AS problem FROM f WHERE file_id = 2 UNION ALL SELECT 999999, 'missing file'")
def catalog_audit(spark, d):
    files = table(spark, d)
    wrong = files.withColumn("max_seqno", F.when(F.col("file_id") == 2, -1).otherwise(F.col("max_seqno")))
    extra = files.filter("file_id = 0").withColumn("file_id", F.lit(999999).cast("long"))
    return kv.audit(wrong.unionByName(extra), log(spark, d), 100)


STATS = "s AS (SELECT user_id AS part, count(*) FILTER (event_type <> 'error') AS upserts, count(*) FILTER (event_type = 'error') AS deletes, min(event_id) AS first_seq, max(event_id) + 1 AS next_seq, max(user_id % 5) AS term FROM events GROUP BY user_id)"


@query(f"WITH {STATS} SELECT CAST(sum(upserts) AS BIGINT) AS upserts, CAST(sum(deletes) AS BIGINT) AS deletes, min(first_seq) AS first_seq, max(next_seq) AS next_seq, max(term) AS term FROM s")
def stats_rollup(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    per = e.groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("upserts"), F.count_if(F.col("event_type") == "error").alias("deletes"), F.min("event_id").alias("first_seq"), (F.max("event_id") + 1).alias("next_seq"), F.max(F.col("user_id") % 5).alias("term"))
    return topology.stats_rollup(per)


NODES, PARTITIONS, REPLICAS = [f"node-{i}:7000" for i in range(5)], 64, 3
_SCORES = ", ".join(f"({p}, '{n}', {zlib.crc32(f'a:{p}:{n}'.encode())}, {zlib.crc32(f'b:{p}:{n}'.encode())})" for p in range(PARTITIONS) for n in NODES)


@query(f"SELECT CAST(p AS BIGINT) AS partition_id, r AS replica_rank, n AS endpoint, r = 1 AS is_leader FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY hi DESC, lo DESC, n) AS r FROM (VALUES {_SCORES}) t(p, n, hi, lo)) WHERE r <= {REPLICAS}")
def topology_placement(spark, d):
    return topology.place(topology.endpoints(spark, [*NODES[::-1], " node-1:7000 "]), PARTITIONS, REPLICAS)


@query("""WITH e AS (SELECT user_id % 4 AS partition, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS seq, 1 + (event_id % 5) // 4 AS term, event_type AS payload FROM events),
m AS (SELECT *, max(term) OVER (PARTITION BY partition ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
f AS (SELECT partition, coalesce(min(seq) FILTER (WHERE term < before), 9000000000) AS bad FROM m GROUP BY partition),
t AS (SELECT e.partition, max(bad) AS bad, max(term) FILTER (WHERE seq < bad) AS top FROM e JOIN f ON e.partition = f.partition GROUP BY e.partition)
SELECT e.partition, seq, term, payload, CASE WHEN seq < bad THEN 'applied' WHEN term < top THEN 'stale term' ELSE 'gap' END AS status FROM e JOIN t ON e.partition = t.partition""")
def replication_fencing(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    numbered = e.selectExpr("user_id % 4 as partition", "row_number() over (partition by user_id % 4 order by event_id) as seq", "1 + (event_id % 5) div 4 as term", "event_type as payload")
    return feed.fenced(numbered.selectExpr("partition", "cast(seq as long) seq", "cast(term as long) term", "payload"))


@query("WITH g AS (SELECT event_id AS seq, event_type AS payload FROM events) SELECT seq, payload FROM g WHERE seq >= 500 ORDER BY seq LIMIT 100")
def log_since(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return feed.since(e, 500, 100)
