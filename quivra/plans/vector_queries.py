"""Registered queries over the embeddings table, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quivra.functions import vector as v
from quivra.operators import ivf, knn, mutations, saq, sharded
from quivra.sources.folders import new_path
from quivra.sources.index import StoredIndex
from quivra.sources.store import VectorStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K, POSTINGS, ROUNDS = 10, 16, 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- the tables that all queries share


def base(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))


def asked(rows: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 100 is a query, against all rows."""
    return rows.filter("id % 100 = 0").select(F.col("id").alias("qid"), "values")


def changes(rows: DataFrame) -> DataFrame:
    """(pos, kind, id, values): upserts of every 7th id with its successor's vector, then deletes of every 11th, then upserts of every 77th."""
    size = rows.agg((F.max("id") + 1).alias("n"))
    after = rows.crossJoin(F.broadcast(size)).select(F.pmod(F.col("id") - 1, F.col("n")).alias("id"), "values")
    up = after.filter("id % 7 = 0").select(F.col("id").alias("pos"), F.lit("upsert").alias("kind"), "id", "values")
    gone = rows.filter("id % 11 = 0").select((F.col("id") + 1_000_000).alias("pos"), F.lit("delete").alias("kind"), "id", F.lit(None).cast("array<double>").alias("values"))
    again = rows.filter("id % 77 = 0 and id % 2 = 0").select((F.col("id") + 2_000_000).alias("pos"), F.lit("upsert").alias("kind"), "id", "values")
    return up.unionByName(gone).unionByName(again)


def shown(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", "id", F.round("distance", 6).alias("distance"))


L2 = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


def l2(a: str, b: str) -> str:
    return L2.format(a=a, b=b)


BASE = "b AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT id AS qid, v AS p FROM b WHERE id % 100 = 0)"
CHANGES = """n AS (SELECT max(id) + 1 AS n FROM b),
m AS (SELECT id AS pos, 'upsert' AS kind, id, v FROM (SELECT (b.id - 1 + n.n) % n.n AS id, v FROM b, n) WHERE id % 7 = 0
      UNION ALL SELECT id + 1000000, 'delete', id, NULL FROM b WHERE id % 11 = 0
      UNION ALL SELECT id + 2000000, 'upsert', id, v FROM b WHERE id % 77 = 0 AND id % 2 = 0),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS r FROM m) WHERE r = 1),
live AS (SELECT id, v FROM b WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT id, v FROM w WHERE kind = 'upsert')"""


def top(rows: str, k: int = K) -> str:
    """SQL for the k best of (qid, id, distance)."""
    return f"SELECT qid, CAST(rank AS BIGINT) AS rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM ({rows})) WHERE rank <= {k}"


def all_pairs(table: str = "b") -> str:
    return f"SELECT qid, id, {l2('v', 'p')} AS distance FROM {table}, q"


# ---- exact search


@query(f"WITH {BASE} {top(all_pairs())}")
def exact_knn(spark, d):
    rows = base(spark, d)
    return shown(knn.exact_knn(rows, asked(rows), K))


@query(f"WITH {BASE}, {CHANGES} {top(all_pairs('live'))}")
def exact_knn_after_updates(spark, d):
    rows = base(spark, d)
    return shown(knn.exact_knn(mutations.merge(rows, changes(rows)), asked(rows), K))


@query(f"WITH {BASE} SELECT qid, id, round({l2('v', 'p')}, 6) AS l2, round({DOT.format(a='v', b='p')}, 6) AS dot, round({DOT.format(a='v', b='v')}, 6) AS norm2, round({DOT.format(a='list_transform(v, lambda x: x * 2)', b='p')}, 6) AS scaled FROM b, q")
def vector_functions(spark, d):
    v.register(spark)
    rows = base(spark, d)
    return knn.measures(rows, asked(rows))


# ---- mutations


@query(f"WITH {BASE}, {CHANGES} SELECT id, pos, kind FROM w")
def dedup_last_mutation(spark, d):
    return mutations.last_per_id(changes(base(spark, d))).select("id", "pos", "kind")


@query(f"WITH {BASE}, {CHANGES} SELECT id, min(pos) AS pos FROM m GROUP BY id")
def dedup_ids(spark, d):
    return mutations.first_ids(changes(base(spark, d)))


@query(f"WITH {BASE}, {CHANGES} SELECT id, round({DOT.format(a='v', b='list_transform(range(1, len(v) + 1), lambda i: CAST(i AS DOUBLE))')}, 6) AS mark FROM live")
def upsert_merge(spark, d):
    rows = base(spark, d)
    mark = F.aggregate(F.transform("values", lambda x, i: x * (i + 1).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return mutations.merge(rows, changes(rows)).select("id", F.round(mark, 6).alias("mark"))


@query(f"WITH {BASE}, {CHANGES} SELECT count(*) FILTER (kind = 'upsert') AS upserts, count(*) FILTER (kind = 'delete' AND id IN (SELECT id FROM b)) AS deletes FROM w")
def apply_batch_counts(spark, d):
    rows = base(spark, d)
    return mutations.counts(rows, changes(rows))


@query(f"WITH {BASE}, {CHANGES} SELECT id % 8 AS partition, count(*) AS mutations, min(pos) AS first_pos FROM m GROUP BY id % 8")
def partition_route(spark, d):
    return mutations.routed(changes(base(spark, d)), 8).groupBy("partition").agg(F.count("*").alias("mutations"), F.min("pos").alias("first_pos"))


# ---- clustered lists


def kmeans_sql(postings: int = POSTINGS, rounds: int = ROUNDS) -> str:
    """CTEs c0 .. c{rounds} (cid, c), then the members a and the recomputed centroids p (posting_id, n, c)."""
    ctes = [f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, v AS c FROM b ORDER BY id LIMIT {postings})"]

    def near(name: str, of: str) -> str:
        return f"{name} AS (SELECT cid, id, v, distance FROM (SELECT cid, id, v, distance, row_number() OVER (PARTITION BY id ORDER BY distance, cid) AS r FROM (SELECT cid, id, v, {l2('v', 'c')} AS distance FROM b, {of})) WHERE r = 1)"

    def mean(name: str, of: str) -> str:
        return f"{name} AS (SELECT cid, max(n) AS n, list(x ORDER BY i) AS c FROM (SELECT cid, i, avg(v[i]) AS x, count(*) AS n FROM (SELECT cid, v, unnest(range(1, len(v) + 1)) AS i FROM {of}) GROUP BY cid, i) GROUP BY cid)"

    for r in range(rounds):
        ctes += [near(f"a{r}", f"c{r}"), mean(f"m{r}", f"a{r}"), f"c{r + 1} AS (SELECT c{r}.cid, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.cid = m{r}.cid)"]
    ctes += [near("a", f"c{rounds}"), mean("p", "a")]
    return ", ".join(ctes)


IVF = f"WITH {BASE}, {kmeans_sql()}"


def probed_sql(n: int) -> str:
    return f"SELECT * FROM (SELECT qid, p.cid, q.p AS point, p.c AS c, {l2('p.c', 'q.p')} AS cd, row_number() OVER (PARTITION BY qid ORDER BY {l2('p.c', 'q.p')}, p.cid) AS r FROM q, p) WHERE r <= {n}"


def ivf_sql(n: int, k: int) -> str:
    return f"{IVF}, pr AS ({probed_sql(n)}) {top(f'SELECT qid, id, {l2("v", "point")} AS distance FROM pr JOIN a ON pr.cid = a.cid', k)}"


def lists(spark, d):
    rows = base(spark, d)
    members, centroids = ivf.build(rows, POSTINGS, ROUNDS)
    return rows, members, centroids


@query(f"WITH {BASE}, c AS (SELECT id AS cid, v AS c FROM b WHERE id < 8) SELECT id, cid, round(distance, 6) AS distance FROM (SELECT id, cid, {l2('v', 'c')} AS distance, row_number() OVER (PARTITION BY id ORDER BY {l2('v', 'c')}, cid) AS r FROM b, c) WHERE r = 1")
def nearest_centroid(spark, d):
    rows = base(spark, d)
    return ivf.assign(rows, ivf.kmeans_seeds(rows, 8)).select("id", F.col("posting_id").alias("cid"), F.round("distance", 6).alias("distance"))


@query(f"WITH {BASE}, {kmeans_sql()} SELECT cid, CAST(i - 1 AS INTEGER) AS pos, round(c[i], 6) AS x FROM (SELECT cid, c, unnest(range(1, len(c) + 1)) AS i FROM c{ROUNDS})")
def kmeans_2iter(spark, d):
    centroids = ivf.kmeans(base(spark, d), POSTINGS, ROUNDS)
    table = spark.createDataFrame([(c, [float(x) for x in row]) for c, row in enumerate(centroids)], "cid long, c array<double>")
    return table.select("cid", F.posexplode("c").alias("pos", "x")).select("cid", "pos", F.round("x", 6).alias("x"))


@query(f"{IVF} SELECT cid AS posting_id, count(*) AS size, round(max(sqrt({l2('v', 'c')})), 6) AS max_radius, round(max(sqrt({DOT.format(a='v', b='v')})), 6) AS max_l2_norm FROM (SELECT a.cid, a.v, p.c FROM a JOIN p ON a.cid = p.cid) GROUP BY cid")
def posting_stats(spark, d):
    _, members, centroids = lists(spark, d)
    return ivf.posting_stats(members, centroids).select("posting_id", "size", F.round("max_radius", 6).alias("max_radius"), F.round("max_l2_norm", 6).alias("max_l2_norm"))


@query(ivf_sql(4, K))
def ivf_append_only_search(spark, d):
    rows, members, centroids = lists(spark, d)
    return shown(ivf.search(members, centroids, asked(rows), K, ivf.probes_append_only(4, K, len(centroids))))


@query(f"{IVF}, pr AS ({probed_sql(4)}), e AS ({top(all_pairs())}), found AS ({top(f'SELECT qid, id, {l2("v", "point")} AS distance FROM pr JOIN a ON pr.cid = a.cid')}) SELECT e.qid, round(avg(CASE WHEN f.id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM e LEFT JOIN found f ON e.qid = f.qid AND e.id = f.id GROUP BY e.qid")
def recall_at_k(spark, d):
    """Of the index over all rows, at four probes."""
    rows, members, centroids = lists(spark, d)
    found = ivf.search(members, centroids, asked(rows), K, ivf.probes_append_only(4, K, len(centroids)))
    return knn.recall_at_k(found, knn.exact_knn(rows, asked(rows), K), K).select("qid", F.round("recall", 6).alias("recall"))


@query(ivf_sql(8, 1))
def ivf_resident_search(spark, d):
    rows, members, centroids = lists(spark, d)
    return shown(ivf.search(members, centroids, asked(rows), 1, ivf.probes_resident(1, 1, len(centroids))))


@query(ivf_sql(8, 3))
def ivf_diskmeta_search(spark, d):
    rows, members, centroids = lists(spark, d)
    stats = ivf.posting_stats(members, centroids)
    return shown(ivf.pruned_search(members, centroids, stats, asked(rows), 3, ivf.probes_diskmeta(4, 3, len(centroids), multiplier=2)))


@query(f"""{IVF}, st AS (SELECT cid, max(sqrt({l2('v', 'c')})) AS radius, max(sqrt({DOT.format(a='v', b='v')})) AS norm FROM (SELECT a.cid, a.v, p.c FROM a JOIN p ON a.cid = p.cid) GROUP BY cid), pr AS ({probed_sql(8)}),
x AS (SELECT qid, pr.cid AS posting_id, sqrt({DOT.format(a='point', b='point')}) AS qn, cd, radius, norm FROM pr JOIN st ON pr.cid = st.cid)
SELECT qid, posting_id, round(greatest(power(greatest(sqrt(cd) - radius, 0), 2), power(greatest(qn - norm, 0), 2)), 6) AS lower_bound FROM x""")
def lower_bounds(spark, d):
    rows, members, centroids = lists(spark, d)
    found = ivf.bounded_probes(asked(rows), centroids, ivf.posting_stats(members, centroids), 8)
    return found.select("qid", "posting_id", F.round("lower_bound", 6).alias("lower_bound"))


def coarse_sql() -> str:
    k = 2
    ctes = ["s0 AS (SELECT k, c AS s FROM (SELECT row_number() OVER (ORDER BY cid) - 1 AS k, c FROM p) WHERE k < (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) FROM p))"]
    for r in range(k + 1):
        ctes.append(f"t{r} AS (SELECT cid, c, k FROM (SELECT cid, c, k, row_number() OVER (PARTITION BY cid ORDER BY {l2('c', 's')}, k) AS r FROM p, s{r}) WHERE r = 1)")
        if r < k:
            ctes.append(f"u{r} AS (SELECT k, list(x ORDER BY i) AS s FROM (SELECT k, i, avg(c[i]) AS x FROM (SELECT k, c, unnest(range(1, len(c) + 1)) AS i FROM t{r}) GROUP BY k, i) GROUP BY k)")
            ctes.append(f"s{r + 1} AS (SELECT s{r}.k, coalesce(u{r}.s, s{r}.s) AS s FROM s{r} LEFT JOIN u{r} ON s{r}.k = u{r}.k)")
    return f"{IVF}, {', '.join(ctes)} SELECT cid AS posting_id, k AS coarse_id FROM t{k}"


@query(coarse_sql())
def coarse_assign(spark, d):
    _, _, centroids = lists(spark, d)
    _, cell_of = ivf.coarse_layer(centroids, 2)
    return spark.createDataFrame([(int(p), int(c)) for p, c in cell_of.items()], "posting_id long, coarse_id long")


@query(f"WITH {BASE}, x AS (SELECT b.id, {l2('b.v', 'c0.v')} - {l2('b.v', 'c1.v')} AS lean FROM b, (SELECT v FROM b WHERE id = 0) c0, (SELECT v FROM b WHERE id = 1) c1) SELECT id, CASE WHEN row_number() OVER (ORDER BY lean, id) <= ceil(count(*) OVER () / 2.0) THEN 0 ELSE 1 END AS side FROM x")
def balanced_partition(spark, d):
    rows = base(spark, d)
    first, second = (F.array(*[F.lit(float(x)) for x in r["values"]]) for r in rows.filter("id < 2").orderBy("id").collect())
    leaning = rows.select("id", (v.squared_l2("values", first) - v.squared_l2("values", second)).alias("lean"))
    half = Window.orderBy("lean", "id")
    return leaning.select("id", F.when(F.row_number().over(half) <= F.ceil(F.count("*").over(Window.partitionBy()) / 2), 0).otherwise(1).alias("side"))


@query(f"{IVF}, x AS (SELECT p.cid, p.id AS i, r.id AS j, {l2('p.v', 'r.v')} AS distance FROM a p JOIN a r ON p.cid = r.cid AND p.id < r.id) SELECT cid AS posting_id, i, j, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY distance DESC, i, j) AS k FROM x) WHERE k = 1")
def farthest_pair(spark, d):
    import numpy as np
    import pandas as pd

    def far(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        points, ids = np.array([np.asarray(x, float) for x in group["values"]]), group["id"].to_numpy()
        if len(ids) < 2:
            return pd.DataFrame({"posting_id": [], "i": [], "j": [], "distance": []})
        i, j = mutations.farthest_pair(points)
        return pd.DataFrame({"posting_id": [group["posting_id"].iloc[0]], "i": [ids[i]], "j": [ids[j]], "distance": [round(float(((points[i] - points[j]) ** 2).sum()), 6)]})

    _, members, _ = lists(spark, d)
    return members.groupBy("posting_id").applyInPandas(far, "posting_id long, i long, j long, distance double")


# ---- maintenance: further invariants are tested


@query(f"""{IVF.replace("WITH ", "WITH RECURSIVE ", 1)}, h AS (SELECT cid, '' AS path, n FROM p WHERE n > 24 UNION ALL SELECT cid, path || s, CASE s WHEN '0' THEN (n + 1) // 2 ELSE n // 2 END FROM h, (VALUES ('0'), ('1')) t(s) WHERE n > 24)
SELECT cid AS posting_id, n AS size FROM p WHERE n <= 24 UNION ALL SELECT (SELECT max(cid) FROM p) + row_number() OVER (ORDER BY cid, path), n FROM h WHERE n <= 24""")
def split_postings(spark, d):
    _, members, _ = lists(spark, d)
    return mutations.split(members, 24).groupBy("posting_id").agg(F.count("*").alias("size"))


@query()
def lire_reassign(spark, d):
    _, members, centroids = lists(spark, d)
    large = members.groupBy("posting_id").count().orderBy(F.desc("count"), "posting_id").first()["posting_id"]
    rest = members.filter(F.col("posting_id") != large)
    halves = mutations.split(members.filter(F.col("posting_id") == large), 4, 2)
    side = halves.select(F.when(F.col("posting_id") % 2 == 0, 1000).otherwise(1001).cast("long").alias("posting_id"), "id", "values")
    after = rest.unionByName(side)
    fresh = {int(r["posting_id"]): r["centroid"] for r in ivf.means(after).toLocalIterator()}
    import numpy as np

    fresh = {p: np.array(c) for p, c in fresh.items()}
    moved = mutations.lire_reassign(after, fresh, centroids[large], (1000, 1001), 4)
    return moved.groupBy("posting_id").agg(F.count("*").alias("size"))


@query(f"""{IVF}, rest AS (SELECT cid, c FROM p WHERE n >= 20), gone AS (SELECT a.id, a.v FROM a JOIN p ON a.cid = p.cid WHERE p.n < 20),
moved AS (SELECT cid FROM (SELECT id, cid, row_number() OVER (PARTITION BY id ORDER BY {l2('v', 'c')}, cid) AS r FROM gone, rest) WHERE r = 1)
SELECT cid AS posting_id, count(*) AS size FROM (SELECT a.cid FROM a JOIN rest ON a.cid = rest.cid UNION ALL SELECT cid FROM moved) GROUP BY cid""")
def merge_postings(spark, d):
    _, members, centroids = lists(spark, d)
    return mutations.merge_small(members, centroids, 20).groupBy("posting_id").agg(F.count("*").alias("size"))


# ---- the stored index and the stored rows


def stored_index(spark, d) -> StoredIndex:
    """Built over all rows, then changed by the batch and maintained."""
    rows = base(spark, d)
    index = StoredIndex(spark, new_path(spark, "index"), dim=64, cells=8, split_limit=64, merge_limit=8)
    index.build(rows, POSTINGS, ROUNDS)
    index.apply(changes(rows), ("changes", 1))
    index.maintain()
    return index


@query(f"WITH {BASE}, {CHANGES} {top(all_pairs('live'))}")
def index_search_after_updates(spark, d):
    return shown(stored_index(spark, d).search_exact(asked(base(spark, d)), K))


@query(f"WITH {BASE}, {CHANGES} SELECT b.id, round({l2('live.v', 'z.v')}, 6) AS distance FROM b LEFT JOIN live ON b.id = live.id, (SELECT v FROM b WHERE id = 0) z")
def index_distances(spark, d):
    rows = base(spark, d)
    point = [float(x) for x in rows.filter("id = 0").first()["values"]]
    return stored_index(spark, d).distances(point, rows.select("id")).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {BASE}, {CHANGES} SELECT count(*) AS members, CAST(1 AS BIGINT) AS commits FROM live")
def index_members(spark, d):
    index = stored_index(spark, d)
    return index.members().agg(F.count("*").alias("members"), F.count_distinct("id").alias("ids"), F.lit(index.catalog["applied"]["changes"]).cast("long").alias("commits")).filter("members = ids").drop("ids")


@query(f"WITH {BASE}, {CHANGES} SELECT id, round({DOT.format(a='v', b='v')}, 4) AS norm2 FROM live")
def vector_store_after_updates(spark, d):
    rows = base(spark, d)
    store = VectorStore(spark, new_path(spark, "rows"), dim=64, shards=4)
    store.bulk_load(rows)
    store.apply(changes(rows), ("changes", 1))
    return store.read().select("id", F.round(v.norm2("values"), 4).alias("norm2"))


EVENTS = "ev AS (SELECT vec_id AS seq, label AS posting_id, vec_id % 50 AS id, vec_id % 7 = 3 AS tombstone FROM embeddings)"


@query(f"WITH {EVENTS} SELECT CAST(posting_id AS BIGINT) AS posting_id, id FROM (SELECT *, row_number() OVER (PARTITION BY posting_id, id ORDER BY seq DESC) AS r FROM ev) WHERE r = 1 AND NOT tombstone")
def posting_members_replay(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    events = rows.select(F.col("vec_id").alias("seq"), F.col("label").cast("long").alias("posting_id"), (F.col("vec_id") % 50).alias("id"), (F.col("vec_id") % 7 == 3).alias("tombstone"))
    return mutations.replay_members(events)


# ---- shards


@query(ORACLES["exact_knn"])
def shard_search(spark, d):
    rows = base(spark, d)
    return shown(sharded.search(rows, asked(rows), K, 4))


@query(ORACLES["exact_knn"])
def shard_pruned_search(spark, d):
    rows = base(spark, d)
    return shown(sharded.pruned_search(rows, asked(rows), K, 4))


@query("SELECT vec_id % 8 AS shard, count(*) AS n FROM embeddings GROUP BY vec_id % 8")
def shard_load(spark, d):
    return sharded.sharded(base(spark, d), 8).groupBy("shard").agg(F.count("*").alias("n"))


# ---- scalar quantisation


VAR = f"{BASE}, f AS (SELECT i, v[i] AS x FROM (SELECT v, unnest(range(1, len(v) + 1)) AS i FROM b)), var AS (SELECT i - 1 AS pos, greatest(var_samp(x), 1e-9) AS variance FROM f GROUP BY i)"
UNIFORM_BITS = 4
CODES = f"""e AS (SELECT id, v, greatest(list_max(list_transform(v, lambda x: abs(x))), 1e-9) AS top FROM b),
k AS (SELECT id, v, top, list_transform(v, lambda x: greatest(0.0, least({2**UNIFORM_BITS - 1}.0, floor((x + top) / (2 * top / {2**UNIFORM_BITS}.0))))) AS code, {DOT.format(a='v', b='v')} AS nn FROM e),
g AS (SELECT id, v, nn, list_transform(code, lambda c: 2 * top / {2**UNIFORM_BITS}.0 * (c + 0.5) - top) AS r, code FROM k)"""


def uniform_plan(rows: DataFrame) -> saq.Plan:
    dim = rows.select(F.size("values")).first()[0]
    return saq.Plan(list(range(dim)), saq.uniform_segments(dim, UNIFORM_BITS * dim, 4))


@query(f"WITH {VAR} SELECT CAST(pos AS INTEGER) AS pos, round(variance, 9) AS variance FROM var")
def dim_variances(spark, d):
    return saq.dimension_variances(base(spark, d)).select("pos", F.round("variance", 9).alias("variance"))


@query(f"WITH {VAR} SELECT CAST(pos AS INTEGER) AS pos, row_number() OVER (ORDER BY variance DESC, pos) AS place FROM var")
def dim_order(spark, d):
    order = Window.orderBy(F.desc("variance"), "pos")
    return saq.dimension_variances(base(spark, d)).select("pos", F.row_number().over(order).cast("long").alias("place"))


@query(f"WITH {BASE}, {CODES} SELECT id, CAST(i - 1 AS INTEGER) AS pos, CAST(code[i] AS INTEGER) AS code FROM (SELECT id, code, unnest(range(1, len(code) + 1)) AS i FROM g)")
def saq_uniform_encode(spark, d):
    rows = base(spark, d)
    return saq.encode(rows, uniform_plan(rows)).select("id", F.posexplode("codes").alias("pos", "code"))


@query(f"WITH {BASE}, {CODES} {top('SELECT qid, id, ' + DOT.format(a='p', b='p') + ' + nn - 2 * ' + DOT.format(a='p', b='r') + ' AS distance FROM g, q')}")
def saq_uniform_search(spark, d):
    rows = base(spark, d)
    plan = uniform_plan(rows)
    return shown(saq.search(saq.encode(rows, plan), plan, asked(rows), K))


@query(f"WITH {BASE}, {CODES} SELECT round(avg({l2('v', 'r')} / len(v)), 9) AS mse FROM g")
def quantization_mse(spark, d):
    rows = base(spark, d)
    plan = uniform_plan(rows)
    return saq.quantization_mse(rows, saq.encode(rows, plan), plan).select(F.round("mse", 9).alias("mse"))


@query()
def saq_joint_search(spark, d):
    rows = base(spark, d)
    plan = saq.train(rows, UNIFORM_BITS * 64)
    codes = saq.refine(rows, saq.encode(rows, plan), plan)
    return shown(saq.search(codes, plan, asked(rows), K))
