"""A stored key/value log: sorted files with key ranges in levels and tiers, under numbered catalogs.

Each file has a record in the catalog: level, tier, least and greatest key (a range delete reaches to its end), greatest sequence number,
rows, bytes and a checksum of its rows. Reads open only files whose keys can matter. The catalog is one entry a file, on the driver,
as any manifest; rows never are."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quivra.operators import kv
from quivra.sources.store import Catalogs, ConflictError, Files

SCHEMA = "user_key binary, seqno long, kind string, value binary"
TIERS = ("hot", "cold", "frozen")


class KeyValueStore:
    def __init__(self, spark: SparkSession, root: str, file_rows: int = 1_000_000, l0_files: int = 4, l0_bytes: int = 256 << 20, level_bytes: int = 1 << 30):
        self.spark, self.files = spark, Files(spark, root)
        self.catalogs = Catalogs(self.files)
        self.file_rows, self.limits = file_rows, {"l0_files": l0_files, "l0_bytes": l0_bytes, "level_bytes": level_bytes}
        self.catalog = self.catalogs.latest() or {"generation": -1, "files": {}, "last": 0, "snapshots": {}, "heads": {"main": 0}, "current": "main", "archives": {}}

    def _save(self, **more) -> None:
        """Commits; raises ConflictError, and takes up what is committed, if another writer was first."""
        new = {**self.catalog, **more, "generation": self.catalog["generation"] + 1}
        try:
            self.catalogs.commit(new)
        except ConflictError:
            self.catalog = self.catalogs.latest()
            raise
        self.catalog = new

    # ---- files

    def _path(self, name: str) -> str:
        return f"{self.files.root}/{self.catalog['files'][name]['tier']}/{name}"

    def rows(self, names: list[str] | None = None) -> DataFrame:
        """The entries of some files, of all by default."""
        names = list(self.catalog["files"]) if names is None else names
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*self._paths(names))

    def _paths(self, names: list[str]) -> list[str]:
        """What to read for some files: a folder where they are all of its files, so that Spark lists it once and not file by file."""
        folders: dict[str, set[str]] = {}
        for x in names:
            folder, name = self._path(x).rsplit("/", 1)
            folders.setdefault(folder, set()).add(name)
        jvm, out = self.files.jvm, []
        for folder, chosen in folders.items():
            there = set()
            if len(chosen) > 1:
                found = self.files.fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet"))
                # all names in one string: a call for each would take longer than the read
                text = jvm.org.apache.commons.lang3.ArrayUtils.toString(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))[1:-1]
                there = {p.rsplit("/", 1)[-1] for p in text.split(",")}
            out += [folder] if there == chosen else [f"{folder}/{x}" for x in sorted(chosen)]
        return out

    def overlapping(self, start: bytes | None = None, end: bytes | None = None, names: list[str] | None = None) -> list[str]:
        """Files whose keys can be from start to end (both included)."""
        found = self.catalog["files"] if names is None else {x: self.catalog["files"][x] for x in names}
        return [x for x, r in found.items() if (end is None or bytes.fromhex(r["smallest"]) <= end) and (start is None or start <= bytes.fromhex(r["largest"]))]

    @staticmethod
    def _summary(rows: DataFrame, *by) -> DataFrame:
        """Records of rows by file: key range, sequence numbers, rows, bytes and a checksum that does not depend on order."""
        reach = F.when(F.col("kind") == "rdel", F.col("value")).otherwise(F.col("user_key"))
        size = F.length("user_key") + F.coalesce(F.length("value"), F.lit(0)) + 9
        return rows.groupBy(*by).agg(
            F.hex(F.min("user_key")).alias("smallest"), F.hex(F.max(reach)).alias("largest"), F.max("seqno").alias("max_seqno"), F.count("*").alias("entries"), F.sum(size).cast("long").alias("size_bytes"),
            F.sum(F.xxhash64("user_key", "seqno", "kind", "value").cast("decimal(38,0)")).cast("string").alias("checksum"),
        )

    def _file_of(self, paths: list[str]) -> DataFrame:
        read = self.spark.read.schema(SCHEMA).parquet(*paths)
        return read.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1).alias("file"))

    def _write(self, rows: DataFrame, level: int) -> dict[str, dict]:
        """Sorted files of about file_rows rows; records of them, which no catalog names yet."""
        folder = f"part-{uuid.uuid4().hex}"
        dealt = rows.select("user_key", "seqno", "kind", "value").repartitionByRange("user_key").sortWithinPartitions("user_key", F.desc("seqno"))
        dealt.write.option("maxRecordsPerFile", self.file_rows).parquet(f"{self.files.root}/hot/{folder}")
        found = self._summary(self._file_of([f"{self.files.root}/hot/{folder}"]), "file").toLocalIterator()
        return {r["file"]: {**{k: r[k] for k in ("smallest", "largest", "max_seqno", "entries", "size_bytes", "checksum")}, "level": level, "tier": "hot"} for r in found}

    def table(self) -> DataFrame:
        """(file_id, level, tier, smallest, largest, max_seqno, entries, size_bytes): the catalog's records."""
        rows = [(x, r["level"], r["tier"], bytearray.fromhex(r["smallest"]), bytearray.fromhex(r["largest"]), r["max_seqno"], r["entries"], r["size_bytes"]) for x, r in self.catalog["files"].items()]
        return self.spark.createDataFrame(rows, "file_id string, level int, tier string, smallest binary, largest binary, max_seqno long, entries long, size_bytes long")

    # ---- writes

    def write(self, ops: DataFrame) -> int:
        """One atomic batch of ops(pos, kind, user_key, value): consecutive sequence numbers in the order of pos (unique); moves the current branch."""
        kv.check_ops(ops)
        dealt = ops.repartitionByRange("pos").withColumn("__part", F.spark_partition_id())
        # numbers before each range of positions: one row a range
        folder = f"{self.files.root}/staged-{uuid.uuid4().hex}"
        dealt.write.parquet(folder)
        staged = self.spark.read.schema(dealt.schema).parquet(folder)
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        from_ = staged.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__from"))
        number = F.row_number().over(Window.partitionBy("__part").orderBy("pos")) + F.col("__from") + self.catalog["last"]
        rows = staged.join(from_, "__part").select(F.col("user_key").cast("binary"), number.cast("long").alias("seqno"), "kind", F.col("value").cast("binary"))
        n = staged.count()
        try:
            return self._appended(rows, n) if n else self.catalog["last"]
        finally:
            self.files.delete(folder.rsplit("/", 1)[-1])

    def write_batch(self, ops: list[tuple[str, bytes, bytes | None]]) -> int:
        """The same for a few ops (kind, key, value)."""
        rows = [(i, kind, bytearray(key), None if value is None else bytearray(value)) for i, (kind, key, value) in enumerate(ops)]
        return self.write(self.spark.createDataFrame(rows, "pos long, kind string, user_key binary, value binary"))

    def _appended(self, rows: DataFrame, numbers: int) -> int:
        new, last = self._write(rows, 0), self.catalog["last"] + numbers
        self._save(files={**self.catalog["files"], **new}, last=last, heads={**self.catalog["heads"], self.catalog["current"]: last})
        return last

    def ingest(self, table: DataFrame) -> int:
        """A foreign table (user_key, kind, value) as one commit: all its entries get the next sequence number, so they are newer than what is
        there; keys must be unique in it, and it must not be empty."""
        if table.isEmpty():
            raise ValueError("an empty table can't be ingested")
        if not table.groupBy("user_key").count().filter("count > 1").isEmpty():
            raise ValueError("a table to ingest has each key once")
        kv.check_ops(table)
        return self._appended(table.select(F.col("user_key").cast("binary"), F.lit(self.catalog["last"] + 1).alias("seqno"), "kind", F.col("value").cast("binary")), 1)

    # ---- reads

    def head(self, branch: str | None = None) -> int:
        return self.catalog["heads"][branch or self.catalog["current"]]

    def _at(self, branch: str | None, snapshot: str | None) -> int:
        return self.catalog["snapshots"][snapshot] if snapshot else self.head(branch)

    def scan(self, branch: str | None = None, snapshot: str | None = None, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """Visible rows of [start, end), from the files that overlap it."""
        return kv.scan(self.rows(self.overlapping(start, end)), self._at(branch, snapshot), start, end)

    def seek(self, start: bytes, limit: int, **at) -> DataFrame:
        """The first `limit` visible rows from a key on, in order."""
        return self.scan(start=start, **at).orderBy("user_key").limit(limit)

    def scan_prefix(self, prefix: bytes, **at) -> DataFrame:
        return self.scan(start=prefix, end=kv.prefix_end(prefix), **at)

    def get(self, key: bytes, branch: str | None = None, snapshot: str | None = None) -> DataFrame:
        return kv.get(self.rows(self.overlapping(key, key)), key, self._at(branch, snapshot))

    def multi_get(self, keys: DataFrame, branch: str | None = None, snapshot: str | None = None) -> DataFrame:
        """(pos, user_key, value) of keys(pos, user_key), all at one sequence number."""
        low, high = keys.agg(F.min("user_key"), F.max("user_key")).first()
        names = self.overlapping(bytes(low), bytes(high)) if low is not None else []
        return kv.multi_get(self.rows(names), keys, self._at(branch, snapshot))

    # ---- snapshots, branches, archives

    def snapshot(self) -> str:
        name = uuid.uuid4().hex
        self._save(snapshots={**self.catalog["snapshots"], name: self.head()})
        return name

    def release(self, name: str) -> None:
        self._save(snapshots={k: v for k, v in self.catalog["snapshots"].items() if k != name})

    def branch(self, action: str, name: str, at: int | None = None) -> None:
        """create, checkout or drop a branch."""
        b = kv.Branches(0, dict(self.catalog["heads"]), self.catalog["current"])
        {"create": lambda: b.create(name, at), "checkout": lambda: b.checkout(name), "drop": lambda: b.drop(name)}[action]()
        self._save(heads=b.heads, current=b.current)

    def floor(self) -> int:
        return kv.retention_floor(self.catalog["last"], list(self.catalog["snapshots"].values()), list(self.catalog["heads"].values()))

    def archive(self, branch: str) -> str:
        name = f"archive-{uuid.uuid4().hex}"
        kv.archive(self.rows(), self.head(branch)).write.parquet(f"{self.files.root}/{name}")
        self._save(archives={**self.catalog["archives"], name: {"branch": branch, "seqno": self.head(branch)}})
        return name

    def clean_archives(self) -> list[str]:
        """Drops records of archives whose files are gone."""
        gone = [a for a in self.catalog["archives"] if not self.files.exists(a)]
        self._save(archives={k: v for k, v in self.catalog["archives"].items() if k not in gone})
        return gone

    # ---- compaction

    def compact(self, names: list[str] | None = None) -> list[str]:
        """Rewrites files (all by default) to what the retention floor asks for, one level below the deepest of them (at least 1).

        Deletes go only if no other file reaches into the chosen keys. Old files stay for readers of older catalogs until clean()."""
        names = [x for x in (names or self.catalog["files"]) if self.catalog["files"][x]["tier"] != "frozen"]
        if not names:
            return []
        records = [self.catalog["files"][x] for x in names]
        low, high = min(bytes.fromhex(r["smallest"]) for r in records), max(bytes.fromhex(r["largest"]) for r in records)
        others = [x for x in self.catalog["files"] if x not in set(names)]
        alone = not self.overlapping(low, high, others)
        # what is visible at the floor must stay: rows at or under it collapse to the newest
        kept = kv.compact(self.rows(names), self.floor() + 1, covers_all=alone)
        new = self._write(kept, max(1, *(r["level"] for r in records)) if len(names) == len(self.catalog["files"]) else max(r["level"] for r in records) + 1)
        self._save(files={**{x: self.catalog["files"][x] for x in others}, **new})
        return list(new)

    def candidate(self) -> int | None:
        """The level that asks for compaction most."""
        best = kv.compaction_candidate(kv.compaction_scores(kv.level_metrics(self.table()), **self.limits)).first() if self.catalog["files"] else None
        return None if best is None else best["level"]

    def auto_compact(self, most: int = 8) -> int:
        """Compacts the level that asks most, with what it overlaps one level below, until none asks; how often."""
        done, fresh, fresh_alone = 0, set(), False
        while done < most and (level := self.candidate()) is not None:
            own = [x for x, r in self.catalog["files"].items() if r["level"] == level and r["tier"] != "frozen"]
            below = [x for x, r in self.catalog["files"].items() if r["level"] == level + 1 and r["tier"] != "frozen"]
            reach = [self.catalog["files"][x] for x in own]
            if not own:
                break
            low, high = min(bytes.fromhex(r["smallest"]) for r in reach), max(bytes.fromhex(r["largest"]) for r in reach)
            chosen = [*own, *self.overlapping(low, high, below)]
            rest = {x: r for x, r in self.catalog["files"].items() if x not in set(chosen)}
            alone = not self.overlapping(low, high, list(rest))
            if set(chosen) == fresh and (fresh_alone or not alone):
                # just written by the round before: the same rows would be written again, so only their level changes
                new = {x: {**self.catalog["files"][x], "level": level + 1} for x in chosen}
            else:
                new = self._write(kv.compact(self.rows(chosen), self.floor() + 1, covers_all=alone), level + 1)
                fresh, fresh_alone = set(new), alone
            self._save(files={**rest, **new})
            done += 1
        return done

    # ---- tiers

    def _move(self, names: list[str], tier: str) -> None:
        """Copies first, then commits the new place; the old copy goes last."""
        util, conf, fs, of = self.files.jvm.org.apache.hadoop.fs.FileUtil, self.spark.sparkContext._jsc.hadoopConfiguration(), self.files.fs, self.files.jvm.org.apache.hadoop.fs.Path
        old = {x: self._path(x) for x in names}
        for folder in {x.rsplit("/", 1)[0] for x in names}:
            fs.mkdirs(self.files.path(f"{tier}/{folder}"))
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: util.copy(fs, of(old[x]), fs, self.files.path(f"{tier}/{x}"), False, True, conf), names))
            self._save(files={x: {**r, "tier": tier} if x in old else r for x, r in self.catalog["files"].items()})
            list(pool.map(lambda path: fs.delete(of(path), False), old.values()))

    def rebalance(self, hot_bytes: int) -> list[str]:
        """Moves files from the hot tier to the cold one, deepest levels and oldest entries first, until the hot one is within its bytes."""
        hot = sorted(((r["level"], -r["max_seqno"], x) for x, r in self.catalog["files"].items() if r["tier"] == "hot"), reverse=True)
        size, moved = sum(self.catalog["files"][x]["size_bytes"] for _, _, x in hot), []
        for _, _, name in hot:
            if size <= hot_bytes:
                break
            size -= self.catalog["files"][name]["size_bytes"]
            moved.append(name)
        if moved:
            self._move(moved, "cold")
        return moved

    def freeze(self, level: int) -> list[str]:
        """Files of a level to the frozen tier: they are read as before, but not compacted."""
        names = [x for x, r in self.catalog["files"].items() if r["level"] == level and r["tier"] != "frozen"]
        if names:
            self._move(names, "frozen")
        return names

    def thaw(self, names: list[str]) -> None:
        self._move([x for x in names if self.catalog["files"][x]["tier"] == "frozen"], "hot")

    # ---- checks

    def scrub(self) -> DataFrame:
        """(file_id, level, entries, ok): every file read in full and held against its record."""
        paths = self._paths(list(self.catalog["files"]))
        rows = [(x, r["level"], r["smallest"], r["largest"], r["max_seqno"], r["entries"], r["checksum"]) for x, r in self.catalog["files"].items()]
        told = self.spark.createDataFrame(rows, "file_id string, level int, s string, l string, m long, e long, c string")
        if not paths:
            return told.selectExpr("file_id", "level", "e as entries", "true as ok")
        real = self._summary(self._file_of(paths), F.col("file").alias("file_id"))
        ok = (F.col("s") == F.col("smallest")) & (F.col("l") == F.col("largest")) & (F.col("m") == F.col("max_seqno")) & (F.col("e") == F.col("entries")) & (F.col("c") == F.col("checksum"))
        return told.join(real, "file_id", "left").select("file_id", "level", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce(ok, F.lit(False)).alias("ok"))

    def _folders(self, tier: str) -> list[str]:
        return [f"{tier}/{d}/{x}" for d in self.files.names(tier) for x in self.files.names(f"{tier}/{d}") if x.endswith(".parquet")]

    def orphan_files(self) -> list[str]:
        """Stored files that the catalog doesn't name."""
        named = {f"{r['tier']}/{x}" for x, r in self.catalog["files"].items()}
        return [x for tier in TIERS for x in self._folders(tier) if x not in named]

    def clean(self) -> list[str]:
        """Deletes older catalogs and the files that the current one doesn't name."""
        gone = [f"catalog-{n:012d}.json" for n in self.catalogs.numbers() if n < self.catalog["generation"]] + self.orphan_files()
        for name in gone:
            self.files.delete(name)
        return gone
