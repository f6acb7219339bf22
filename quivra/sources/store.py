"""Versioned tables without a table format: folders of Parquet files, and numbered JSON catalogs that name the current ones.

A writer makes its folders first and then commits by giving its catalog the next number, which only one writer can: renaming onto a name that
exists fails. A crash before that leaves folders that no catalog names; readers take the greatest number and see a whole commit or
the one before. Paths go through Hadoop's file system interface, so any store that Spark reads will do."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quivra.operators import mutations as m
from quivra.operators.knn import DimensionError


class ConflictError(RuntimeError):
    """Another writer has committed since this one read the catalog."""


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.gateway, self.jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        self.root = root.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes beside and renames: never half a file, and never over one that is there."""
        temporary = f"_{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(temporary), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        plain = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.context.rename(self.path(temporary), self.path(name), plain)
        except Py4JJavaError as e:
            self.fs.delete(self.path(temporary), False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise ConflictError(name) from None
            raise

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)

    def names(self, folder: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []


class Catalogs:
    """catalog-<number>.json files in a folder."""

    def __init__(self, files: Files):
        self.files = files

    def numbers(self) -> list[int]:
        return [int(n[8:-5]) for n in self.files.names() if n.startswith("catalog-") and n.endswith(".json")]

    def read(self, number: int) -> dict:
        return json.loads(self.files.read(f"catalog-{number:012d}.json"))

    def latest(self) -> dict | None:
        found = self.numbers()
        return self.read(max(found)) if found else None

    def commit(self, catalog: dict) -> None:
        """catalog["generation"] must be one more than the one read."""
        self.files.create(f"catalog-{catalog['generation']:012d}.json", json.dumps(catalog))

    def clean(self, keep: int, parts: str = "parts") -> list[str]:
        """Deletes all but the newest `keep` catalogs and the folders that none of the rest names; returns what went."""
        numbers = sorted(self.numbers())
        gone = [f"catalog-{n:012d}.json" for n in numbers[: max(0, len(numbers) - max(1, keep))]]
        named = {p for n in numbers[-max(1, keep) :] for p in self.read(n)[parts]}
        gone += [n for n in self.files.names() if n.startswith("part-") and n not in named]
        for name in gone:
            self.files.delete(name)
        return gone


class VectorStore:
    """Rows (id, values, version, deleted) of a fixed dimension, partitioned by shard = id mod shards.

    A commit of a batch appends its rows as one more part, deletes as markers; a row's newest commit counts. compact() makes one part of all."""

    SCHEMA = "id long, values array<float>, version int, deleted boolean, commit long, shard long"

    def __init__(self, spark: SparkSession, root: str, dim: int | None = None, shards: int = 8, max_parts: int = 16, files_a_shard: int = 16):
        self.spark, self.files = spark, Files(spark, root)
        self.catalogs, self.max_parts, self.files_a_shard = Catalogs(self.files), max_parts, files_a_shard
        self.catalog = self.catalogs.latest()
        if self.catalog is not None:
            if dim is not None and dim != self.catalog["dim"]:
                raise DimensionError(f"the store has {self.catalog['dim']} components")
        elif dim is None:
            raise FileNotFoundError(root)
        else:
            self.catalog = {"dim": dim, "shards": shards, "generation": -1, "parts": [], "applied": {}, "upserts": 0, "deletes": 0}
            self._commit([])

    def _write(self, rows: DataFrame, commit: int) -> str:
        """Rows (id, values, version, deleted) as a part; no catalog names it yet."""
        name = f"part-{uuid.uuid4().hex}"
        out = rows.withColumns({"commit": F.lit(commit).cast("long"), "shard": F.pmod("id", F.lit(self.catalog["shards"])).cast("long")})
        spread = out.repartition("shard", F.pmod(F.xxhash64("id"), F.lit(self.files_a_shard)))
        spread.sortWithinPartitions("shard", "id").write.partitionBy("shard").parquet(f"{self.files.root}/{name}")
        return name

    def _commit(self, parts: list[str], **more) -> None:
        new = {**self.catalog, **more, "parts": parts, "generation": self.catalog["generation"] + 1}
        self.catalogs.commit(new)
        self.catalog = new

    def _rows(self, generation: int | None = None) -> DataFrame:
        """Every row of every part."""
        parts = (self.catalog if generation is None else self.catalogs.read(generation))["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        frames = [self.spark.read.schema(self.SCHEMA).parquet(f"{self.files.root}/{p}") for p in parts]
        out = frames[0]
        for x in frames[1:]:
            out = out.unionByName(x)
        return out

    def read(self, generation: int | None = None) -> DataFrame:
        """Live rows (id, values, version, deleted, shard) of a generation, the current one unless another is named."""
        rows = self._rows(generation)
        if len((self.catalog if generation is None else self.catalogs.read(generation))["parts"]) > 1:
            newest = rows.groupBy("id", "shard").agg(F.max_by(F.struct("values", "version", "deleted"), "commit").alias("r"))
            rows = newest.select("id", "r.values", "r.version", "r.deleted", "shard")
        return rows.select("id", "values", "version", "deleted", "shard").filter(~F.col("deleted"))

    def row(self, key: int) -> DataFrame:
        """One row, from its shard's folders alone."""
        return self.read().filter((F.col("shard") == key % self.catalog["shards"]) & (F.col("id") == key))

    def bulk_load(self, rows: DataFrame) -> None:
        """Replaces all rows: a new generation. Ids must be from 0 and unique in what is kept: the last of a repeated id by version."""
        self._check(rows)
        full = rows
        for name, value in (("version", F.lit(0)), ("deleted", F.lit(False))):
            if name not in full.columns:
                full = full.withColumn(name, value)
        last = full.groupBy("id").agg(F.max_by(F.struct("values", "version", "deleted"), "version").alias("r")).select(F.col("id").cast("long"), F.col("r.values").cast("array<float>").alias("values"), F.col("r.version").cast("int").alias("version"), "r.deleted")
        self._commit([self._write(last, self.catalog["generation"] + 1)])

    def _check(self, rows: DataFrame) -> None:
        if not rows.filter((F.size("values") != self.catalog["dim"]) | F.col("values").isNull()).isEmpty():
            raise DimensionError(f"rows must have {self.catalog['dim']} components")
        if not rows.filter(F.col("id").isNull() | (F.col("id") < 0)).isEmpty():
            raise ValueError("ids are numbers from 0")

    def apply(self, mutations: DataFrame, batch: str | tuple[str, int] | None = None) -> dict[str, int]:
        """One atomic commit of a batch (pos, kind, id, values), by its rows alone.

        batch: (writer, number); a number not above the writer's greatest changes nothing. A bare name is a writer's only batch."""
        writer, number = (batch, 0) if isinstance(batch, str) else batch or ("", 0)
        if batch is not None and self.catalog["applied"].get(writer, -1) >= number:
            return {"upserts": 0, "deletes": 0}
        m.validate(mutations, self.catalog["dim"])
        last = m.last_per_id(mutations)
        newest = self._rows().groupBy("id").agg(F.max_by("deleted", "commit").alias("gone")).filter("not gone").select("id")
        n = m.counts(newest, mutations).first().asDict()
        rows = last.select(F.col("id").cast("long"), F.when(F.col("kind") == "upsert", F.col("values").cast("array<float>")).alias("values"), F.lit(0).alias("version"), (F.col("kind") == "delete").alias("deleted"))
        applied = self.catalog["applied"] | ({writer: number} if batch is not None else {})
        part = self._write(rows, self.catalog["generation"] + 1)
        self._commit([*self.catalog["parts"], part], applied=applied, upserts=self.catalog["upserts"] + n["upserts"], deletes=self.catalog["deletes"] + n["deletes"])
        if len(self.catalog["parts"]) > self.max_parts:
            self.compact()
        return n

    def compact(self) -> None:
        """The live rows as one part, in a new generation."""
        self._commit([self._write(self.read().drop("shard"), self.catalog["generation"] + 1)])

    rebuild = compact

    def clean(self, keep: int = 2) -> list[str]:
        """Deletes all but the newest generations, and what no catalog names; returns what went."""
        return self.catalogs.clean(keep)

    def orphans(self) -> list[str]:
        """Parts that no catalog names: of commits that a crash or another writer prevented."""
        named = {p for n in self.catalogs.numbers() for p in self.catalogs.read(n)["parts"]}
        return [n for n in self.files.names() if n.startswith("part-") and n not in named]

    def stats(self) -> DataFrame:
        c = self.catalog
        return self.spark.createDataFrame([(c["generation"], c["dim"], c["shards"], c["upserts"], c["deletes"], len(c["parts"]))], "generation long, dim int, shards int, upserts long, deletes long, parts int")

    def healthy(self) -> bool:
        return self.catalogs.latest() is not None and all(self.files.exists(p) for p in self.catalog["parts"])
