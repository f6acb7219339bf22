"""From raw documents to packed sequences: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quivra.llm import common, packing, quality, similar, toxicity
from quivra.llm.queries import tokenizer_path


#: Rows in an Arrow batch: documents are large, and JVM and Python workers hold several batches each.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """For the rest of the session, which is the pipeline's own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7; a null score does not occur."""
    small_batches(spark)
    scorer = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(docs, scorer, F.col("text")) < 0.7)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), that of the smallest doc_id.

    Covering tables alone can't reach a similarity of 0.8 (about ten of 64 bits), so SimHash fingerprints of samples of shingles give
    further candidates, and whole shingle sets decide; op4 itself is the dealt method by its contract."""
    small_batches(spark)
    return similar.keep_one(docs, similarity=0.8, width=5, radius=4)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 1024 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), 2, 1024, max_chunks=150_000)


STAGES = [("toxicity", drop_toxic), ("quality rules", apply_rules), ("SimHash near-dedup", drop_near_copies), ("best-fit packing", pack_sequences)]

#: No SQL expresses the toxicity score; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = common.new_path(spark, "stage-" + name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            common.drop_path(spark, before)
        before = path
    return docs
