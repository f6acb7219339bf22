"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quivra.llm.common import table

#: The byte limit of a shard: small, so that the smallest tables split too.
SHARD_BYTES = 256 << 10


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quivra.llm.token_orc import encode_to_orc

    return encode_to_orc(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2)


def op6_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quivra.llm.sentencepiece_sampling import digest, sample_segmentations

    return digest(sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), k=3, theta=0.5))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quivra.llm.ogg import digest, store

    return digest(store(table(spark, sf_dir, "documents")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quivra.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2, 1024)


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quivra.llm.chat import digest, windows

    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(windows(told.unionByName(more), budget=1024, history=128))


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quivra.llm.sharding import assign

    return assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quivra.llm.quality import judge

    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quivra.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quivra.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quivra.llm.toxicity import fit, score

    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")), threshold=0.7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_windows,
        op2_extendible_sharding,
        op3_quality_rules,
        op4_simhash_dedup,
        op5_token_orc,
        op6_gumbel_segmentations,
        op7_ogg_media,
        op8_best_fit_packing,
        op9_html_main_text,
        op10_toxicity,
    )
}


def sharding_sql(limit: int) -> str:
    """The same directory in SQL; ids are unique there, so the bits of the id's hash are enough."""
    return f"""
WITH r AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
                  lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT)), 60, '0') AS bits FROM documents),
     s AS (SELECT r.doc_id, r.n_bytes, d.depth, substr(bits, 1, d.depth) AS prefix FROM r, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 61)) d),
     b AS (SELECT prefix, depth, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM s GROUP BY prefix, depth HAVING sum(n_bytes) <= {limit}),
     l AS (SELECT s.doc_id, s.n_bytes, s.prefix, s.depth, b.shard_bytes, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.depth) AS k FROM s JOIN b ON s.prefix = b.prefix AND s.depth = b.depth)
SELECT doc_id, n_bytes, prefix AS shard, depth, CAST(0 AS BIGINT) AS page, shard_bytes FROM l WHERE k = 1"""


QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
     g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
     r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
     c AS (SELECT doc_id, sum(least(5, coalesce(n - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM r) GROUP BY doc_id),
     f AS (SELECT w.doc_id, text, words, len(lines) AS n_lines, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
           FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
     b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.5 * n_lines OR length(text) - length(replace(text, '!', '')) > 0.2 * n_words
            OR length(text) - length(translate(text, '0123456789', '')) > 0.3 * word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x))) > 0.5 * n_words) AS kept
FROM b"""

ORACLES: dict[str, str] = {"op3_quality_rules": QUALITY_SQL, "op2_extendible_sharding": sharding_sql(SHARD_BYTES)}
