"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, small_batches, table
from .fixity import FixityConfig, audit
from .fingerprint import FingerprintConfig, compare
from .html_text import extract
from .language import LanguageConfig, fit_language, predict_language
from .mixing import MixingConfig, mix
from .near_dedup import DedupConfig, near_duplicates
from .packing import PackingConfig, pack
from .sharding import ShardConfig, shard
from .topk import SearchConfig, search
from .toxicity import ToxicityConfig, fit_toxicity, score_toxicity


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults to find: in every 97th page, from 13 on, the html has one
    character more, and every 389th page, from 7 on, is lost."""
    hurt = F.when(F.pmod("page_id", F.lit(97)) == 13, F.concat(F.coalesce("html", F.lit("")), F.lit("\x01"))).otherwise(F.col("html"))
    return pages.where("page_id is null or pmod(page_id, 389) != 7").withColumn("html", hurt)


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages), FixityConfig())


OP1_SQL = """
WITH records AS (
  SELECT page_id, page_id // 1024 AS file, page_id % 97 = 13 AS hurt, page_id % 389 = 7 AS lost,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head,
    coalesce(html, '') AS html
  FROM pages
), made AS (
  SELECT page_id, file, hurt, lost,
    head || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    head || (strlen(html) + 1) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(1) || chr(13) || chr(10) || chr(13) || chr(10) AS other
  FROM records
), placed AS (
  SELECT *, CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM made
)
SELECT page_id, CASE WHEN lost THEN 'missing' ELSE 'corrupt' END AS status, file, "offset",
  CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest,
  CASE WHEN NOT lost THEN CAST(strlen(other) AS BIGINT) END AS replica_length, CASE WHEN NOT lost THEN sha256(other) END AS replica_digest
FROM placed WHERE hurt OR lost
"""


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), DedupConfig())


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = PackingConfig(vocabulary=vocabulary("byte_bpe_50k.json"))
    pieces = pack(table(spark, sf_dir, "documents"), cfg)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"), FingerprintConfig())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cfg = LanguageConfig(vocabulary=vocabulary("piece_bpe_32k.model"))
    made = predict_language(docs.select("doc_id", "text"), fit_language(docs, cfg))
    held = (fold(F.col("doc_id"), cfg.holdout_mod) == cfg.holdout).alias("held_out")
    return made.select("doc_id", held, "lang_pred", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("pmod(vec_id, 20) = 0"), SearchConfig(k=10))


OP7_SQL = """
WITH bits AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.b, v.b), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM (SELECT * FROM bits WHERE vec_id % 20 = 0) q CROSS JOIN bits v
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs
) WHERE rank <= 10
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), ShardConfig(shards=24))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return made.select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def quality_domains(labels: DataFrame) -> DataFrame:
    """The labelled table's domains: documents of high and of low quality."""
    name = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", name.alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = quality_domains(table(spark, sf_dir, "labels"))
    cfg = MixingConfig(targets={"high": 0.8, "low": 0.2}, total="corpus", vocabulary=vocabulary("byte_bpe_50k.json"))
    made = mix(table(spark, sf_dir, "documents").select("doc_id", "text"), labelled, cfg)
    return made.select("doc_id", "tokens", F.col("posterior")[0].alias("p_high"), F.col("posterior")[1].alias("p_low"), "rate", "copies")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cfg = table(spark, sf_dir, "documents"), ToxicityConfig()
    made = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, table(spark, sf_dir, "labels"), cfg))
    held = (fold(F.col("doc_id"), cfg.holdout_mod) == cfg.holdout).alias("held_out")
    return made.select("doc_id", held, "score", "predicted")


def _batched(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query in a session of small Arrow batches: whole texts travel in them."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: _batched(q)
    for q in (op1_warc_fixity, op2_minhash_dedup, op3_html_text, op4_packing, op5_fingerprint, op6_language_id, op7_topk_search, op8_sharding, op9_mixing, op10_toxicity)
}

ORACLE_SQL: dict[str, str] = {"op1_warc_fixity": OP1_SQL, "op7_topk_search": OP7_SQL}
