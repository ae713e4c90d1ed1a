"""The corpus pipeline: toxicity, language, near-duplicates, mixing, packing.

Every stage works on all rows its predecessor kept; all but the last return the
columns of ``documents``.

1. ``toxicity``: documents with a score of at least 0.7 go.
2. ``language``: documents go that have no letter, whose most likely language has a
   posterior under 0.5, or that are not in any learned language: their surprise (negative
   log probability a character) is over the model's limit.
3. ``near_dedup``: the document of the smallest id of each class of near-duplicates
   (five-word shingles, likeness 0.8 or more) stays.
4. ``mixing``: every document stays with the chance of its rate (rates over 1 count
   as 1), so that the tokens' shares of high and low quality meet ``MIX``.  The total
   is the largest for which no domain needs more than it has.
5. ``packing``: the rest is cut into sequences of 2048 ids.

Results at the edges, of all stages: a null text counts as empty, so that it goes in the
language stage; a row with a null id is read like others, is nobody's near-duplicate, and
stays; repeated rows are near-duplicates of each other; texts of any length are read
whole; ties go to the smaller id; an empty table stays empty; extra columns come through
untouched, also those named like something an operator makes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import queries as Q
from orrery.llm.common import small_batches, table
from orrery.llm.language import LanguageConfig, fit_language, predict_language
from orrery.llm.mixing import MixingConfig, mix
from orrery.llm.near_dedup import DedupConfig, deduplicate
from orrery.llm.packing import PackingConfig, pack
from orrery.llm.toxicity import ToxicityConfig, fit_toxicity, score_toxicity

MIX = {"high": 0.93, "low": 0.07}


def _beside(docs: DataFrame, work: Callable[[DataFrame], DataFrame], *made: str) -> DataFrame:
    """``work(docs)`` with the columns of ``docs`` as they were; those named like one that
    ``work`` makes are out of its way meanwhile."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in made}
    out = work(docs.withColumnsRenamed(own))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ToxicityConfig())
    return _beside(docs, lambda d: score_toxicity(d, model).where("predicted = 0"), "score", "predicted")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = fit_language(docs, LanguageConfig(vocabulary=Q.vocabulary("piece_bpe_32k.model")))
    known = (F.col("lang_pred") != "und") & (F.col("score") >= 0.5) & (F.col("surprise") <= model.surprise_limit)
    return _beside(docs, lambda d: predict_language(d, model).where(known), "lang_pred", "score", "surprise")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return deduplicate(docs, DedupConfig())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labelled = Q.quality_domains(table(spark, sf_dir, "labels"))
    cfg = MixingConfig(targets=MIX, total="supply", vocabulary=Q.vocabulary("byte_bpe_50k.json"))
    return _beside(docs, lambda d: mix(d, labelled, cfg).where("copies >= 1"), "tokens", "posterior", "rate", "copies")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pieces = pack(docs, PackingConfig(vocabulary=Q.vocabulary("byte_bpe_50k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Networks, expectation maximisation and tokenizers are beyond SQL; the stages are
#: tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
