"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; whole texts travel in them, so that the number is small.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Only where the
    session has none and runs in one process (tests) a temporary one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        where = tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    a lost executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """For the session of a registered query.  Operators leave the session's settings
    alone, and work through larger batches in slices."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def prefix(df: DataFrame) -> str:
    """Underscores with which no column of ``df`` begins: for columns of an operator's own."""
    at = "__"
    while any(c.startswith(at) for c in df.columns):
        at += "_"
    return at


def slices(batch, most: int = 1 << 20):
    """The batch in slices of at most ``most`` bytes (or one row): working memory follows
    the bytes of texts, and not the number of rows."""
    start, size, n = 0, 0, batch.num_rows
    widths = sum((np.diff(_offsets(c)) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)), np.zeros(n, np.int64))
    for i, w in enumerate(widths.tolist()):
        if i > start and size + w > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += w
    if n > start:
        yield batch.slice(start)


def spans(texts: list[str | None], most: int = 1 << 20) -> list[tuple[int, int]]:
    """The list in spans of at most ``most`` characters (or one text)."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            out.append((start, i))
            start, size = i, 0
        size += n
    return out + ([(start, len(texts))] if len(texts) > start else [])


def _offsets(column) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def release() -> None:
    """Give memory that a fit has freed back to the system: the driver's process lives on."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # not every system's library can
        ctypes.CDLL(None).malloc_trim(0)


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_texts(docs: DataFrame, ids: list[int], max_chars: int) -> dict[int, str]:
    """The whole texts of at most ``len(ids)`` documents, in the order of ``ids``
    until ``max_chars`` characters are reached.  ``ids`` is bounded by the
    caller's documented sample size, and so is what comes to the driver."""
    spark = docs.sparkSession
    if not ids:
        return {}
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = texts.join(wanted, "doc_id", "left_semi")
    sizes = {r[0]: r[1] for r in found.groupBy("doc_id").agg(F.max(F.length("text"))).collect()}
    keep, total = [], 0
    for i in ids:
        n = sizes.get(i)
        if n is None or (keep and total + n > max_chars):
            continue
        keep.append(i)
        total += n
    if not keep:
        return {}
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in keep], "doc_id long"))
    got = texts.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text")).collect()
    by = {r[0]: r[1] for r in got}
    return {i: by[i] for i in keep if i in by}
