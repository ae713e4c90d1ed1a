"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each component, set where it is positive; a code is
cut into segments of 16 bits.  Two codes within distance m (r + 1) - 1, for m
segments, have at least one segment within distance r.  So the search probes, in
every segment's index, all values at distance r = 0, 1, 2, ... from the query's
and verifies whom it finds by their full distance; a query is done as soon as its
k-th verified distance is at most m (r + 1) - 1, which proves that nothing closer
is left.

Equal codes are one entry with its k smallest ids, so that copies of a vector
cost nothing.  Codes and queries are dealt into blocks of bounded size.  In a round
every block of open queries meets every block of codes: the task indexes the codes once
for all of the block's queries and reports for each at most k verified codes that are no
farther than the k-th so far; the reports are merged by distance and id.  Queries that
are done leave; all others go on together, in at most 17 rounds.  Nothing but
counts reaches the driver.

Results at the edges: a null vector or null id is in no result and asks nothing;
null or NaN components give a 0 bit; vectors of other lengths than the longest
are filled up with 0 bits; ties go to the smaller id; repeated rows count as one;
with fewer than k vectors all are returned; a query finds itself; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

BITS = 16


@dataclass(frozen=True)
class SearchConfig:
    k: int = 10
    #: Queries of a block, and codes that are indexed at once, at most (expected, by a hash).
    query_block: int = 1 << 15
    code_block: int = 1 << 16
    #: Codes of a block from which more blocks only serve to occupy the cluster.
    least_block: int = 1 << 13


def binary_codes(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, code): bits of 16-bit segments as bytes."""
    width = -(-dims // BITS) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for v in batch.column(1).to_pylist():
                bits = np.nan_to_num(np.array([0.0 if x is None else x for x in v], float)) > 0
                codes.append(np.packbits(bits).tobytes().ljust(width, b"\0"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["vec_id", "code"])

    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(run, "vec_id long, code binary")


def _masks(r: int) -> np.ndarray:
    x = np.arange(1 << BITS, dtype=np.uint32)
    return x[np.bitwise_count(x) == r].astype(np.uint16)


class SegmentIndex:
    """Of a block of codes: for every segment the codes in order of its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes  # (n, segments) of 16 bits
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.start = [np.searchsorted(codes[o, s], np.arange((1 << BITS) + 1)) for s, o in enumerate(self.order)]

    def at_radius(self, query: np.ndarray, r: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes' rows, distances): all codes whose nearest segment is at distance r."""
        found = []
        for s, (order, start) in enumerate(zip(self.order, self.start, strict=True)):
            values = (masks ^ query[s]).astype(np.int64)
            low, size = start[values], start[values + 1] - start[values]
            own = np.flatnonzero(size)
            if len(own):
                size = size[own]
                at = np.repeat(low[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                found.append(order[at])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.unique(np.concatenate(found))
        by_segment = np.bitwise_count(self.codes[rows] ^ query)
        new = by_segment.min(1) == r  # nearer ones were verified in an earlier round
        return rows[new], by_segment[new].sum(1).astype(np.int64)


def _packed(rows: DataFrame, number: int, key: str, *columns: str) -> DataFrame:
    """(key, rows): ``number`` blocks of the rows, by a hash of their code."""
    return rows.groupBy(F.pmod(F.xxhash64("code"), F.lit(number)).cast("int").alias(key)).agg(F.collect_list(F.struct(*columns)).alias(f"{key}_rows"))


def _codes(column: pa.Array) -> np.ndarray:
    """(n, segments) of 16 bits of a column of codes."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").astype(np.uint16).reshape(len(column), -1)


def _nearest(index: SegmentIndex, ids: list[list[int]], count: np.ndarray, query: np.ndarray, bound: int, r: int, masks: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k nearest (distance, id) of those whose nearest segment is at distance r."""
    rows, distance = index.at_radius(query, r, masks)
    near = distance <= bound
    rows, distance = rows[near], distance[near]
    if count[rows].sum() > k:  # enough codes for k ids, and whoever ties with the last
        order = np.argsort(distance, kind="stable")
        last = distance[order[np.searchsorted(np.cumsum(count[rows[order]]), k)]]
        rows, distance = rows[distance <= last], distance[distance <= last]
    return sorted((d, v) for d, row in zip(distance.tolist(), rows.tolist(), strict=True) for v in ids[row])[:k]


def _round(codes: DataFrame, code_blocks: int, queries: DataFrame, query_blocks: int, r: int, cfg: SearchConfig) -> DataFrame:
    """(query, distance, vec_id): at most k of each block of codes and query."""
    masks, k = _masks(r), cfg.k
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    units = codes.withColumn("q", every(query_blocks)).join(queries.withColumn("c", every(code_blocks)), ["q", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in range(batch.num_rows):
                entries, asked = batch.column(0)[u].values, batch.column(1)[u].values
                index = SegmentIndex(_codes(entries.field("code")))
                ids = entries.field("ids").to_pylist()
                count = np.array([len(x) for x in ids])
                raw, bounds = asked.field("code").to_pylist(), asked.field("bound").to_pylist()
                out: tuple[list, list, list] = ([], [], [])
                for code, query, bound in zip(raw, _codes(asked.field("code")), bounds, strict=True):
                    pairs = _nearest(index, ids, count, query, bound, r, masks, k)
                    out[0].extend([code] * len(pairs))
                    out[1].extend(d for d, _ in pairs)
                    out[2].extend(v for _, v in pairs)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["query", "distance", "vec_id"])

    return units.select("c_rows", "q_rows").mapInArrow(run, "query binary, distance int, vec_id long")


def search(vectors: DataFrame, queries: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest of ``vectors`` to each of
    ``queries`` (both vec_id, embedding), nearest first, ties by id."""
    spark = vectors.sparkSession
    dims = max(vectors.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)
    segments = -(-dims // BITS)
    few = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    codes = binary_codes(vectors, dims).distinct().withColumn("n", few).where(F.col("n") <= cfg.k).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    codes = materialise(codes, "codes")
    n = codes.count()
    code_blocks = max(1, -(-n // cfg.code_block), min(shuffle_partitions(spark), -(-n // cfg.least_block)))
    packed = materialise(_packed(codes, code_blocks, "c", "code", "ids"), "codes")
    asked = materialise(binary_codes(queries, dims).distinct(), "queries")
    best, wide = Window.partitionBy("query").orderBy("distance", "vec_id"), segments * BITS
    todo = materialise(asked.select("code").distinct().withColumn("bound", F.lit(wide)), "open")
    found: DataFrame | None = None
    done = []
    for r in range(BITS + 1 if n else 0):
        waiting = todo.count()
        if not waiting:
            break
        query_blocks = -(-waiting // cfg.query_block)
        new = _round(packed, code_blocks, _packed(todo, query_blocks, "q", "code", "bound"), query_blocks, r, cfg)
        found = new if found is None else found.union(new)
        found = materialise(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= cfg.k).drop("n"), "found")
        kth = found.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
        kth = materialise(todo.select(F.col("code").alias("query")).join(kth, "query", "left").withColumn("full", F.coalesce(F.col("n") == cfg.k, F.lit(False))), "kth")
        covered = F.col("full") & (F.col("d") <= segments * (r + 1) - 1) | F.lit(r == BITS)
        done.append(found.join(kth.where(covered).select("query"), "query", "left_semi"))
        todo = kth.where(~covered).select(F.col("query").alias("code"), F.when(F.col("full"), F.col("d")).otherwise(F.lit(wide)).alias("bound"))
        found = found.join(todo.select(F.col("code").alias("query")), "query", "left_semi")
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    ranked = out.withColumn("rank", F.row_number().over(best))
    return asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).join(ranked, "query").select("query_id", "rank", "vec_id", "distance")
