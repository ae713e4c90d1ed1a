"""Sharding by histogram sort, balanced by bytes.

Rows are sorted by (hash of the text, id), so that equal texts lie together, and
cut into shards of near equal bytes.  The cuts are found without sorting: a
round counts the exact bytes and rows below candidate keys in every partition
and adds them up (a few numbers per candidate reach the driver); each cut's
bracket is then probed more finely, until the bytes below some candidate are
within ``tolerance`` of the cut's target or the bracket holds a single key.
Candidates lie between texts as long as that suffices, so groups of equal texts
are split only where a shard could not be met otherwise.  Ranges between
candidates that hold more than their share of bytes are probed on as well, so that no
range holds much more than 1 / (shards * ranges) of the whole but a single text.

Then rows move once.  A range between two neighbouring candidates is split evenly by
hash (of equal texts: by id) into parts of about ``part_bytes``; a part is sorted by itself, and
prefix sums of the parts' rows give its first slot in its shard.  No task ever holds a
shard.  The driver has a few thousand candidates, whatever the size of the data; of
parts there are at most ``max_parts``, beyond which they grow and their sorts spill.

Results at the edges: a null text has no bytes and sorts as an empty one; a null
id sorts first; rows equal in text and id stay in one range, with slots in any
order; texts of any length are one row, so that
a shard may miss its target by the text at its border; shards may be empty in small tables; an empty table gives an empty
result; extra columns move along; columns named like an output are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prefix

LOW, SPAN = -(1 << 63), 1 << 64


@dataclass(frozen=True)
class ShardConfig:
    shards: int = 24
    #: Bytes that a cut may miss its target by, as a share of a shard.
    tolerance: float = 0.001
    #: Candidates per open bracket and round.
    probes: int = 63
    #: Ranges per shard, at least.
    ranges: int = 32
    #: Bytes of a part of a range, and the number of all parts at most.
    part_bytes: int = 1 << 26
    max_parts: int = 1 << 20
    extra_bytes: int = 8


def _pack(h: int, d: int) -> int:
    return ((h - LOW) << 64) | (d - LOW)


def _split(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([(k >> 64) + LOW for k in keys], np.int64), np.array([(k & (SPAN - 1)) + LOW for k in keys], np.int64)


def _place(ph: np.ndarray, pd_: np.ndarray, h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many of the sorted candidates (ph, pd_) are at or below each key (h, d)."""
    low, high = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    out = high.copy()
    tied = np.flatnonzero(low < high)
    if len(tied):
        for a in np.unique(low[tied]):
            at = tied[low[tied] == a]
            out[at] = a + np.searchsorted(pd_[a : high[at[0]]], d[at], "right")
    return out


def _histogram(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each of the sorted probes."""
    ph, pd_ = _split(probes)
    n = len(probes) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            h, d, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = _place(ph, pd_, h, d)
            np.add.at(size, at, s)
            rows += np.bincount(at, minlength=n)
        own = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(size[own]), pa.array(rows[own])], ["at", "size", "rows"])

    found = keys.mapInArrow(count, "at int, size long, rows long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in found:
        size[r["at"]], rows[r["at"]] = r["size"], r["rows"]
    return [int(x) for x in np.cumsum(size)[:-1]], [int(x) for x in np.cumsum(rows)[:-1]]


def find_cuts(keys: DataFrame, cfg: ShardConfig) -> tuple[list[int], list[int], list[int], list[int]]:
    """(candidates, rows below each, bytes below each, the cuts' indexes among them).

    The first candidate lies below all keys.  ``keys``: h, d, size."""
    row = keys.agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("b")).first()
    total, rows = int(row["s"] or 0), int(row["n"])
    bottom, top = 0, 1 << 128
    below = {bottom: (0, 0), top: (total, rows)}
    if not rows:
        return [bottom], [0], [0], [0] * (cfg.shards - 1)
    first_id, last_id = int(row["a"]), int(row["b"])
    targets = [total * i / cfg.shards for i in range(1, cfg.shards)]
    slack, many = cfg.tolerance * total / cfg.shards, total / (cfg.shards * cfg.ranges)

    def between(lo: int, hi: int) -> list[int]:
        """Candidates inside (lo, hi): between texts if there is room, else between ids."""
        if hi - lo > SPAN:
            a, b = (lo >> 64) + 1, (hi - 1) >> 64
            step = max(1, (b - a + cfg.probes) // (cfg.probes + 1))
            return [x << 64 for x in range(a, b + 1, step)]
        h = lo >> 64
        a, b = max(lo + 1, (h << 64) | (first_id - LOW)), min(hi - 1, (h << 64) | (last_id - LOW) + 1)
        step = max(1, (b - a + cfg.probes) // (cfg.probes + 1))
        return list(range(a, b + 1, step)) if a <= b else []

    while True:
        known = sorted(below)
        sizes = [below[k][0] for k in known]
        want: set[int] = set()
        for t in targets:
            i = max(1, bisect_left(sizes, t))
            if min(abs(sizes[i] - t), abs(sizes[i - 1] - t)) > slack and below[known[i]][1] - below[known[i - 1]][1] > 1:
                want.update(between(known[i - 1], known[i]))
        for lo, hi in zip(known, known[1:], strict=False):
            if below[hi][0] - below[lo][0] > many and below[hi][1] - below[lo][1] > 1:
                want.update(between(lo, hi))
        new = sorted(want - below.keys())
        if not new:
            break
        below |= dict(zip(new, zip(*_histogram(keys, new), strict=True), strict=True))
    known = sorted(below)[:-1]
    sizes = [below[k][0] for k in known] + [total]
    cuts = []
    for t in targets:
        i = max(1, bisect_left(sizes, t))
        cuts.append(min(i if sizes[i] - t < t - sizes[i - 1] else i - 1, len(known)))
    return known, [below[k][1] for k in known], sizes[:-1], cuts


def shard(docs: DataFrame, cfg: ShardConfig = ShardConfig()) -> DataFrame:
    """``docs`` with ``size`` (bytes), ``shard`` and ``slot`` (from 0, without gaps)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.drop("size", "shard", "slot")
    at = prefix(plain)
    keyed = plain.withColumns({f"{at}h": F.xxhash64(text), f"{at}d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)), "size": (F.octet_length(text) + cfg.extra_bytes).cast("long")})
    keys = materialise(keyed.select(F.col(f"{at}h").alias("h"), F.col(f"{at}d").alias("d"), "size"), "keys")
    known, below, _, cuts = find_cuts(keys, cfg)
    ph, pd_ = _split(known)
    cut_at = np.array(cuts)
    shard_of = np.searchsorted(cut_at, np.arange(len(known)), "right")  # cuts at or below a range
    start = np.array([0, *[below[c] if c < len(below) else 0 for c in cuts]])
    base = np.array(below) - start[shard_of]
    # no range is much larger than the others, so that all are split alike
    total = keys.agg(F.sum("size").alias("s")).first()["s"] or 0
    split = max(1, min(-(-total // cfg.part_bytes), cfg.max_parts) // len(known))
    ends_h, ends_d = np.append(ph[1:], np.int64(-LOW - 1)), np.append(pd_[1:], np.int64(-LOW - 1))
    of_one_text = ph == ends_h  # between two ids of one text

    @F.pandas_udf("range int, part int, shard int, base long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for h, d in batches:
            h, d = h.to_numpy(), d.to_numpy()
            i = np.maximum(_place(ph, pd_, h, d) - 1, 0)
            one = of_one_text[i]
            key, low, high = np.where(one, d, h).astype(float), np.where(one, pd_[i], ph[i]).astype(float), np.where(one, ends_d[i], ends_h[i]).astype(float)
            part = np.clip((key - low) / np.maximum(high - low, 1) * split, 0, split - 1).astype(np.int32)
            yield pd.DataFrame({"range": i.astype(np.int32), "part": part, "shard": shard_of[i].astype(np.int32), "base": base[i]})

    placed = keyed.withColumn(f"{at}p", place(f"{at}h", f"{at}d")).withColumns({f"{at}range": F.col(f"{at}p.range"), f"{at}part": F.col(f"{at}p.part"), "shard": F.col(f"{at}p.shard"), f"{at}base": F.col(f"{at}p.base")}).drop(f"{at}p")
    order = F.row_number().over(Window.partitionBy(f"{at}range", f"{at}part").orderBy(f"{at}h", f"{at}d"))
    made = placed.withColumn(f"{at}n", order)
    if split > 1:  # rows of a range's parts before each part: at most ``max_parts`` rows
        found = keys.withColumn(f"{at}p", place("h", "d")).groupBy(F.col(f"{at}p.range").alias(f"{at}range"), F.col(f"{at}p.part").alias(f"{at}part")).agg(F.count("*").alias("n"))
        before = found.select(f"{at}range", f"{at}part", (F.sum("n").over(Window.partitionBy(f"{at}range").orderBy(f"{at}part")) - F.col("n")).alias(f"{at}before"))
        made = made.join(F.broadcast(materialise(before, "parts")), [f"{at}range", f"{at}part"])
    else:
        made = made.withColumn(f"{at}before", F.lit(0))
    return made.withColumn("slot", F.col(f"{at}base") + F.col(f"{at}before") + F.col(f"{at}n") - 1).select(*plain.columns, "size", "shard", "slot")
