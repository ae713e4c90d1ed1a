"""Near-duplicates by DartMinHash signatures and banded joining.

A text is the weighted set of its word shingles, each weighted by its count, and
two texts are near-duplicates if their weighted Jaccard likeness (sum of minima
over sum of maxima) is at least ``threshold``.

Signatures.  Each element owns a plane of weight by rank, cut along the weight
axis into cells of width 1, 1, 2, 4, ...; in every cell darts fall as a Poisson
process that hashes of element, cell and dart number alone determine, so all
texts see the same darts.  A dart hits a text if its weight lies below the
element's weight; darts are thrown up to the rank at which about
k (ln k + 4) of them hit.  Each dart has a coordinate; the earliest dart of
each coordinate is the signature's entry.  Texts with a coordinate left empty
throw on to twice the rank.

Joining.  Equal texts are one from the start, whatever their ids.  Bands of signature
entries are bucket keys, and the pairs of a bucket are the candidates; classes are the
components of those that are near-duplicates on their whole texts.  Pairs that are
connected already need no look, which keeps large groups of copies linear:

1. every member of a bucket meets the bucket's hub (its smallest text);
2. components that still meet others in a bucket with ``large`` members or more are
   compared with all of those others, once for all their buckets;
3. what else is left in buckets that hold several components is compared pair by pair.

Nothing is capped.  The second and third step work in units of two blocks of bounded
bytes, out of which only links come.  Their cost is quadratic in buckets of many different
texts that are no near-duplicates (bands of 5 tie texts of likeness 0.5 in some bucket with
chance 0.64); what grows is the number of units, not their size.

Results at the edges: a null text counts as empty; texts without words (empty ones,
white space) are one class; texts of fewer words than a shingle have one shingle of
all; texts of any length are read whole; rows that share an id but not a text are
different documents, each in the class of its own text (a class is named by its smallest
id, so that two classes share a name if one id has a text in either and no smaller id is
there); rows with a null id are left out of ``near_duplicates`` (they have no name to
report) and kept by ``deduplicate``; ties of ids go to the smaller hash of the text; an
empty table gives an empty result; extra columns pass through ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prefix, slices
from .hashing import counted, mix, shingles


@dataclass(frozen=True)
class DedupConfig:
    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5
    #: Members that stream past one copy of their hub.
    chunk: int = 128
    #: Members from which a component in a bucket is compared as a whole.
    large: int = 96
    #: Bytes of items of about each of the two blocks that meet in one unit of work.
    block_bytes: int = 1 << 19

    @property
    def k(self) -> int:
        return self.bands * self.rows


#: A character that is not white space.
WORD = r"[^\s\p{Z}\x1c-\x1f\x85]"


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Darts:
    def __init__(self, k: int):
        self.k, self.darts = k, k * (np.log(k) + 4)

    @staticmethod
    def _cells(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(element, number, lower border, width) of the cells under each weight."""
        count = np.where(weight <= 1, 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1)
        element = np.repeat(np.arange(len(weight)), count)
        number = np.arange(len(element)) - np.repeat(np.cumsum(count) - count, count)
        lower = np.where(number == 0, 0.0, 2.0 ** (number - 1))
        return element, number, lower, np.where(number == 0, 1.0, lower)

    def _throw(self, seed, width, theta, out) -> None:
        """Append (cell, rank, dart's hash) of all darts below each cell's rank."""
        many = theta * width > 8
        for at in (np.flatnonzero(~many), np.flatnonzero(many)):
            at = at.astype(np.int64)
            rank, r = np.zeros(len(at)), 0
            step = 1
            if len(at) and many[at[0]]:
                step = 32
            while len(at):
                number = np.arange(r, r + step, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    h = mix(seed[at][:, None] + number * np.uint64(0xD1342543DE82EF95))
                gaps = -np.log(_uniform(h)) / width[at][:, None]
                ranks = np.cumsum(np.concatenate([rank[:, None], gaps], 1), 1)[:, 1:]
                i, j = np.nonzero(ranks < theta[at][:, None])
                out.append((at[i], ranks[i, j], mix(h[i, j])))
                rank, r = ranks[:, -1], r + step
                more = rank < theta[at]
                at, rank = at[more], rank[more]

    def signatures(self, h: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """(n, k) of n texts; those without elements keep zeros."""
        sig = np.zeros((n, self.k), np.uint32)
        total = np.bincount(owner, weight, n)
        theta = self.darts / np.maximum(total, 1e-12)
        open_ = np.flatnonzero(total > 0)
        while len(open_):
            take = np.isin(owner, open_) if len(open_) < n else np.ones(len(owner), bool)
            hh, ww, oo = h[take], weight[take].astype(np.float64), owner[take]
            element, number, lower, width = self._cells(ww)
            seed = mix(hh[element] ^ mix(number.astype(np.uint64)))
            out: list = []
            self._throw(seed, width, theta[oo[element]], out)
            cell, rank, dart = (np.concatenate(x) for x in zip(*out, strict=True))
            hit = lower[cell] + _uniform(mix(dart ^ np.uint64(0x5851F42D4C957F2D))) * width[cell] < ww[element[cell]]
            cell, rank, dart = cell[hit], rank[hit], dart[hit]
            group = oo[element[cell]] * self.k + ((dart >> np.uint64(33)) % np.uint64(self.k)).astype(np.int64)
            first = np.full(n * self.k, np.inf)
            np.minimum.at(first, group, rank)
            win = rank == first[group]
            flat = sig.reshape(-1)
            flat[group[win]] = dart[win].astype(np.uint32) | np.uint32(1)
            empty = np.isinf(first).reshape(n, self.k).any(1)
            open_ = open_[empty[open_]]
            theta[open_] *= 2
        return sig


def signatures(docs: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(doc_id, t1, t2, buckets): a 128-bit hash of the text (of all texts without words
    the same), and the keys of its bands' buckets (null for texts without words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.where("doc_id is not null").select("doc_id", *text_key(text), text.alias("text"))
    darts = Darts(cfg.k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            texts = batch.column(3).to_pylist()
            h, owner, weight = counted(*shingles(texts, cfg.words))
            bands = darts.signatures(h, owner, weight, len(texts)).reshape(len(texts), cfg.bands, cfg.rows).astype(np.uint64)
            key = mix(np.broadcast_to(np.arange(cfg.bands, dtype=np.uint64), bands.shape[:2]))
            for r in range(cfg.rows):
                key = mix(key ^ bands[:, :, r])
            has = np.bincount(owner, minlength=len(texts)) > 0
            packed = pa.array([k if x else None for k, x in zip(key.view(np.int64), has, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["doc_id", "t1", "t2", "buckets"])

    made = rows.mapInArrow(run, f"doc_id {_kind(docs)}, t1 long, t2 long, buckets array<long>")
    return made.withColumns({t: F.when(F.col("buckets").isNull(), F.lit(0)).otherwise(F.col(t)) for t in ("t1", "t2")})


def text_key(text) -> tuple:
    """Two 64-bit hashes of a text."""
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def item_sets(texts: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(node, items, bytes) of (node, text): hashes of the text's shingles numbered by occurrence,
    so that the sets' Jaccard likeness is the weighted likeness of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            texts = batch.column(1).to_pylist()
            h, owner, count = counted(*shingles(texts, cfg.words))
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            h, owner = mix(np.repeat(h, count) + nth.astype(np.uint64)), np.repeat(owner, count)
            order = np.lexsort((h, owner))
            cut = np.searchsorted(owner, np.arange(1, len(texts)))
            items = [x.astype("<u8").tobytes() for x in np.split(h[order], cut)]
            size = pa.array([len(x) for x in items], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary()), size], ["node", "items", "bytes"])

    return texts.select("node", "text").mapInArrow(run, "node long, items binary, bytes long")


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets have at least this Jaccard likeness."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False  # the likeness is at most the ratio of the sizes
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= threshold * (len(a) + len(b) - common)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def star_links(pairs: DataFrame, items: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(a, b) of those (hub, node) whose whole texts are near-duplicates.  A hub's members
    are dealt into chunks; every chunk streams past the hub's one set."""
    degree = materialise(pairs.groupBy("hub").agg(F.ceil(F.count("*") / cfg.chunk).cast("int").alias("chunks")), "degrees")
    dealt = materialise(pairs.join(degree, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")), "dealt")
    sent = dealt.join(items, "node").select("hub", "chunk", "node", "items")
    hubs = dealt.select("hub", "chunk").distinct().join(items.withColumnRenamed("node", "hub"), "hub").select("hub", "chunk", F.lit(None).cast("long").alias("node"), "items")
    rows = sent.union(hubs).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("node").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, "<u8")
        for batch in batches:
            found = []
            for hub, node, items in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if node is None:
                    own = np.frombuffer(items, "<u8")
                elif alike(own, np.frombuffer(items, "<u8"), cfg.threshold):
                    found.append((hub, node))
            yield _pairs(found)

    return rows.mapInArrow(run, "a long, b long")


def _unit_links(key: tuple, held: list[tuple], cfg: DedupConfig) -> list[tuple[int, int]]:
    """Links between the components in one unit: block i of a job against block j, or
    itself.  ``held``: (block, comp, items) each.  An index of the right side's items
    gives a left text's common items with all of them at once."""
    _, i, j = key
    block, comp, items = zip(*held, strict=True)
    left = [k for k in range(len(held)) if block[k] == i]
    right = np.array([k for k in range(len(held)) if block[k] == j], np.int64)
    if not len(left) or not len(right) or len(set(comp)) < 2:
        return []
    sets, comps = [np.frombuffer(x, "<u8") for x in items], np.array(comp)
    size = np.array([len(s) for s in sets])
    every = np.concatenate([sets[k] for k in right])
    order = np.argsort(every, kind="stable")
    owner = np.repeat(np.arange(len(right)), size[right])[order]
    known, first = np.unique(every[order], return_index=True)
    count = np.diff(np.append(first, len(every)))
    root: dict[int, int] = {c: c for c in comp}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x in left:
        may = comps[right] != comps[x]
        if i == j:
            may &= right > x
        if not may.any():
            continue
        at = np.minimum(np.searchsorted(known, sets[x]), len(known) - 1)
        at = at[known[at] == sets[x]]
        many = count[at]
        met = np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        common = np.bincount(owner[met], minlength=len(right))
        for k in np.flatnonzero(may & (common >= cfg.threshold * (size[x] + size[right] - common))).tolist():
            a, b = comp[x], comp[right[k]]
            ra, rb = find(a), find(b)
            if ra != rb:
                root[ra] = rb
                out.append((a, b))
    return out


def unit_links(units: DataFrame, items: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(a, b): links between the components in units.  ``units``: job, i, j, block, node, comp."""
    rows = units.join(items, "node").select("job", "i", "j", "block", "comp", "items")
    rows = rows.repartition("job", "i", "j").sortWithinPartitions("job", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found = []
            for job, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (job, i, j) != key:
                    if len(held) > 1:
                        found += _unit_links(key, held, cfg)
                    key, held = (job, i, j), []
                held.append(row)
            yield _pairs(found)
        yield _pairs(_unit_links(key, held, cfg) if len(held) > 1 else [])

    return rows.mapInArrow(run, "a long, b long")


def cross_links(members: DataFrame, items: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(a, b): links between components that meet in a bucket, from comparing all pairs of
    different components there.  ``members``: bucket, node, comp, bytes.

    Components of ``large`` members in a bucket are taken out of it: they are jobs of
    their own, which compare those members, of whichever buckets, with all others they
    met there.  The rest of a bucket is one job.  Jobs are dealt into blocks of about
    ``block_bytes`` by a hash, and every pair of blocks is one unit of work."""
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    sizes = sizes.join(members.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("bucket"), "bucket")
    sizes = materialise(sizes.withColumn("big", F.col("k") >= cfg.large), "sizes")
    tagged = materialise(members.join(sizes.drop("k"), ["bucket", "comp"]), "tagged")
    big = sizes.where("big").select("bucket", F.col("comp").alias("job"))
    own = tagged.where("big").select(F.col("comp").alias("job"), "node", "comp", "bytes").distinct()
    met = tagged.join(big, "bucket").where("comp != job").select("job", "node", "comp", "bytes").distinct()
    sides = materialise(own.withColumn("side", F.lit(0)).unionByName(met.withColumn("side", F.lit(1))), "sides")

    def blocks(total) -> F.Column:
        return F.ceil(total / cfg.block_bytes).cast("int")

    each = sides.groupBy("job").agg(*[blocks(F.sum(F.when(F.col("side") == k, F.col("bytes")))).alias(f"n{k}") for k in (0, 1)])
    sides = sides.join(materialise(each, "jobs"), "job")
    block = F.when(F.col("side") == 0, F.pmod(F.xxhash64("node"), "n0")).otherwise(F.col("n0") + F.pmod(F.xxhash64("node"), F.col("n1"))).cast("int")
    other = F.when(F.col("side") == 0, F.sequence("n0", F.col("n0") + F.col("n1") - 1)).otherwise(F.sequence(F.lit(0), F.col("n0") - 1))
    apart = sides.withColumn("block", block).withColumn("with", F.explode(other))

    rest = tagged.where("not big").withColumnRenamed("bucket", "job")
    each = rest.groupBy("job").agg(blocks(F.sum("bytes")).alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y")
    rest = rest.join(materialise(each.select("job", "n"), "jobs"), "job")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    # a component's id and a bucket's key may be the same number, so that the two are apart
    units = [x.select("job", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "comp") for x in (apart, rest)]
    return unit_links(units[0], items, cfg).union(unit_links(units[1], items, cfg))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's
    smallest node.  Alternates large and small stars.  Each iteration is written to
    the shared folder, and so are the nodes' minima: the join of a hub's many links
    with its minimum is then one that the planner can split."""

    def both(e):
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    e = materialise(e, "links")
    while True:
        # stars: no node has two smaller neighbours, or one and a larger one
        centres = e.select(F.col("b").alias("c")).distinct()
        open_ = e.groupBy("a").agg(F.count("*").alias("k")).join(centres, F.col("a") == F.col("c"), "left").where("k > 1 or c is not null")
        if not open_.limit(1).count():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
        # large star: a node's larger neighbours go to its smallest neighbour (or itself)
        near = both(e)
        least = materialise(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialise(large, "links")
        # small star: a node's smaller neighbours and itself go to the smallest of them
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")


def classes(docs: DataFrame, cfg: DedupConfig) -> tuple[DataFrame, DataFrame]:
    """((doc_id, t1, t2) of the rows, (t1, t2, text_id, node, root) of the distinct texts)."""
    sigs = materialise(signatures(docs, cfg), "signatures")
    texts = sigs.groupBy("t1", "t2").agg(F.min("doc_id").alias("text_id"), F.first("buckets").alias("buckets"))
    texts = materialise(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    members = texts.where("buckets is not null").select("node", F.explode("buckets").alias("bucket"))
    hubs = materialise(members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    members = materialise(members.join(hubs, "bucket").select("bucket", "hub", "n", "node"), "members")
    # one row of each text that met another, by its smallest id
    active = texts.join(members.select("node").distinct(), "node", "left_semi").select(F.col("text_id").alias("doc_id"), "t1", "t2", "node")
    source = docs.where("doc_id is not null").select("doc_id", *text_key(F.coalesce("text", F.lit(""))), "text")
    own = source.join(active, ["doc_id", "t1", "t2"]).groupBy("node").agg(F.first("text").alias("text"))
    items = materialise(item_sets(own, cfg), "items")
    links = materialise(star_links(members.where("node != hub").select("hub", "node").distinct(), items.select("node", "items"), cfg), "found")
    # in a bucket of two there is no other pair
    roots = materialise(components(links), "roots")
    left = members.where("n > 2").select("bucket", "node").join(roots, "node", "left").join(items.select("node", "bytes"), "node")
    left = materialise(left.select("bucket", "node", F.coalesce("root", "node").alias("comp"), "bytes"), "members")
    links = links.union(materialise(cross_links(left, items.select("node", "items"), cfg), "found"))
    roots = components(links)
    named = texts.join(roots, "node", "left").select("t1", "t2", "text_id", "node", F.coalesce("root", "node").alias("root"))
    return sigs.select("doc_id", "t1", "t2"), materialise(named, "named")


def near_duplicates(docs: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """(doc_id, text_id, class_id), a row per distinct id and text: the smallest ids of
    equal texts and of the near-duplicate class."""
    rows, named = classes(docs, cfg)
    least = materialise(named.groupBy("root").agg(F.min("text_id").alias("class_id")), "classes")
    named = materialise(named.join(least, "root").select("t1", "t2", "text_id", "class_id"), "named")
    return rows.distinct().join(named, ["t1", "t2"]).select("doc_id", "text_id", "class_id")


def deduplicate(docs: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """``docs`` with one row of each class, the one of the smallest id (of several texts
    of that id in the class, the one of the smallest hash); rows with a null id stay."""
    _, named = classes(docs, cfg)
    at = prefix(docs)
    keep = named.groupBy("root").agg(F.min(F.struct("text_id", "t1", "t2")).alias("k"))
    keep = materialise(keep.select(F.col("k.text_id").alias(f"{at}id"), F.col("k.t1").alias(f"{at}t1"), F.col("k.t2").alias(f"{at}t2")), "keep")
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.where("doc_id is not null").withColumns(dict(zip((f"{at}a", f"{at}b"), text_key(text), strict=True)))
    t1, t2, a, b = (F.col(f"{at}{c}") for c in ("t1", "t2", "a", "b"))
    wordless = (t1 == 0) & (t2 == 0)  # the one class whose texts may differ
    met = known.join(keep, (F.col("doc_id") == F.col(f"{at}id")) & ((a == t1) & (b == t2) | wordless & ~text.rlike(WORD)))
    one = F.row_number().over(Window.partitionBy(f"{at}id", t1, t2).orderBy(a, b))
    return met.withColumn(f"{at}n", one).where(F.col(f"{at}n") == 1).select(*docs.columns).unionByName(docs.where("doc_id is null"))
