"""WARC fixity audit with Merkle trees.

Every record is serialised as a WARC record and hashed.  Records are leaves in
the order of their ids; a node of level L covers the ids of one block of
32 ** L, that is one range of offsets of the archive file, and hashes its
children's names, lengths and hashes in order.  Two replicas agree if their roots
do; otherwise only children of nodes that differ are compared, level by level,
down to the records.

Nodes name blocks of ids, not ordinals, so that a lost record changes its own
branch and no other.  A node has at most 32 children (a leaf: one for each
version of a record), so no group grows with the data.

Results at the edges: ids are numbers; html of any length is hashed whole; ties do not
arise, as leaves are in the order of ids; null url or html count as empty; a null id is replaced by a
negative number from a hash of the content; rows repeated n times are one leaf
that also hashes n; several versions of one id are compared as a whole; an
archive without records has no root and differs from any other; empty against
empty is no row; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class FixityConfig:
    #: Bits of a level: 5 for 32 children.
    bits: int = 5
    #: Levels that lie within one archive file.
    file_levels: int = 2


def warc_record(url: Column, payload: Column) -> Column:
    """The text of a WARC resource record."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """(id, page_id, length, digest), a row for every id: versions and repeats of an id
    are hashed together, in the order of their hashes."""
    record = warc_record(F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    own = F.coalesce("page_id", -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 40)))
    rows = rows.withColumn("id", own).groupBy("id", "page_id", "digest").agg(F.min("length").alias("each"), F.count("*").alias("n"))
    made = rows.groupBy("id", "page_id").agg(F.sum(F.col("each") * F.col("n")).alias("length"), F.sort_array(F.collect_list(F.struct("digest", "n"))).alias("x"))
    several = F.sha2(F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["digest"], x["n"].cast("string"))), ","), 256)
    plain = (F.size("x") == 1) & (F.col("x")[0]["n"] == 1)
    return made.select("id", "page_id", "length", F.when(plain, F.col("x")[0]["digest"]).otherwise(several).alias("digest"))


def parents(nodes: DataFrame, cfg: FixityConfig) -> DataFrame:
    """The next level of (id, length, digest)."""
    part = F.struct("id", "length", "digest")
    made = nodes.groupBy(F.shiftright("id", cfg.bits).alias("id")).agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(part)).alias("x"))
    line = F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["id"].cast("string"), x["length"].cast("string"), x["digest"])), ",")
    return made.select("id", "length", F.sha2(line, 256).alias("digest"))


def build(pages: DataFrame, cfg: FixityConfig, levels: int | None = None) -> list[DataFrame]:
    """The tree, leaves first; ``levels``: of the other replica, to have roots alike."""
    tree = [materialise(leaves(pages), "leaves")]
    while True:
        ends = tree[-1].agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
        single = ends["a"] is None or ends["a"] == ends["b"] or (ends["a"] == -1 and ends["b"] == 0)
        if single and len(tree) >= (levels or 1):
            return tree
        tree.append(materialise(parents(tree[-1].select("id", "length", "digest"), cfg), "nodes"))


def audit(primary: DataFrame, replica: DataFrame, cfg: FixityConfig = FixityConfig()) -> DataFrame:
    """(page_id, status, file, offset, length, digest, replica_length, replica_digest) of
    every record that differs: 'corrupt', 'missing' (in the replica) or 'extra'.
    ``offset`` is the record's place in its file of the primary (of the replica, for
    an extra one)."""
    one = build(primary, cfg)
    two = build(replica, cfg, len(one))
    while len(one) < len(two):
        one.append(materialise(parents(one[-1].select("id", "length", "digest"), cfg), "nodes"))
    bad: DataFrame | None = None
    for level in range(len(one) - 1, -1, -1):
        a, b = one[level], two[level]
        if bad is not None:  # only what lies under nodes that differ
            under = bad.select(F.col("id").alias("up"))
            a = a.withColumn("up", F.shiftright("id", cfg.bits)).join(under, "up", "left_semi").drop("up")
            b = b.withColumn("up", F.shiftright("id", cfg.bits)).join(under, "up", "left_semi").drop("up")
        b = b.select("id", *[F.col(c).alias(f"replica_{c}") for c in b.columns if c != "id"])
        bad = a.join(b, "id", "full").where(~F.col("digest").eqNullSafe(F.col("replica_digest")))
        if level:
            bad = materialise(bad.select("id"), "differing")
    status = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    file_bits = cfg.bits * cfg.file_levels
    bad = materialise(bad.withColumn("status", status).withColumn("file", F.shiftright("id", file_bits)), "differing")
    # offsets are needed in files with differences alone
    order = Window.partitionBy("file").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)

    def offsets(tree: list[DataFrame], name: str) -> DataFrame:
        rows = tree[0].withColumn("file", F.shiftright("id", file_bits)).join(bad.select("file").distinct(), "file", "left_semi")
        return rows.select("id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias(name))

    out = bad.join(offsets(one, "here"), "id", "left").join(offsets(two, "there"), "id", "left")
    return out.select(F.coalesce("page_id", "replica_page_id").alias("page_id"), "status", "file", F.coalesce("here", "there").alias("offset"), "length", "digest", "replica_length", "replica_digest")
