"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are runs of ``k`` words; equal k-mers are told apart by their
occurrence number.  Every coordinate has an order of its own over all numbered k-mers:
by their hash with the coordinate's number added to its highest bits without carry
(exclusive or).  The two minimal k-mers of that order are kept in the order in which
they stand in the text, and their tuple is hashed.  Moving passages about changes the
order of tuples, so that the share of equal coordinates follows the edit distance and
not only the shared content.

The hash's highest bits name a class of k-mers, and coordinate j's order begins with
class j, then goes through the others by their number exclusive-or j.  Two k-mers of each
class, the least ones, are therefore all that any coordinate can need: long texts fill
every class, and short ones find the rest in the other classes.

All k-mers of a text meet in the partition its text was sent to: one exchange of
texts, by ranges of ids, serves the neighbour in id order, the numbering and the
minima.  Ranges come from a bounded number of quantiles, between which ids (and, for an
id of very many rows, hashes of texts) are split evenly, so that neither the
driver nor an expression holds anything that grows with the data; there are at most
``max_parts`` ranges, beyond which sorts spill.

Results at the edges: a null text counts as empty; an empty text has no k-mers,
an empty fingerprint of dashes, and a likeness of 1 to another empty one, of 0
to others; a text under ``k`` words is one k-mer, which is every coordinate's; equal
texts have equal fingerprints; rows of equal ids are ordered by their texts' hashes; a
null id comes first; one document is its own successor; an empty table gives an empty
result; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

LOW = -(1 << 63)


@dataclass(frozen=True)
class FingerprintConfig:
    k: int = 2
    #: A power of two.
    coordinates: int = 64
    #: Bits of a packed k-mer that hold the place in the text, and its hash within a class.
    place_bits: int = 28
    hash_bits: int = 28
    #: Bytes of text in a partition; 0: by the executors' memory.
    partition_bytes: int = 0
    #: Quantiles of the ids that are looked up, and ranges in all, at most.
    quantiles: int = 4096
    max_parts: int = 1 << 20


def _partition_bytes(spark: SparkSession, cfg: FingerprintConfig) -> int:
    """A byte of text becomes about 30 bytes of sorted k-mer rows, of original and
    edited text; half of a task's share of unified memory is to hold them."""
    if cfg.partition_bytes:
        return cfg.partition_bytes
    text = spark.conf.get("spark.executor.memory", "1g").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    memory = float(text[:-1]) * unit[text[-1]] if text[-1] in unit else float(text) * (1 << 20)
    cores = int(spark.conf.get("spark.executor.cores", "2"))
    return max(1 << 20, int(memory * 0.6 * 0.5 / cores / 60))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below the key, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]
    array = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: F.when((at + s <= len(bounds)) & (F.get(array, at + s - 1) <= key), at + s).otherwise(at),
    )


def _part_of(rows: DataFrame, partitions: int, cfg: FingerprintConfig) -> Column:
    """The range of (key, tie): it never falls as these rise.

    Between two quantiles ids are split evenly; an id that is several quantiles at once
    is split evenly by ``tie``."""
    parts = min(4 * partitions, cfg.max_parts)
    n = min(parts, cfg.quantiles)
    split = -(-parts // n)
    found = sorted(rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("p")).first()["p"] or []) if n > 1 else []
    bounds = sorted(set(found))
    often = [found.count(b) if split > 1 else found.count(b) - 1 for b in bounds]  # ranges of a bound's own id
    often = [o * split if o > 0 else 0 for o in often]
    first, starts = split, []
    for o in often:  # of each bound: its own id's ranges, then those up to the next bound
        starts.append(first)
        first += o + split
    at = _range_of(F.col("key"), bounds)
    if not bounds:
        return F.lit(0)
    value = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i)
    own, low, high = value(often, at - 1), value(bounds, at - 1), F.coalesce(value(bounds, at), F.lit((1 << 63) - 1))
    by_tie = F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * own)
    # differences as doubles: monotone, and without overflow
    by_id = F.floor((F.col("key").cast("double") - low.cast("double")) / F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0)) * split)
    inside = F.when((own > 0) & (F.col("key") == low), F.least(by_tie, own - 1)).otherwise(own + F.least(F.greatest(by_id, F.lit(0)), F.lit(split - 1)))
    # never null, as the planner can tell: a filter of nulls would make one reader's exchange another
    return F.coalesce(F.when(at == 0, F.lit(0)).otherwise(value(starts, at - 1) + inside).cast("int"), F.lit(0))


def neighbours(docs: DataFrame, cfg: FingerprintConfig) -> DataFrame:
    """(part, row, doc_id, text, next_text): each text and the next one's by id; the
    result is partitioned by ``part``, a range of ids, and ``row`` counts within it."""
    spark = docs.sparkSession
    # the id itself travels as has_id and key, which the order needs anyway: all readers of
    # the exchange then need the same columns, and Spark makes it once
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(LOW)).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _partition_bytes(spark, cfg)))
    partitions = min(partitions, cfg.max_parts)
    rows = rows.withColumn("part", _part_of(rows, partitions, cfg))
    # a row for each range: the first text of the range after it (after the last: of the first)
    place = F.struct("has_id", "key", "tie")
    heads = rows.groupBy("part").agg(F.min(place).alias("head"))
    along = Window.orderBy("part")
    follow = heads.select(F.col("part").alias("last_part"), F.coalesce(F.lead("head").over(along), F.first("head").over(along)).alias("next"))
    follow = materialise(follow.select("last_part", F.col("next.has_id").alias("next_has"), F.col("next.key").alias("next_key"), F.col("next.tie").alias("next_tie")), "ranges")
    meets = (F.col("key") == F.col("next_key")) & (F.col("tie") == F.col("next_tie")) & (F.col("has_id") == F.col("next_has"))
    # at most ``max_parts`` rows of 32 bytes
    head = rows.join(F.broadcast(follow), meets).groupBy("last_part").agg(F.min("text").alias("head"))
    order = Window.partitionBy("part").orderBy("has_id", "key", "tie", "text")
    own = rows.repartition(partitions, "part").withColumns({"row": F.row_number().over(order), "follower": F.lead("text").over(order)})
    last = own.join(head, F.col("part") == F.col("last_part"), "left")
    doc_id = F.when(F.col("has_id"), F.col("key"))
    return last.select("part", "row", doc_id.alias("doc_id"), "text", F.coalesce("follower", "head", F.lit("")).alias("next_text"))


def with_edit(rows: DataFrame) -> DataFrame:
    """Adds n_chars and ``edited``: the last quarter of the code points replaced by the
    first as many of the next text."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - quarter).cast("int")), F.substring("next_text", F.lit(1), quarter))
    return rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)


def _words(text: str | Column) -> Column:
    return F.split(F.translate(text, "\n\t\r", "   "), " ")


def _kmers(words: Column, cfg: FingerprintConfig) -> Column:
    """Hashes of all runs of k words (of all words, where there are fewer)."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    out = hashes
    for i in range(1, cfg.k):
        rest = F.slice(hashes, i + 1, F.greatest(F.size(hashes) - i, F.lit(0)))
        out = F.zip_with(out, rest, lambda a, b: F.xxhash64(a, b))
    return F.slice(out, 1, F.greatest(F.size(out) - (cfg.k - 1), F.lit(1)))


#: Whose a k-mer is; a sum counts the text's in its lower half and the edited form's in its upper one.
TEXT, EDITED = 1, 1 << 32
BOTH = TEXT | EDITED


def kmer_rows(rows: DataFrame, cfg: FingerprintConfig) -> DataFrame:
    """(part, row, of, pos, kmer): k-mers that the text and its edited form have in common
    (before the edit, at the same places) once, the others of either."""
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int"))
    # the word at the edit may differ, so the ones before it are common
    common = F.greatest(F.size(_words(kept)) - cfg.k, F.lit(0))
    rows = rows.select("part", "row", _kmers(_words("text"), cfg).alias("a"), _words("edited").alias("w"), common.cast("int").alias("c"), (F.col("text") == "").alias("no_text"), (F.col("edited") == "").alias("no_edited"))
    rows = rows.withColumn("c", F.when(F.col("no_text") | F.col("no_edited"), 0).otherwise(F.col("c")))
    rows = rows.withColumn("b", _kmers(F.slice("w", F.col("c") + 1, F.greatest(F.size("w") - F.col("c"), F.lit(0))), cfg))

    def placed(of: int, x: Column, first: Column) -> Column:
        return F.transform(x, lambda v, i: F.struct(F.lit(of).cast("long").alias("of"), (first + i).alias("pos"), v.alias("kmer")))

    none = F.array().cast("array<struct<of:bigint,pos:int,kmer:bigint>>")
    own = F.slice("a", F.col("c") + 1, F.greatest(F.size("a") - F.col("c"), F.lit(0)))
    shared = placed(BOTH, F.slice("a", F.lit(1), F.col("c")), F.lit(0))
    each = F.concat(shared, F.when(F.col("no_text"), none).otherwise(placed(TEXT, own, F.col("c"))), F.when(F.col("no_edited"), none).otherwise(placed(EDITED, F.col("b"), F.col("c"))))
    return rows.select("part", "row", F.inline(each))


def _likeness(a: str, b: str) -> Column:
    """Share of equal coordinates; 1 if neither text has any k-mer."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda p: p))
    return same.cast("double") / F.size(a)


def _show(a: str) -> Column:
    """The fingerprint as text: 8 hexadecimal digits a coordinate."""
    return F.array_join(F.transform(a, lambda x: F.when(x.isNull(), F.lit("--------")).otherwise(F.lpad(F.hex(x.cast("bigint") + (1 << 31)), 8, "0"))), "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def fingerprints(docs: DataFrame, cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """(part, row, doc_id, n_chars, edited_sha256, mark, edited_mark): the two marks are
    arrays of ``coordinates`` 32-bit numbers, null where there is no k-mer."""
    rows = with_edit(neighbours(docs, cfg))
    classes, within = cfg.coordinates, cfg.place_bits + cfg.hash_bits
    place = (1 << cfg.place_bits) - 1
    top = 64 - (classes.bit_length() - 1)  # bits of a hash below its class
    own = lambda h: F.shiftrightunsigned(h, top)
    cell = lambda h: (F.col("row") * F.lit(classes).cast("long") + own(h)).alias("cell")
    row_and_class = (F.shiftright("cell", 64 - top).cast("int").alias("row"), F.col("cell").bitwiseAND(classes - 1).cast("int").alias("j"))
    of = F.col("of")
    in_text, in_edited = of.bitwiseAND(TEXT) != 0, of.bitwiseAND(EDITED) != 0
    of_text, of_edited = lambda total: F.col(total).bitwiseAND(EDITED - 1), lambda total: F.shiftright(total, 32)
    # all k-mers are sorted, so that their rows are narrow: the cell has the text's row and the
    # k-mer's class, ``low`` the rest of the k-mer; a window's sum of anything but a column
    # would add that to the rows before they are sorted
    keyed = kmer_rows(rows, cfg).select("part", cell("kmer"), F.col("kmer").bitwiseAND((1 << top) - 1).alias("low"), "pos", "of")
    # a k-mer's first occurrence has its own hash, so that the order which numbers k-mers also
    # tells the two least of each class; what repeats has the hash of k-mer and number
    so_far = Window.partitionBy("cell", "part", "low").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.when(of == EDITED, of_edited("seen")).otherwise(of_text("seen"))
    numbered = keyed.withColumn("seen", F.sum("of").over(so_far)).withColumn("nth", nth).withColumn("once", F.when(F.col("nth") == 1, of).otherwise(F.lit(0)))
    least = Window.partitionBy("cell", "part").orderBy("low", "pos").rowsBetween(Window.unboundedPreceding, 0)
    few = numbered.withColumn("rank", F.sum("once").over(least))
    few = few.where((F.col("nth") > 1) | in_text & (of_text("rank") <= 2) | in_edited & (of_edited("rank") <= 2))
    kmer = F.shiftleft(F.col("cell").bitwiseAND(classes - 1), top).bitwiseOR(F.col("low"))
    ranked = few.select("part", row_and_class[0], "of", "pos", F.when(F.col("nth") == 1, kmer).otherwise(F.xxhash64(kmer, F.col("nth"))).alias("h"))
    # a k-mer as one number: its class, its hash within the class, its place in the text
    short = F.shiftrightunsigned("h", top - cfg.hash_bits).bitwiseAND((1 << cfg.hash_bits) - 1)
    packed = F.shiftleft(own("h"), within).bitwiseOR(F.shiftleft(short, cfg.place_bits)).bitwiseOR(F.col("pos").cast("long").bitwiseAND(place))
    ranked = ranked.select("part", "of", packed.alias("v"), cell("h"))
    # the two least of each class, of the text and of the edited text
    least = Window.partitionBy("cell", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    few = ranked.withColumn("rank", F.sum("of").over(least))
    few = few.select("part", *row_and_class, "v", (in_text & (of_text("rank") <= 2)).alias("t"), (in_edited & (of_edited("rank") <= 2)).alias("e")).where("t or e")
    ends = [f(F.when(F.col(w), F.col("v"))).alias(f"{w}{i}") for w in ("t", "e") for i, f in enumerate((F.min, F.max))]
    cells = few.groupBy("part", "row", "j").agg(*ends)
    # at most a row for each class: arrays of ``coordinates`` entries a text
    marks = cells.groupBy("part", "row").agg(F.collect_list(F.struct("j", "t0", "t1", "e0", "e1")).alias("x"))
    by = F.map_from_arrays(F.transform("x", lambda x: x["j"]), F.col("x"))

    def every(w: str) -> Column:
        return F.array_compact(F.flatten(F.transform("x", lambda x: F.array(x[f"{w}0"], F.when(x[f"{w}0"] != x[f"{w}1"], x[f"{w}1"])))))

    marks = marks.withColumns({"by": by, "all_t": every("t"), "all_e": every("e")})

    def tuple_hash(a: Column, b: Column) -> Column:
        """Of one or two packed k-mers, in the order of their places."""
        ha, hb = F.shiftright(a, cfg.place_bits), F.shiftright(b, cfg.place_bits)
        both = F.when(a.bitwiseAND(place) <= b.bitwiseAND(place), F.xxhash64(ha, hb)).otherwise(F.xxhash64(hb, ha))
        h = F.when(b.isNull(), F.xxhash64(ha)).otherwise(both)
        return F.when(a.isNotNull(), (F.pmod(h, F.lit(1 << 32)) - (1 << 31)).cast("int"))

    def least_two(w: str) -> Column:
        """For each coordinate its one or two least k-mers: those of its class, or, where that
        has one or none, the least of all in the coordinate's order."""
        kept = F.col(f"all_{w}")

        def made(j: Column) -> Column:
            mask = F.shiftleft(j.cast("long"), within)
            ordered = F.slice(F.array_sort(F.transform(kept, lambda v: v.bitwiseXOR(mask))), 1, 2)
            rest = F.transform(ordered, lambda v: v.bitwiseXOR(mask))
            return _let(F.try_element_at("by", j), lambda own: F.when(own[f"{w}0"] < own[f"{w}1"], F.array(own[f"{w}0"], own[f"{w}1"])).otherwise(rest))

        return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), made)

    marks = marks.select("part", "row", least_two("t").alias("two_t"), least_two("e").alias("two_e"))
    coordinate = lambda w: F.transform(f"two_{w}", lambda p: tuple_hash(F.get(p, 0), F.get(p, 1)))
    marks = marks.select(F.col("part").alias("__part"), F.col("row").alias("__row"), coordinate("t").alias("mark"), coordinate("e").alias("edited_mark"))
    base = rows.select("part", "row", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    none = F.array(*[F.lit(None).cast("int")] * classes)
    out = base.join(marks, (F.col("part") == F.col("__part")) & (F.col("row") == F.col("__row")), "left")
    return out.select("part", "row", "doc_id", "n_chars", "edited_sha256", F.coalesce("mark", none).alias("mark"), F.coalesce("edited_mark", none).alias("edited_mark"))


#: Both sides of the operator's own join are dealt by ``part`` already; by default Spark
#: would deal them anew by all of the join's keys.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def compare(docs: DataFrame, cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next: likeness to the edited and to the next text's fingerprint."""
    spark = docs.sparkSession
    before = spark.conf.get(CO_PARTITION, "true")
    spark.conf.set(CO_PARTITION, "false")
    try:
        order = Window.partitionBy("part").orderBy("row")
        prints = fingerprints(docs, cfg).withColumn("follower", F.lead("mark").over(order))
        prints = prints.withColumns({"near_edited": _likeness("mark", "edited_mark"), "near_next": F.when(F.col("follower").isNotNull(), _likeness("mark", "follower"))}).drop("follower")
        made = materialise(prints, "fingerprints")
    finally:
        spark.conf.set(CO_PARTITION, before)
    # the last text of each range meets the first of the next one: a row a range
    heads = made.where("row = 1").select("part", "mark")
    along = Window.orderBy("part")
    parts = heads.select("part").withColumn("last_part", F.coalesce(F.lag("part").over(along), F.max("part").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = heads.join(parts, "part").select("last_part", F.col("mark").alias("head"))
    last = made.where("near_next is null").join(heads, F.col("part") == F.col("last_part")).withColumn("near_next", _likeness("mark", "head"))
    out = made.where("near_next is not null").unionByName(last.select(*made.columns))
    return out.select("doc_id", "n_chars", "edited_sha256", _show("mark").alias("fingerprint"), _show("edited_mark").alias("edited_fingerprint"), "near_edited", "near_next")
