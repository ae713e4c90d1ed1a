"""Nulls, empty and very long texts, ties, repeats, empty tables, clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orrery.llm.fingerprint import FingerprintConfig, compare
from orrery.llm.fixity import audit
from orrery.llm.html_text import extract
from orrery.llm.language import LanguageConfig, fit_language, predict_language
from orrery.llm.mixing import MixingConfig, mix
from orrery.llm.near_dedup import deduplicate, near_duplicates
from orrery.llm.packing import PackingConfig, pack
from orrery.llm.sharding import ShardConfig, shard
from orrery.llm.topk import SearchConfig, search
from orrery.llm.toxicity import ToxicityConfig, fit_toxicity, score_toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "x" * 20_000
ROWS = [
    (1, "the cat sat on the mat and looked at the dog", "en", "a", 44), (2, None, "en", None, None), (3, "", None, "a", 0), (4, LONG, "en", "a", len(LONG)), (5, "der hund und die katze sind im haus", "de", "a", 35),
    (5, "der hund und die katze sind im haus", "de", "a", 35), (None, "no id at all in this row of the table", "en", "b", 10), (7, "1234 !!", "de", "b", 7), (8, "  \n\t ", "en", "b", 5), (9, "the cat sat on the mat and looked at the dog", "en", "c", 44),
]
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def clashing(docs):
    """All the operators' own names as extra columns."""
    names = ["score", "predicted", "lang_pred", "tokens", "posterior", "rate", "copies", "size", "shard", "slot", "key", "part", "row", "sig", "items", "root", "ids", "n"]
    return docs.withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_toxicity(docs, labels, clashing, none):
    model = fit_toxicity(docs, labels)
    for rows in (docs, clashing):
        got = score_toxicity(rows, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert score_toxicity(none, fit_toxicity(none, labels)).count() == 0


def test_toxicity_learns(spark):
    bad = [f"some ordinary words number{i} then vile{'abc'[i % 3]} comes up and more follows here" for i in range(60)]
    good = [f"some ordinary words number{i} then calm things come up and more follows here" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(bad + good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, fit_toxicity(docs, labels, ToxicityConfig(epochs=20))).collect()}
    assert sum(got[i] == int(i < 60) for i in got) >= 114


def test_language(docs, clashing, none):
    cfg = LanguageConfig(vocabulary=PIECES, holdout=-1)
    model = fit_language(docs, cfg)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict_language(clashing, model).collect()}
    assert got[2] == ("und", 0.0) and got[3][0] == "und" and got[7][0] == "und" and got[8][0] == "und"
    assert got[5][0] == "de" and got[1][0] == "en" and 0 <= got[4][1] <= 1
    assert predict_language(none, fit_language(none, cfg)).count() == 0


def test_near_dedup(docs, clashing, none):
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(clashing).collect()}
    assert got[9] == got[1] == 1 and got[5] == 5 and got[2] == got[3] == got[8] == 2 and None not in got
    kept = deduplicate(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 4, 5, 7]
    assert kept.where("doc_id is null").count() == 1
    assert near_duplicates(none).count() == 0 and deduplicate(none).count() == 0


def test_near_dedup_keeps_every_text_of_an_id(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "red green blue black white grey brown pink gold silver bronze violet"
    rows = [(3, a), (7, a), (7, b), (9, b), (11, b + " orange"), (12, None), (13, "\x1c\u2003"), (13, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text_id"], r["class_id"]) for r in near_duplicates(docs).collect()}
    assert got == {(3, 3, 3), (7, 3, 3), (7, 7, 7), (9, 7, 7), (11, 11, 7), (12, 12, 12), (13, 12, 12)}
    assert sorted((r["doc_id"], r["text"]) for r in deduplicate(docs).collect() if r["text"]) == [(3, a), (7, b)]
    one = deduplicate(docs.where("doc_id = 13")).collect()
    assert len(one) == 1 and one[0]["doc_id"] == 13


def test_packing(docs, clashing, none):
    cfg = PackingConfig(vocabulary=BPE, length=64)
    got = pack(clashing, cfg).collect()
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert {r["doc_tokens"] for r in got if r["doc_id"] in (2, 3)} == {1}
    at = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    stream = 0
    for s, o, n in at:
        assert s * 64 + o == stream and o + n <= 64
        stream += n
    assert pack(none, cfg).count() == 0


def test_sharding(docs, clashing, none):
    got = shard(clashing, ShardConfig(shards=3)).collect()
    assert len(got) == len(ROWS) and set(clashing.columns) <= set(got[0].asDict())
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["doc_id"]: r["size"] for r in got}[2] == 8
    assert shard(none).count() == 0


def test_fingerprint(docs, clashing, none):
    cfg = FingerprintConfig(partition_bytes=1 << 20)
    got = compare(clashing, cfg).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[9]["fingerprint"] and set(by[2]["fingerprint"]) == {"-"}
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert compare(none, cfg).count() == 0


def test_mixing(docs, labels, clashing, none):
    labelled = labels.select("doc_id", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))
    got = mix(clashing, labelled, MixingConfig(total="corpus")).collect()
    assert len(got) == len(ROWS) and all(r["rate"] >= 0 and r["copies"] >= 0 for r in got)
    assert mix(none, labelled).count() == 0
    assert mix(docs, labelled.where("false")).count() == len(ROWS)


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<p>One &amp; two\n three</p>" * 2), (3, None, "<article>" + "<p>long text here</p>" * 5000), (None, "u", "<<<>>><a href='"), (5, "u", "<nav>Menu</nav>")], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract(pages.withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("y"))).collect()]
    assert got[0][1:] == ("", 0) and got[1][1:] == ("", 0) and got[5][1] == ""
    assert got[2][1] == "One & two three One & two three" and got[3][2] == 15 * 5000 - 1
    assert extract(pages.where("false")).count() == 0


def test_fixity(spark):
    kind = "page_id long, url string, html string, extra string"
    rows = [(i, f"u{i}", f"html {i}", None) for i in range(200)] + [(7, "u7", "html 7", None), (None, None, None, None), (None, "u", "x", None)]
    one = spark.createDataFrame(rows, kind)
    assert audit(one, one.repartition(7)).count() == 0
    two = spark.createDataFrame([(i, u, "changed" if i == 150 else h, e) for i, u, h, e in rows if i != 33] + [(500, "new", "new", None)], kind)
    assert {(r["page_id"], r["status"]) for r in audit(one, two).collect()} == {(150, "corrupt"), (33, "missing"), (500, "extra")}
    assert {r["page_id"] for r in audit(one, spark.createDataFrame(rows[:200] + rows[201:], kind)).collect()} == {7}
    clashing = one.withColumns({c: F.lit("mine") for c in ("id", "digest", "length", "up", "n", "x", "file", "status", "replica_digest")}).where("page_id is not null")
    big = clashing.withColumn("html", F.when(F.col("page_id") == 5, F.repeat(F.lit("x"), 3_000_000)).otherwise(F.col("html")))
    assert [(r["page_id"], r["status"]) for r in audit(clashing, big).collect()] == [(5, "corrupt")]
    empty = one.where("false")
    assert audit(empty, empty).count() == 0 and audit(empty, one.where("page_id < 3")).count() == 3


def test_topk(spark):
    kind = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, -1.0, 1.0], 0), (1, [1.0, -1.0, 1.0], 0), (2, [1.0, -1.0, 1.0], 0), (3, None, 0), (None, [1.0, 1.0, 1.0], 1), (4, [1.0, None, float("nan")], 1), (5, [-1.0, -1.0, -1.0], 1), (6, [1.0], None)]
    t = spark.createDataFrame(rows, kind)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in search(t, t.where("vec_id = 1"), SearchConfig(k=3)).orderBy("rank").collect()]
    assert got == [(1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 4, 1)]
    wide = t.withColumns({c: F.lit("mine") for c in ("code", "ids", "bound", "distance", "rank", "query", "q", "c")}).where("vec_id is not null")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in search(wide, wide.where("vec_id = 1"), SearchConfig(k=3)).collect()) == got
    long = spark.createDataFrame([(i, [1.0 if (i >> (k % 7)) & 1 else -1.0 for k in range(20_000)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert [r["distance"] for r in search(long, long.where("vec_id = 0"), SearchConfig(k=2)).orderBy("rank").collect()][0] == 0
    assert search(t, t.where("vec_id = 3")).count() == 0 and search(t.where("false"), t.where("false")).count() == 0
