"""The operators against brute force, round trips and held-out labels."""

import hashlib
import itertools
import re
import struct
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm import queries as Q
from orrery.llm.fingerprint import FingerprintConfig, compare, fingerprints
from orrery.llm.html_text import default_tree, labelled_blocks, labelled_pages, main_text
from orrery.llm.language import EDGE, LanguageConfig, LanguageModel, fit_language, load_pieces
from orrery.llm.mixing import MixingConfig, _rate, fit_domains, fit_rates, mix, mix_with_report
from orrery.llm.near_dedup import Darts, DedupConfig, components, near_duplicates
from orrery.llm.packing import Encoder
from orrery.llm.sharding import ShardConfig, shard
from orrery.llm.topk import SearchConfig, search
from orrery.llm.toxicity import ODDS, Network, ToxicityConfig, ToxicityModel


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_darts_estimate_weighted_likeness():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    w = rng.integers(1, 6, 400)
    h, owner = np.concatenate([base[:300], base[100:]]), np.repeat([0, 1], 300)
    weight = np.concatenate([w[:300], w[100:] + (np.arange(300) % 3 == 0)])
    a, b = dict(zip(base[:300], weight[:300], strict=True)), dict(zip(base[100:], weight[300:], strict=True))
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    sig = Darts(1024).signatures(h, owner, weight, 2)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05
    alone = Darts(160).signatures(h[:1], np.zeros(1, int), np.ones(1), 1)
    assert (alone != 0).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 31), (31, 30)] + [(100, 101 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 7, 8, 9)} == {1} and got[21] == 20 and got[31] == 30 and {got[101 + i] for i in range(50)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def classes_of_all_pairs(texts: dict[int, str | None]) -> dict[int, int]:
    """Each document's class, from comparing all pairs that share a shingle."""
    bags = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    root, holders = {i: i for i in bags}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, bag in bags.items():
        for shingle in bag or [()]:
            holders.setdefault(shingle, []).append(i)
    for a, b in {p for own in holders.values() for p in itertools.combinations(sorted(own), 2)}:
        if find(a) != find(b) and (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total():
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in bags}


def test_near_duplicates_against_all_pairs(spark, sf_dir):
    for d in (sf_dir, sf_dir.replace("0.001", "0.01")):
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        got = {r["doc_id"]: r["class_id"] for r in Q.op2_minhash_dedup(spark, d).collect()}
        assert got == classes_of_all_pairs(texts)


def test_near_duplicates_in_one_large_bucket(spark):
    """Chains, stars and strangers that share a passage: more of them than a block holds."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    shared = list(rng.choice(words, 60))
    texts = {}
    for g in range(12):
        base = shared + list(rng.choice(words, 25))
        for k in range(40):
            own = list(base)
            for _ in range(k % 4):
                own[int(rng.integers(60, 85))] = f"x{g}_{k}_{int(rng.integers(9))}"
            texts[len(texts)] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs, DedupConfig(large=8, chunk=8, block_bytes=4096)).collect()}
    assert got == classes_of_all_pairs(texts)


def test_encoder_equals_tokenizers(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    sure = Tokenizer.from_file(path)
    encode, rng = Encoder(path, 4000), np.random.default_rng(5)
    odd = ["", "a" * 5000, "\n" * 5000, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", " <|endoftext|>\n\n<|endoftext", "don't     x́ \U0001f600世", "'S 'll\t\t9_9"]
    letters = list("ab\t\n  é世'!<|>9_") + ["<|endoftext|>", "the ", "ing"]
    odd += ["".join(rng.choice(letters, n)) for n in (3, 30, 300, 3990, 4010, 9000) for _ in range(6)]
    odd += [c * n + "x" for c in ("x", "é", " ", "9", "!") for n in (3999, 4000, 4001)]
    for text in [*odd, *[r["text"] for r in docs.values()][:100]]:
        assert encode(text or "") == sure.encode(text or "", add_special_tokens=False).ids


def test_packing_round_trip(spark, sf_dir, docs):
    import zlib

    sure = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Q.op4_packing(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(docs)
    for r in got:
        ids = np.array([*sure.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert sorted(used) == list(range(len(used))) and all(used[s] == 2048 for s in range(len(used) - 1))


def test_segmentations_are_summed():
    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = LanguageModel(LanguageConfig(), ["x", "y"], pieces).fit(["the thing there is there", "das ding dort ist dort"], np.array([0, 1]))
    at = {p: i for i, p in enumerate(pieces)}

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(word) + 1):
            if word[:k] in at:
                out = out + model.prob[at[word[:k]]] / model.SCALE**k * total(word[k:])
        return out

    for word in (EDGE + "there", EDGE + "dinge"):
        assert np.allclose(model.word_scores([word])[0], np.log(total(word)))
        assert np.allclose(model._long(word), np.log(total(word)))


def test_languages_without_spaces_are_learned():
    """Long words: learned from, and summed alike by logarithms, in parts and one by one."""
    import itertools as it

    rng = np.random.default_rng(2)
    kana, han = "のはをがにでとしているたこれそもなかっよりますせん", "的一是不了在人有我他这中大来上个国到说们为子和你地出道也时年"
    texts, y = [], []
    for k in range(40):
        own = kana if k % 2 else han
        texts.append("".join(rng.choice(list(own), 300 + 20 * k)))
        y.append(k % 2)
    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = LanguageModel(LanguageConfig(), ["zh", "ja"], pieces).fit(texts[:30], np.array(y[:30]))
    lang, score, surprise = model.predict(texts[30:])
    assert lang == [["zh", "ja"][k] for k in y[30:]] and min(score) > 0.99 and max(surprise) <= model.surprise_limit
    word = EDGE + texts[0][:500]
    assert np.allclose(model.word_scores([word])[0], model._long(word))
    small = LanguageConfig(vector_chars=4, fit_chars=100)
    words = ["there", "is", "nothing", "like"]
    one, two = (LanguageModel(c, ["a", "b"], pieces).fit([" ".join(words), "das ist nichts"], np.array([0, 1])) for c in (LanguageConfig(), small))
    assert np.allclose(one.prob, two.prob)  # expectations by logarithms and as they are
    assert all(np.allclose(one.word_scores([EDGE + w]), two.word_scores([EDGE + w])) for w in it.chain(words))


def test_too_many_languages_are_refused(spark):
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        fit_language(docs, LanguageConfig(vocabulary=public_tokenizers.path("piece_bpe_32k.model"), max_langs=3))


def test_surprise_tells_foreign_texts(spark, sf_dir, docs):
    cfg = LanguageConfig(vocabulary=public_tokenizers.path("piece_bpe_32k.model"))
    model = fit_language(spark.read.parquet(f"{sf_dir}/documents.parquet"), cfg)
    own = model.predict([r["text"] for r in docs.values()])[2]
    assert sum(s is not None and s > model.surprise_limit for s in own) <= 0.005 * len(own)
    rng = np.random.default_rng(3)
    junk = ["".join(rng.choice(list("qxzjkvwpbmfgy"), 9)) for _ in range(50)]
    foreign = ["Это письмо написано по-русски, и больше ничего в нём нет", " ".join(junk), "zqxj " * 40]
    assert all(s > model.surprise_limit for s in model.predict(foreign)[2])


def test_language_held_out(spark, sf_dir, docs):
    got = Q.op6_language_id(spark, sf_dir).where("held_out").collect()
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got]) > 0.95


def test_gradients_by_differences():
    cfg = ToxicityConfig(hidden=3)
    net, rng, inputs = Network(cfg), np.random.default_rng(1), ODDS + 2 * cfg.embedding
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, ids = rng.normal(size=(9, inputs)), rng.integers(1, 9, (4, 6))
    mask = (np.arange(6) < np.array([6, 4, 1, 5])[:, None]).astype(float)
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss():
        z = net.forward(net.project(x), ids, mask)[0].astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g = net.gradients(x, ids, mask, y, w)
    places = [(net.p[name].reshape(-1), g[name].reshape(-1), 0) for name in ("W0", "U0", "U1", "a", "v", "b")]
    places += [(x.reshape(-1), g["x"].reshape(-1), int(k)) for k in (ids[0, 2] * inputs + 1, ids[3, 4] * inputs + 9, ids[2, 0] * inputs + 14)]
    for flat, grad, at in places:
        old = flat[at]
        values = []
        for step in (1e-2, -1e-2):
            flat[at] = old + step
            values.append(loss())
        flat[at] = old
        assert abs((values[0] - values[1]) / 2e-2 - grad[at]) < 2e-3


def test_scores_against_plain_loops():
    """Every window of a text through both recurrences, step by step."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 90)) + (" bad worse" if i % 2 else "") for i in range(40)]
    model = ToxicityModel(ToxicityConfig(hidden=3, window=16, stride=10, epochs=3)).fit(texts, np.arange(40) % 2)
    net, sigmoid = model.net.p, lambda v: 1 / (1 + np.exp(-v))

    def window_logit(x):
        out = []
        for k, order in (("0", range(len(x))), ("1", range(len(x) - 1, -1, -1))):
            h, states = np.zeros(3), {}
            for t in order:
                a, b = x[t] @ net["W" + k], h @ net["U" + k]
                z, r = sigmoid(a[:3] + b[:3]), sigmoid(a[3:6] + b[3:6])
                h = z * h + (1 - z) * np.tanh(a[6:] + r * b[6:])
                states[t] = h
            out.append(np.array([states[t] for t in range(len(x))]))
        states = np.concatenate(out, 1)
        e = np.exp(states @ net["a"])
        return float((e[:, None] / e.sum() * states).sum(0) @ net["v"] + net["b"][0])

    for text in [*texts[:6], "bad", "one two badly three " * 30]:
        x = model.features.vectors(re.findall(r"\w+", text.lower()))
        starts = sorted({min(10 * k, max(len(x) - 16, 0)) for k in range(len(x) // 10 + 2)})
        want = max(window_logit(x[s : s + 16]) for s in starts)
        assert abs(model.scores([text])[0] - sigmoid(want)) < 1e-4


def test_toxicity_held_out(spark, sf_dir):
    """Labels that were not learned from: recall of label 1, average precision, and accuracy
    against the share of label 0."""
    d = sf_dir.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null").collect()}
    got = [r for r in Q.op10_toxicity(spark, d).where("held_out").collect() if r["doc_id"] in labels]
    y, score = np.array([labels[r["doc_id"]] for r in got]), np.array([r["score"] for r in got])
    found = np.array([r["predicted"] for r in got]) == 1
    rank = np.argsort(-score, kind="stable")
    precision = (np.cumsum(y[rank]) / np.arange(1, len(y) + 1))[y[rank] == 1].mean()
    assert found[y == 1].mean() > 0.75 and precision > 0.88 and (found == y).mean() > 1 - y.mean() + 0.05


def test_pages_not_trained_on_are_separated():
    """Precision and recall of main blocks, over pages of another seed: with telling tags,
    with telling names, with neither."""
    pages, tree = labelled_pages(180, seed=1234), default_tree()
    assert not set(pages) & set(labelled_pages())
    for k in range(3):
        x, y = labelled_blocks(pages[k::3])
        got = tree.predict(x)
        assert (got & y).sum() >= 0.98 * got.sum() and (got & y).sum() >= 0.98 * y.sum()


LINE = "Plain words of an article about nothing at all, and then some more of them to make a line."


@pytest.mark.parametrize("html", [
    f'<div class="post has-sidebar"><p>{LINE}</p></div>', f'<div id="main" class="no-sidebar content"><p>{LINE}</p></div>', f'<article><p title="a hidden gem">{LINE}</p></article>', f'<article><p data-role="banner">{LINE}</p></article>',
    f'<div><p>{LINE}</p></div><h3>Comments</h3><div><p>I like it very much indeed.</p></div><div>Copyright 2020 The Paper, all rights reserved.</div>', f'<p>{LINE}</p><div>&copy; 2020 Example</div>',
    f'<div class="site-header"><p>The paper of the town</p></div><div class="entry-content"><p>{LINE}</p></div><div class="comment-list"><p>Well said, and {LINE}</p></div>', f'<div role="banner">Some words up there</div><p>{LINE}</p><div role="contentinfo">Some words down there</div>',
    f'<div class="page-sidebar-layout"><main><p>{LINE}</p></main><aside>{LINE} Buy now.</aside></div>', f"<article class=post><p>{LINE}</p><form>Your mail <button>Go</button></form><div class='cookie-notice'>We use cookies to learn how this site is used.</div></article>",
])
def test_names_and_attributes_are_read_exactly(html):
    assert main_text(html) == LINE


@pytest.mark.parametrize("title", ["related-work", "form-and-function", "comments", "footer"])
def test_headings_are_not_judged_by_their_ids(title):
    assert main_text(f'<article><h2 id="{title}">A title</h2><p>{LINE}</p></article>') == f"A title {LINE}"


def test_pages_table_is_extracted_exactly(spark, sf_dir):
    """The pages of the test tables have one article element each: its text, by a plain reading."""
    for r in Q.op3_html_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        plain = re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))
        want = " ".join(unescape(plain).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_html_parts():
    page = """<html><head><title>T</title></head><body><header class="site"><h1>Site</h1></header><nav>menu</nav><aside class="sidebar"><p>Side</p></aside><main><article><header><h2>Title</h2></header><p>Caf&eacute; &lt;b&gt;
    text&nbsp;here.</p><section class="comments"><p>A reader says</p></section><blockquote>Quoted.</blockquote><div class="cookie-banner">We use cookies</div><p style="display:none">hidden</p><script>x</script></article></main><form>f</form><footer>foot</footer></body></html>"""
    assert main_text(page) == "Title Café <b> text here. Quoted."


def test_search_against_all_distances(spark, sf_dir):
    """Several blocks of codes and of queries, copies, and queries that close in different rounds."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    rng = np.random.default_rng(6)
    x = np.array([r["embedding"] for r in rows]) > 0
    far = rng.random((40, x.shape[1])) > 0.5
    bits = np.concatenate([x, x[:15], far])
    table = spark.createDataFrame([(i, [1.0 if b else -1.0 for b in row]) for i, row in enumerate(bits)], "vec_id long, embedding array<double>")
    got = {}
    for r in search(table, table.where("vec_id % 7 = 0"), SearchConfig(k=5, query_block=9, code_block=40, least_block=40)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    assert set(got) == set(range(0, len(bits), 7))
    for q, own in got.items():
        d = (bits != bits[q]).sum(1)
        want = sorted(range(len(bits)), key=lambda i: (d[i], i))[:5]
        assert sorted(own) == [(k + 1, i, d[i]) for k, i in enumerate(want)]


def spark_hash(text: str | None) -> int:
    h = xxhash.xxh64((text or "").encode(), 42).intdigest()
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("part_bytes", [1 << 26, 300])
def test_sharding_against_a_sort(spark, sf_dir, part_bytes):
    """Shards and slots are those of the rows sorted by (hash, id), and every cut is as near
    its target as ``tolerance`` or the rows allow."""
    d = sf_dir.replace("0.001", "0.01")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    cfg = ShardConfig(shards=24, part_bytes=part_bytes)
    got = {r["doc_id"]: r for r in shard(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), cfg).collect()}
    order = sorted(docs, key=lambda i: (spark_hash(docs[i]), i))
    size = [len((docs[i] or "").encode()) + 8 for i in order]
    assert [got[i]["size"] for i in order] == size and len(got) == len(docs)
    assert [(got[i]["shard"], got[i]["slot"]) for i in order] == sorted((got[i]["shard"], got[i]["slot"]) for i in order)
    rows = Counter(got[i]["shard"] for i in order)
    assert all(sorted(got[i]["slot"] for i in order if got[i]["shard"] == s) == list(range(n)) for s, n in rows.items())
    total, below = sum(size), np.concatenate([[0], np.cumsum(size)])
    for cut in range(1, 24):
        at = below[sum(rows[s] for s in range(cut))]
        target = total * cut / 24
        assert abs(at - target) <= max(0.001 * total / 24, np.abs(below - target).min())


def test_sharding_splits_copies(spark):
    """One text of a third of all rows: its rows are cut between ids."""
    rows = [(i, "the same text for all of them" if i % 3 else f"text {i} " + "x" * (i % 50)) for i in range(3000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ShardConfig(shards=7, part_bytes=500)).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    order = sorted(got, key=lambda r: (spark_hash(r["text"]), r["doc_id"]))
    assert [(r["shard"], r["slot"]) for r in order] == sorted((r["shard"], r["slot"]) for r in got)


def fingerprint_twin(text: str) -> str:
    """The fingerprint by plain loops: in each coordinate's order over all numbered word
    pairs the two least, in the order of the text."""

    def of_longs(*xs: int) -> int:
        h = 42
        for x in xs:
            h = xxhash.xxh64(struct.pack("<q", x), h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    if not text:
        return "-" * 512
    words = [xxhash.xxh64(w.encode(), 42).intdigest() for w in re.sub("[\n\t\r]", " ", text).split(" ")]
    words = [w - (1 << 64) if w >> 63 else w for w in words]
    pairs = [of_longs(a, b) for a, b in zip(words, words[1:], strict=False)] or [of_longs(words[0])]
    seen, packed = Counter(), []
    for place, kmer in enumerate(pairs):
        seen[kmer] += 1
        h = (kmer if seen[kmer] == 1 else of_longs(kmer, seen[kmer])) & ((1 << 64) - 1)
        packed.append((h >> 58) << 56 | (h >> 30 & ((1 << 28) - 1)) << 28 | place)
    out = []
    for j in range(64):
        two = sorted(packed, key=lambda v: v ^ (j << 56))[:2]
        two.sort(key=lambda v: v & ((1 << 28) - 1))
        out.append(f"{of_longs(*[v >> 28 for v in two]) % (1 << 32):08X}")
    return "".join(out)


def test_fingerprints_against_plain_loops(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in Q.op5_fingerprint(spark, sf_dir).collect()}
    order = sorted(docs)
    texts = [docs[i]["text"] or "" for i in order]
    prints = {t: fingerprint_twin(t) for t in texts}
    for k, i in enumerate(order):
        text, after = texts[k], texts[(k + 1) % len(order)]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r, mark, other = got[i], prints[text], fingerprint_twin(edited)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == mark and r["edited_fingerprint"] == other
        for name, x, y in (("near_edited", mark, other), ("near_next", mark, prints[after])):
            assert abs(r[name] - np.mean([x[c : c + 8] == y[c : c + 8] for c in range(0, 512, 8)])) < 1e-12


def test_fingerprints_follow_order_at_any_length(spark):
    """A text against itself with its halves swapped keeps the words and half of the order."""
    rng, rows = np.random.default_rng(4), []
    lengths = (20, 40, 100, 1000)
    for n in lengths:
        for _ in range(30):
            words = [f"w{x}" for x in rng.integers(0, 5000, n)]
            rows += [" ".join(words), " ".join(words[n // 2 :] + words[: n // 2])]
    got = compare(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()
    for k, n in enumerate(lengths):
        assert 0.3 < np.mean([r["near_next"] for r in got[60 * k : 60 * k + 60 : 2]]) < 0.6, n


def test_ranges_do_not_change_fingerprints(spark):
    """Many rows of one id, null ids, and fewer quantiles than ranges."""
    rows = [(7, f"text number {i} of the same id") for i in range(300)] + [(None, f"text {i} without an id") for i in range(100)] + [(i * i, f"words of text {i} and more") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one, two = (sorted(map(str, compare(docs, cfg).collect())) for cfg in (FingerprintConfig(), FingerprintConfig(quantiles=5, partition_bytes=200)))
    assert one == two and len(one) == len(rows)


def test_sorted_kmers_are_narrow(spark):
    """What a task sorts of every k-mer, of text and edit, is at most five numbers a row."""
    docs = spark.createDataFrame([(i, f"words of text {i} and more") for i in range(9)], "doc_id long, text string")
    widths, nodes = [], [fingerprints(docs)._jdf.queryExecution().executedPlan().initialPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Sort" and "cell" in node.sortOrder().toString():
            widths.append(node.output().size())
    assert widths and max(widths) <= 5, widths


def test_mixing_meets_targets(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    labelled = Q.quality_domains(spark.read.parquet(f"{d}/labels.parquet"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    made = mix(docs, labelled, MixingConfig(targets={"high": 0.7, "low": 0.3}, total="corpus"))
    t = F.col("tokens") * F.col("rate")
    row = made.agg(F.sum("tokens").alias("n"), F.sum(t * F.col("posterior")[0]).alias("high"), F.sum(t * F.col("posterior")[1]).alias("low"), F.min("rate").alias("least")).first()
    assert row["least"] >= 0 and abs(row["high"] / row["n"] - 0.7) < 0.01 and abs(row["low"] / row["n"] - 0.3) < 0.01


def test_rates_against_plain_projected_gradient(spark):
    """Three domains, tokens of very different sizes: the same steps by numpy, and targets met."""
    rng = np.random.default_rng(9)
    p, t = rng.dirichlet([0.4, 0.4, 0.4], 400), rng.integers(1, 3000, 400)
    made = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "tokens long, posterior array<double>").repartition(5)
    cfg = MixingConfig(targets={"a": 0.6, "b": 0.3, "c": 0.1}, total="corpus")
    moves, report = fit_rates(made, cfg, ["a", "b", "c"])
    got = np.array([r[0] for r in made.select("tokens", "posterior", _rate(moves).alias("r")).orderBy("tokens", "posterior").select("r").collect()])
    order = sorted(range(400), key=lambda i: (t[i], list(p[i])))
    p, t = p[order], t[order].astype(float)
    have, target = p.T @ t, np.array([0.6, 0.3, 0.1]) * t.sum()
    w = 1 / np.sqrt(have)
    step = 1 / np.linalg.eigvalsh((w[:, None] * p.T * t) @ (p * w)).max()
    rate = np.ones(400)
    for _ in moves:
        rate = np.maximum(0, rate - step * p @ ((p.T @ (t * rate) - target) / have))
    assert np.allclose(got, rate) and np.allclose(report["reached"], p.T @ (t * rate))
    assert np.abs(p.T @ (t * rate) - target).max() <= 1e-3 * t.sum()


def test_targets_out_of_reach_are_reported(spark):
    docs = spark.createDataFrame([(i, "plain words of one kind only") for i in range(50)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "high" if i % 2 else "low") for i in range(50)], "doc_id long, domain string")
    cfg = MixingConfig(targets={"high": 0.9, "low": 0.1}, total="corpus")
    made, report = mix_with_report(docs, labelled, cfg)
    assert made.count() == 50 and abs(report["reached"][0] - report["target"][0]) > 0.1 * sum(report["target"])
    with pytest.warns(UserWarning, match="no nonnegative rates"):
        mix(docs, labelled, cfg)


def test_domains_held_out(spark, sf_dir):
    """Labels that the classifier has not seen: better than the share of the larger class, and
    the posteriors rank them."""
    d = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), Q.quality_domains(spark.read.parquet(f"{d}/labels.parquet")).where("domain is not null")
    cfg = MixingConfig(targets={"high": 0.5, "low": 0.5})
    model = fit_domains(docs, labels.where("doc_id % 4 != 0"), cfg)
    rows = docs.join(labels.where("doc_id % 4 = 0"), "doc_id").select("text", "domain").collect()
    y = np.array([r["domain"] == "low" for r in rows])
    score = model.posteriors([r["text"] for r in rows])[:, 1]
    rank = np.argsort(np.argsort(score))
    auc = (rank[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.9 and ((score > 0.5) == y).mean() > max(y.mean(), 1 - y.mean())


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline

    names = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, sf_dir)
        assert after.columns == names
        assert 0 < after.count() <= at.count(), name
        at = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in at.select("doc_id").collect()}


def test_pipeline_edges(spark, sf_dir):
    """Nulls, repeats, an empty table, junk, and the user's columns named like the operators' own."""
    import corpus_pipeline

    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    clean = real.where("lang is not null and n_chars between 200 and 3000")
    rng = np.random.default_rng(1)
    junk = " ".join("".join(rng.choice(list("qxzjkvwpbmfgy"), 9)) for _ in range(60))
    text = clean.orderBy("doc_id").first()["text"]
    odd = spark.createDataFrame([(100_001, None, "en", "s", None), (100_002, "", None, None, 0), (100_003, junk, "en", "s", 9), (None, text + " and no id", "en", "s", 9), (100_004, text, "en", "s", 9), (100_004, text, "en", "s", 9)], real.schema)
    docs = clean.unionByName(odd)
    for name in ("score", "predicted", "Surprise", "lang_pred", "tokens", "posterior", "rate", "copies", "node", "t1", "job", "__n"):
        docs = docs.withColumn(name, F.concat(F.lit("mine "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns, name
        rows = at.collect()
        assert all(r["score"] == r["rate"] == r["Surprise"] == r["t1"] == f"mine {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows)
        ids = [r["doc_id"] for r in rows]
        if name == "language":
            assert not {100_001, 100_002, 100_003} & set(ids) and None in ids and ids.count(100_004) == 2
        if name == "near_dedup":
            assert 100_004 not in ids and None in ids and len(ids) == len(set(ids))
    assert corpus_pipeline.STAGES[-1][1](spark, at, sf_dir).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
