"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language.  A
word's probability in a language is the sum, over all ways to cut it into
pieces, of the products of the pieces' probabilities; a forward algorithm sums
them.  A text's log probability is the sum over its words (a piece never reaches
over white space, so the sum over a text's segmentations factors at words).
The piece probabilities are fitted by expectation maximisation with the same
sums (forward-backward), so that no single segmentation is ever chosen.  Words of any
length are learned from, as languages written without spaces have nothing else; those
of over ``fit_chars`` characters in parts of that size.  Short words are summed side by
side, longer ones by logarithms, so that nothing underflows.

``score`` compares the learned languages with each other only.  ``surprise``, the text's
negative log probability a character in its language, says whether the text is in any of
them: ``model.surprise_limit`` is ``surprise_factor`` times the sampled documents' median.

Results at the edges: a null text or one without any letter is ``und`` with
score 0; a text of any length is read to its end; ties go to the language that
sorts first.  If nothing can be learned, every text is ``und``.  An empty table
gives an empty result.  Other columns pass through; columns named like an output
are replaced.  Equal texts get equal results.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, fold, prefix, release, spans

LETTER = re.compile(r"[^\W\d_]")
EDGE = "▁"


@dataclass(frozen=True)
class LanguageConfig:
    vocabulary: str = ""
    #: Documents of each language that are learned from, at most; and characters in all.
    sample_per_lang: int = 200
    sample_chars: int = 3_000_000
    #: More distinct values of the language column than this are refused, not cut off: every
    #: language costs a number for each piece, and a mistaken column must not flood the driver.
    max_langs: int = 1000
    rounds: int = 4
    smoothing: float = 0.05
    #: Probability of a character that no piece covers.
    unknown: float = 1e-7
    #: Words up to this length are summed side by side as they are, longer ones by logarithms;
    #: beyond ``fit_chars`` character by character, in memory of the longest piece's size.
    vector_chars: int = 48
    fit_chars: int = 2048
    #: Characters of longer words that are summed at once.
    long_batch: int = 50_000
    #: Words kept with their sums by each Python worker.
    cache: int = 400_000
    surprise_factor: float = 3.0
    holdout_mod: int = 5
    holdout: int = 0


def load_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece vocabulary that lie within one word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in found if p and EDGE not in p[1:]})


class Segmenter:
    """All places of all pieces in many words at once."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.length = np.array([len(p) for p in pieces] + [1], np.int64)  # the last: an uncovered character
        self.machine = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            self.machine.add_word(p, i)
        self.machine.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of every piece in every word, by end; where a
        character is no piece by itself, the unknown piece covers it."""
        joined = "\n".join(words) + "\n"
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size + 1) - size - 1
        flat = np.fromiter(chain.from_iterable(self.machine.iter(joined)), np.int64).reshape(-1, 2)
        end, piece = flat[:, 0] + 1, flat[:, 1]
        covered = np.zeros(len(joined) + 1, bool)
        covered[end[self.length[piece] == 1]] = True
        word_of = np.repeat(np.arange(len(words)), size + 1)
        inside = np.ones(len(joined) + 1, bool)
        inside[0] = False
        inside[first + size + 1] = False  # the line ends
        bare = np.flatnonzero(inside & ~covered)
        end, piece = np.concatenate([end, bare]), np.concatenate([piece, np.full(len(bare), self.n)])
        word = word_of[end - 1]
        end = end - first[word]
        order = np.lexsort((word, end))
        word, end, piece = word[order], end[order], piece[order]
        return word, end - self.length[piece], end, piece


class LanguageModel:
    def __init__(self, cfg: LanguageConfig, langs: list[str], pieces: list[str]):
        self.cfg, self.langs, self.pieces = cfg, langs, pieces
        self.prob: np.ndarray | None = None  # (pieces + 1, langs), scaled by SCALE ** length
        self.surprise_limit = float("inf")
        self._seg: Segmenter | None = None
        self._cache: dict[str, int] = {}
        self._rows = np.zeros((0, len(langs)))

    SCALE = 64.0

    def __getstate__(self):
        return self.__dict__ | {"_seg": None, "_cache": {}, "_rows": np.zeros((0, len(self.langs)))}

    @property
    def seg(self) -> Segmenter:
        if self._seg is None:
            self._seg = Segmenter(self.pieces)
        return self._seg

    @staticmethod
    def _add(into: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        """into[at] += value, where ``at`` is sorted."""
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        into[at[first]] += np.add.reduceat(value, first)

    def _forward(self, words: list[str], edges, prob: np.ndarray) -> np.ndarray:
        word, start, end, piece = edges
        longest = max(map(len, words))
        alpha = np.zeros((longest + 1, len(words), prob.shape[1]))
        alpha[0] = 1
        cut = np.searchsorted(end, np.arange(1, longest + 2))
        for j in range(1, longest + 1):
            at = slice(cut[j - 1], cut[j])
            if at.start < at.stop:
                self._add(alpha[j], word[at], alpha[start[at], word[at]] * prob[piece[at]])
        return alpha

    def _forward_logs(self, words: list[str], edges, logs: np.ndarray) -> np.ndarray:
        """As ``_forward``, of logarithms: (places, words, langs)."""
        word, start, end, piece = edges
        longest = max(map(len, words))
        alpha = np.full((longest + 1, len(words), logs.shape[1]), -np.inf)
        alpha[0] = 0
        cut = np.searchsorted(end, np.arange(1, longest + 2))
        for j in range(1, longest + 1):
            at = slice(cut[j - 1], cut[j])
            if at.start < at.stop:
                own = word[at]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                alpha[j, own[first]] = np.logaddexp.reduceat(alpha[start[at], own] + logs[piece[at]], first)
        return alpha

    def _backward_logs(self, words: list[str], edges, logs: np.ndarray) -> np.ndarray:
        word, start, end, piece = edges
        size = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(size.max())
        beta = np.full((longest + 1, len(words), logs.shape[1]), -np.inf)
        beta[size, np.arange(len(words))] = 0
        order = np.lexsort((word, start))
        cut = np.searchsorted(start[order], np.arange(longest + 1))
        for j in range(longest - 1, -1, -1):
            at = order[cut[j] : cut[j + 1]]
            if len(at):
                own = word[at]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                beta[j, own[first]] = np.logaddexp.reduceat(beta[end[at], own] + logs[piece[at]], first)
        return beta

    def _batches(self, words: list[str], own: np.ndarray) -> list[np.ndarray]:
        """The words ``own`` by length, in batches of ``long_batch`` characters' places."""
        size = np.array([len(words[i]) for i in own], np.int64)
        order, out, held = own[np.argsort(size, kind="stable")], [], []
        for i in order.tolist():
            if held and (len(held) + 1) * len(words[i]) > self.cfg.long_batch:
                out.append(np.array(held))
                held = []
            held.append(i)
        return out + ([np.array(held)] if held else [])

    def _long(self, word: str) -> np.ndarray:
        """Log sum over the segmentations of one word, rescaled at each character."""
        _, start, end, piece = self.seg.edges([word])
        n, out = len(word), np.zeros(len(self.langs))
        keep = int(self.seg.length.max()) + 1
        ring, logs = np.zeros((keep, len(self.langs))), np.zeros((keep, len(self.langs)))
        ring[0] = 1
        cut = np.searchsorted(end, np.arange(1, n + 2))
        for j in range(1, n + 1):
            at = slice(cut[j - 1], cut[j])
            s = start[at] % keep
            base = logs[s].max(0)
            value = (ring[s] * np.exp(logs[s] - base) * self.prob[piece[at]]).sum(0)
            value = np.maximum(value, 1e-300)
            ring[j % keep], logs[j % keep] = 1, base + np.log(value)
        out = logs[n % keep]
        return out - n * np.log(self.SCALE)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, langs): log probability of each word, all segmentations summed."""
        out = np.empty((len(words), len(self.langs)))
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(size <= self.cfg.vector_chars)
        for part in np.array_split(short, max(1, len(short) // 10_000)):
            if len(part):
                own = [words[i] for i in part]
                alpha = self._forward(own, self.seg.edges(own), self.prob)
                with np.errstate(divide="ignore"):
                    out[part] = np.log(alpha[size[part], np.arange(len(part))]) - size[part, None] * np.log(self.SCALE)
        logs = None
        for part in self._batches(words, np.flatnonzero((size > self.cfg.vector_chars) & (size <= self.cfg.fit_chars))):
            if logs is None:
                with np.errstate(divide="ignore"):
                    logs = np.log(self.prob) - self.seg.length[:, None] * np.log(self.SCALE)
            own = [words[i] for i in part]
            out[part] = self._forward_logs(own, self.seg.edges(own), logs)[size[part], np.arange(len(part))]
        for i in np.flatnonzero(size > self.cfg.fit_chars):
            out[i] = self._long(words[i])
        return out

    def _parts(self, text: str) -> Iterator[str]:
        """The text's words as they are learned from: with their edge, and cut if too long."""
        for w in text.lower().split():
            w, most = EDGE + w, self.cfg.fit_chars
            yield from (w[i : i + most] for i in range(0, len(w), most)) if len(w) > most else (w,)

    def fit(self, texts: list[str], labels: np.ndarray) -> LanguageModel:
        n = len(self.langs)
        number: dict[str, int] = {}
        weight = np.zeros((0, n))
        for text, y in zip(texts, labels, strict=True):
            own = Counter(self._parts(text))
            at = np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own))
            if len(number) > len(weight):
                weight = np.concatenate([weight, np.zeros((max(len(number), len(weight)), n))])
            weight[at, y] += np.fromiter(own.values(), float, len(own))
        words = list(number)
        weight = weight[: len(words)]
        del number
        length = self.seg.length
        prob = np.full((self.seg.n + 1, n), 1.0 / (self.seg.n + 1))
        prob[-1] = self.cfg.unknown
        scale = self.SCALE ** length[:, None]
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(size <= self.cfg.vector_chars)
        parts = [p for p in np.array_split(short, max(1, len(short) // 5_000)) if len(p)]
        long = self._batches(words, np.flatnonzero(size > self.cfg.vector_chars))
        for _ in range(self.cfg.rounds if words else 0):
            seen = np.full((self.seg.n + 1, n), self.cfg.smoothing)
            for part in parts:
                own = [words[i] for i in part]
                word, start, end, piece = edges = self.seg.edges(own)
                alpha = self._forward(own, edges, prob * scale)
                beta = np.zeros_like(alpha)
                beta[size[part], np.arange(len(part))] = 1
                order = np.lexsort((word, -start))
                cut = np.searchsorted(-start[order], np.arange(-alpha.shape[0] + 1, 2))
                for k, j in enumerate(range(alpha.shape[0] - 1, -1, -1)):
                    at = order[cut[k] : cut[k + 1]]
                    if len(at):
                        self._add(beta[j], word[at], beta[end[at], word[at]] * (prob * scale)[piece[at]])
                total = np.maximum(alpha[size[part], np.arange(len(part))], 1e-300)
                use = alpha[start, word] * (prob * scale)[piece] * beta[end, word] / total[word] * weight[part][word]
                for lang in range(n):
                    seen[:, lang] += np.bincount(piece, use[:, lang], self.seg.n + 1)
            with np.errstate(divide="ignore"):
                logs = np.log(prob)
            for part in long:
                own = [words[i] for i in part]
                word, start, end, piece = edges = self.seg.edges(own)
                alpha, beta = self._forward_logs(own, edges, logs), self._backward_logs(own, edges, logs)
                total = np.maximum(alpha[size[part], np.arange(len(part))], -1e300)
                for lang in range(n):
                    use = np.exp(np.minimum(alpha[start, word, lang] + logs[piece, lang] + beta[end, word, lang] - total[word, lang], 0)) * weight[part, lang][word]
                    seen[:, lang] += np.bincount(piece, use, self.seg.n + 1)
            prob = seen / seen.sum(0)
            prob[-1] = self.cfg.unknown
        self.prob = prob * scale
        self.surprise_limit = float("inf")
        found = np.sort([s for i in range(0, len(texts), 64) for s in self.predict(texts[i : i + 64])[2] if s is not None])
        if len(found):
            self.surprise_limit = float(self.cfg.surprise_factor * found[len(found) // 2])
        self._cache, self._rows = {}, np.zeros((0, n))
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        """Of each text: language, posterior, surprise (None where the language is ``und``)."""
        out, score, surprise = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        if self.prob is None or not self.langs:
            return out, score, surprise
        split = [[EDGE + w for w in t.lower().split()] if t and LETTER.search(t) else [] for t in texts]
        used = set().union(*split)
        if len(self._cache) + len(used) > self.cfg.cache:
            self._cache, self._rows = {}, np.zeros((0, len(self.langs)))
        cache = self._cache
        new = [w for w in used if w not in cache and len(w) <= self.cfg.vector_chars]
        if new:
            cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
            if len(cache) > len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros((max(len(cache), len(self._rows)), len(self.langs)))])
            self._rows[len(cache) - len(new) : len(cache)] = self.word_scores(new)
        # long words seldom come again: they are not kept
        once = [w for w in used if len(w) > self.cfg.vector_chars]
        rows, number = self._rows, cache
        if once:
            rows = np.concatenate([rows, self.word_scores(once)])
            number = ChainMap({w: len(self._rows) + i for i, w in enumerate(once)}, cache)
        size = np.fromiter(map(len, split), np.int64, len(split))
        read = np.flatnonzero(size)
        if not len(read):
            return out, score, surprise
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        total = np.add.reduceat(rows[flat], (np.cumsum(size) - size)[read])
        p = np.exp(total - total.max(1, keepdims=True))
        best = p.argmax(1)
        for i, k, q, top in zip(read, best, p[np.arange(len(p)), best] / p.sum(1), total.max(1), strict=True):
            out[i], score[i], surprise[i] = self.langs[k], float(q), float(-top) / sum(map(len, split[i]))
        return out, score, surprise


def fit_language(docs: DataFrame, cfg: LanguageConfig) -> LanguageModel:
    """Fit on a bounded sample (``sample_per_lang`` documents of each language,
    ``sample_chars`` characters) outside the held-out fold, taken in the order of a
    hash of the ids, language by language in turn."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(fold(F.col("doc_id"), cfg.holdout_mod) != cfg.holdout)
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).limit(cfg.max_langs + 1).collect()
    if len(counts) > cfg.max_langs:
        raise ValueError(f"more than {cfg.max_langs} languages in the column lang")
    langs = sorted(r["lang"] for r in counts)
    model = LanguageModel(cfg, langs, load_pieces(cfg.vocabulary))
    if not langs:
        return model
    # each language's ids with the smallest hashes: a threshold first, so that few rows are sorted
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 2 * cfg.sample_per_lang / r["n"]))).otherwise(rate)
    few = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", u.alias("u")).where(F.col("u") < rate)
    rows = few.distinct().orderBy("u", "doc_id").limit(4 * cfg.sample_per_lang * len(langs)).collect()
    of: dict[str, list[int]] = {k: [] for k in langs}
    for r in rows:
        if len(of[r["lang"]]) < cfg.sample_per_lang:
            of[r["lang"]].append(r["doc_id"])
    turn = [(ids[k], lang) for k in range(cfg.sample_per_lang) for lang, ids in of.items() if k < len(ids)]
    lang_of = dict(turn)
    texts = bounded_texts(docs, list(dict.fromkeys(i for i, _ in turn)), cfg.sample_chars)
    model.fit(list(texts.values()), np.array([langs.index(lang_of[i]) for i in texts], np.int64))
    model._seg = None  # workers build their own
    del texts
    release()
    return model


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the posterior under equal priors) and
    ``surprise`` (null for ``und``)."""

    @F.pandas_udf("lang_pred string, score double, surprise double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            own = texts.tolist()
            found = [model.predict(own[a:b]) for a, b in spans(own)]
            lang, score, surprise = (list(chain.from_iterable(f[k] for f in found)) for k in range(3))
            yield pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": pd.Series(score, dtype=float), "surprise": pd.array(surprise, dtype="Float64")})

    own = f"{prefix(docs)}lang"
    made = docs.withColumn(own, predict(F.col(text_col)))
    return made.withColumns({c: F.col(f"{own}.{c}") for c in ("lang_pred", "score", "surprise")}).drop(own)
