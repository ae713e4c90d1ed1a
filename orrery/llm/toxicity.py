"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Every word of a text becomes a vector of word and character inputs; windows of
``window`` words, ``stride`` apart and covering the whole text, run through a
bidirectional GRU; attention pools a window's states into one logit, and a
document's logit is the largest of its windows.  The network, its
back-propagation through time and its optimiser are plain numpy.

* Word inputs: a trained embedding of the word, and its smoothed log odds in the
  labelled sample.
* Character inputs: the mean of trained embeddings of the word's character n-grams (3 to
  5 characters, with word edges), and the largest and mean log odds of these n-grams, so
  that unseen inflections still carry the evidence of their stems; plus the word's length.

Embeddings begin at zero and are learned through the network from words of at least
``least_df`` documents, so that a rare or new word adds nothing but its n-grams.  Log odds that a document's own words helped to make
would be surer of it than of others: while learning, each of ``folds`` parts of the sample
reads the odds of the other parts.

Results at the edges: a null or empty text, or one without any word, has the
score of an empty window (a constant of the fitted model).  Texts of any length
are read to their end.  Equal texts have equal scores.  An empty table gives an
empty result.  Other columns pass through untouched; columns named like an
output are replaced.  If no labelled row of either class can be learned from,
every score is the share of label 1 (0 if there are no labels).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, fold, release, spans

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityConfig:
    window: int = 64
    stride: int = 48
    hidden: int = 8
    word_buckets: int = 1 << 17
    gram_buckets: int = 1 << 19
    #: Numbers of a word's and of an n-gram's embedding, and rows of the two tables.
    embedding: int = 4
    word_rows: int = 1 << 15
    gram_rows: int = 1 << 16
    #: Step and decay of the embeddings.
    embedding_rate: float = 0.01
    embedding_decay: float = 0.002
    grams: tuple[int, ...] = (3, 4, 5)
    #: Labelled documents of each class that are learned from, at most.
    sample_per_class: int = 1000
    #: Characters that are learned from, at most.
    sample_chars: int = 5_000_000
    #: Documents in which a feature must be seen before it counts.
    least_df: int = 5
    #: Likelihood ratio statistic from which a feature counts: hundreds of thousands of
    #: features are tried, so that chance alone brings forth a few of 20.
    least_g: float = 24.0
    folds: int = 4
    epochs: int = 12
    #: Epochs after which all windows are scored anew.
    rescan: int = 4
    batch: int = 64
    rate: float = 0.02
    seed: int = 11
    threshold: float = 0.7
    holdout_mod: int = 3
    holdout: int = 1


ODDS = 7


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Features:
    """Hashed word and character n-gram log odds and embeddings, and the vectors made of
    them."""

    def __init__(self, cfg: ToxicityConfig):
        self.cfg = cfg
        self.word_table = np.zeros((cfg.word_rows, cfg.embedding), np.float32)
        self.gram_table = np.zeros((cfg.gram_rows, cfg.embedding), np.float32)
        self.word = np.zeros(cfg.word_buckets, np.float32)
        self.gram = np.zeros(cfg.gram_buckets, np.float32)

    @staticmethod
    def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the words with their edges, and each word's start."""
        joined = "\x02" + "\x03\x02".join(words) + "\x03"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        return points, np.concatenate([[0], np.cumsum(size)[:-1]])

    @staticmethod
    def _bucket(h: np.ndarray, n: int) -> np.ndarray:
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(40)).astype(np.int64) % n

    def word_buckets(self, points: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
        place = (np.arange(len(points)) - starts[owner]).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (points + np.uint64(1)) * (place * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F))
            mixed ^= mixed >> np.uint64(31)
            mixed = mixed * np.uint64(0x94D049BB133111EB)
            return self._bucket(np.add.reduceat(mixed, starts), self.cfg.word_buckets)

    def gram_buckets(self, points: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams within words, and the words they are of."""
        m = len(points) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = np.flatnonzero(owner[:m] == owner[n - 1 :])
        with np.errstate(over="ignore"):
            h = np.full(len(inside), n, np.uint64)
            for k in range(n):
                h = h * np.uint64(1_000_003) + points[inside + k]
            return self._bucket(h, self.cfg.gram_buckets), owner[inside]

    def vectors(self, words: list[str]) -> np.ndarray:
        """(words, inputs) of distinct words: odds, then the two embeddings."""
        return np.concatenate([self.odds(words), self.embedded(*self.rows(words))], 1)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's row of the word table; the n-grams' rows, and the words they are of."""
        if not words:
            return (np.zeros(0, np.int64),) * 3
        points, starts = self._points(words)
        owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(points))))
        parts = [self.gram_buckets(points, owner, n) for n in self.cfg.grams]
        gram, of = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(of, kind="stable")
        return self.word_buckets(points, starts, owner) % self.cfg.word_rows, gram[order] % self.cfg.gram_rows, of[order]

    def embedded(self, word: np.ndarray, gram: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The word's embedding and the mean of its n-grams'."""
        mean = np.zeros((len(word), self.cfg.embedding), np.float32)
        if len(of):
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            mean[of[first]] = np.add.reduceat(self.gram_table[gram], first) / np.diff(np.append(first, len(of)))[:, None]
        return np.concatenate([self.word_table[word], mean], 1)

    def odds(self, words: list[str]) -> np.ndarray:
        """(words, ODDS) of distinct words."""
        out = np.zeros((len(words), ODDS), np.float32)
        if not words:
            return out
        points, starts = self._points(words)
        owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(points))))
        out[:, 0] = self.word[self.word_buckets(points, starts, owner)]
        total, count = np.zeros(len(words), np.float32), np.zeros(len(words), np.float32)
        for i, n in enumerate(self.cfg.grams[:3]):
            bucket, of = self.gram_buckets(points, owner, n)
            if not len(of):
                continue
            value = self.gram[bucket]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            out[of[first], 1 + i] = np.maximum.reduceat(value, first)
            total[of[first]] += np.add.reduceat(value, first)
            count[of[first]] += np.diff(np.append(first, len(of)))
        out[:, 4] = total / np.maximum(count, 1)
        out[:, 5] = np.log1p(np.diff(np.append(starts, len(points))) - 2) / 3
        out[:, 6] = 1
        return out

    def prepare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the words; of all their n-grams, word by word; where each word's begin."""
        points, starts = self._points(words)
        owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(points))))
        word_of = self.word_buckets(points, starts, owner).astype(np.int32)
        parts = [self.gram_buckets(points, owner, n) for n in self.cfg.grams]
        bucket, of = (np.concatenate([p[k] for p in parts]).astype(np.int32) for k in (0, 1))
        order = np.argsort(of, kind="stable")
        return word_of, bucket[order], np.searchsorted(of[order], np.arange(len(words) + 1))

    def fit(self, prepared: tuple[np.ndarray, np.ndarray, np.ndarray], texts: list[np.ndarray], labels: np.ndarray) -> None:
        """Log odds of documents of label 1 against 0, for features that chance does not
        explain.  ``texts``: numbers of the prepared words, from 1 on."""
        cfg, seen = self.cfg, [np.zeros((2, size), np.int32) for size in (self.cfg.word_buckets, self.cfg.gram_buckets)]
        word_of, bucket, first = prepared
        for flat, y in zip(texts, labels, strict=True):
            own = np.unique(flat) - 1
            if not len(own):
                continue
            size = first[own + 1] - first[own]
            at = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            seen[0][int(y), np.unique(word_of[own])] += 1
            seen[1][int(y), np.unique(bucket[at])] += 1
        n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
        found = []
        for s in seen:
            odds = np.log((s[1] + 0.5) / (n1 + 1)) - np.log((s[0] + 0.5) / (n0 + 1))
            both, rate = s.sum(0), n1 / (n1 + n0)
            with np.errstate(divide="ignore", invalid="ignore"):
                g = 2 * (np.where(s[1] > 0, s[1] * np.log(s[1] / (both * rate)), 0) + np.where(s[0] > 0, s[0] * np.log(s[0] / (both * (1 - rate))), 0))
            sure = (both >= cfg.least_df) & (np.nan_to_num(g) > cfg.least_g)
            found.append(np.where(sure, np.clip(odds, -4, 8) / 4, 0).astype(np.float32))
        self.word, self.gram = found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two GRUs in opposite directions, attention over their states, one logit."""

    def __init__(self, cfg: ToxicityConfig):
        rng, h = np.random.default_rng(cfg.seed), cfg.hidden
        self.h, inputs = h, ODDS + 2 * cfg.embedding
        small = lambda *s: (rng.normal(size=s) * 0.3).astype(np.float32)
        self.p = {
            "W0": small(inputs, 3 * h), "U0": small(h, 3 * h), "W1": small(inputs, 3 * h), "U1": small(h, 3 * h),
            "a": small(2 * h), "v": small(2 * h), "b": np.zeros(1, np.float32),
        }

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The inputs' part of the gates; a row of zeros stands for padding."""
        return x @ self.p["W0"], x @ self.p["W1"]

    def _run(self, xw: np.ndarray, ids: np.ndarray, mask: np.ndarray, U: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
        n, t = ids.shape
        h = self.h
        state, out = np.zeros((n, h), np.float32), np.empty((t, n, h), np.float32)
        for i in range(t - 1, -1, -1) if back else range(t):
            x, m = xw[ids[:, i]], mask[:, i, None]
            hu = state @ U
            zr = _sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
            if keep is not None:
                keep.append((i, state, z, r, c, hu[:, 2 * h :]))
            state = state + m * (1 - z) * (c - state)
            out[i] = state
        return out

    def forward(self, xw: tuple[np.ndarray, np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: tuple | None = None):
        k0, k1 = keep or (None, None)
        out = np.concatenate([self._run(xw[0], ids, mask, self.p["U0"], False, k0), self._run(xw[1], ids, mask, self.p["U1"], True, k1)], 2)
        score = np.where(mask.T > 0, out @ self.p["a"], -1e9)
        e = np.exp(score - score.max(0)) * (mask.T > 0)
        att = e / np.maximum(e.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", att, out)
        return pooled @ self.p["v"] + self.p["b"][0], out, att, pooled

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss of windows; ``x`` of the inputs, a row a word."""
        p, h, keep = self.p, self.h, ([], [])
        logit, out, att, pooled = self.forward(self.project(x), ids, mask, keep)
        d = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g = {"b": np.array([d.sum()]), "v": pooled.T @ d}
        dpool = d[:, None] * p["v"]
        datt = np.einsum("nh,tnh->tn", dpool, out)
        dscore = att * (datt - (att * datt).sum(0))
        g["a"] = np.einsum("tn,tnh->h", dscore, out)
        g["x"] = np.zeros_like(x)
        dout = att[:, :, None] * dpool + dscore[:, :, None] * p["a"]
        for k, (steps, U, W) in enumerate(((keep[0], "U0", "W0"), (keep[1], "U1", "W1"))):
            gu, gw, dstate = np.zeros_like(p[U]), np.zeros_like(p[W]), np.zeros((len(ids), h), np.float32)
            for i, state, z, r, c, huc in reversed(steps):
                dnew, m = dstate + dout[i, :, k * h : (k + 1) * h], mask[:, i, None]
                dz, dc = -dnew * m * (c - state) * z * (1 - z), dnew * m * (1 - z) * (1 - c * c)
                dr = dc * huc * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], 1)
                dh = np.concatenate([dz, dr, dc * r], 1)
                gu += state.T @ dh
                gw += x[ids[:, i]].T @ dx
                np.add.at(g["x"], ids[:, i], (m > 0) * (dx @ p[W].T))
                dstate = dnew * (1 - m * (1 - z)) + dh @ p[U].T
            g[U], g[W] = gu, gw
        return g


class ToxicityModel:
    def __init__(self, cfg: ToxicityConfig, base: float = 0.0):
        self.cfg, self.base, self.features, self.net = cfg, base, None, None

    # ---- windows -----------------------------------------------------------------
    def _windows(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner document, start and length of every window; the last is moved back
        to end with the text, so that only texts shorter than a window are padded."""
        w, s = self.cfg.window, self.cfg.stride
        count = np.where(lengths > w, -(-(lengths - w) // s) + 1, 1)
        owner = np.repeat(np.arange(len(lengths)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = np.minimum(place * s, np.maximum(lengths[owner] - w, 0))
        return owner, start, np.minimum(lengths[owner], w)

    def _ids(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.cfg.window
        place = np.arange(w)
        mask = place < size[:, None]
        at = np.minimum(first[:, None] + place, max(0, len(flat) - 1))
        return np.where(mask, flat[at] if len(flat) else 0, 0), mask.astype(np.float32)

    @staticmethod
    def _number(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
        """The distinct words, and each text as their numbers from 1 on (0: padding)."""
        number: dict[str, int] = {}
        put = number.setdefault
        flat = [np.fromiter((put(w, len(number) + 1) for w in _words(t)), np.int32) for t in texts]
        return list(number), flat

    def _vectors(self, words: list[str]) -> np.ndarray:
        made = self.features.vectors(words)
        return np.concatenate([np.zeros((1, made.shape[1]), np.float32), made])

    def _cut(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words in a row; owner, first word and size of every window."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        owner, start, size = self._windows(lengths)
        return np.concatenate([*texts, np.zeros(0, np.int32)]), owner, (np.cumsum(lengths) - lengths)[owner] + start, size

    def _logits(self, x: np.ndarray, flat: np.ndarray, first: np.ndarray, size: np.ndarray, chunk: int = 2048) -> np.ndarray:
        xw, logits = self.net.project(x), np.empty(len(first), np.float32)
        for i in range(0, len(first), chunk):
            at = slice(i, i + chunk)
            logits[at] = self.net.forward(xw, *self._ids(flat, first[at], size[at]))[0]
        return logits

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.base)
        if not len(texts):
            return np.zeros(0)
        words, numbers = self._number(texts)
        flat, owner, first, size = self._cut(numbers)
        logits = self._logits(self._vectors(words), flat, first, size)
        top = np.maximum.reduceat(logits, np.flatnonzero(np.append(True, owner[1:] != owner[:-1])))
        return _sigmoid(top.astype(np.float64))

    # ---- training ----------------------------------------------------------------
    def fit(self, texts: list[str | None], labels: np.ndarray, prior: float | None = None) -> ToxicityModel:
        """Multiple-instance training: each epoch scores all windows, then learns
        from each document's strongest window (of label-0 documents also another).  Both
        classes weigh alike while learning; afterwards ``prior``, the share of label 1
        among all labelled rows, is put back, so that scores are probabilities."""
        cfg, labels = self.cfg, np.asarray(labels, np.int64)
        self.base = float(labels.mean()) if len(labels) else 0.0
        if len(np.unique(labels)) < 2:
            return self
        words, numbers = self._number(texts)
        self.net = Network(cfg)
        rng = np.random.default_rng(cfg.seed)
        # odds for a part of the sample come from the other parts
        fold = np.zeros(len(labels), np.int64)
        for y in (0, 1):
            own = rng.permutation(np.flatnonzero(labels == y))
            fold[own] = np.arange(len(own)) % cfg.folds
        n, prepared = len(words), Features(cfg).prepare(words)
        odds = np.zeros((cfg.folds, n + 1, ODDS), np.float32)  # of each part's words; the first row stands for padding
        for k in range(cfg.folds):
            other, rest = Features(cfg), (fold != k) | (cfg.folds == 1)
            other.fit(prepared, [t for t, h in zip(numbers, rest, strict=True) if h], labels[rest])
            odds[k, 1:] = other.odds(words)
            del other
        self.features = Features(cfg)
        self.features.fit(prepared, numbers, labels)  # the odds of all labelled documents serve after learning
        del prepared
        word, gram, of = (v.astype(np.int32) for v in self.features.rows(words))
        gram_first = np.searchsorted(of, np.arange(n + 1))
        counts = np.bincount(np.concatenate([np.unique(t) - 1 for t in numbers if len(t)] or [np.zeros(0, np.int64)]), minlength=n)
        common = counts >= cfg.least_df
        flat, owner, first, size = self._cut(numbers)
        del words, numbers
        part_of = fold[owner]
        at_doc = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))

        def by_part(score) -> np.ndarray:
            """``score(k, first, size)`` of the windows of each part."""
            out = np.empty(len(first), np.float32)
            for k in range(cfg.folds):
                at = np.flatnonzero(part_of == k)
                out[at] = score(k, first[at], size[at])
            return out

        def strongest(k: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
            strong = odds[k, :, 0] + odds[k, :, 1:4].max(1)
            return np.concatenate([np.zeros(0), *[strong[self._ids(flat, first[i : i + 2048], size[i : i + 2048])[0]].max(1) for i in range(0, len(first), 2048)]])

        # before the network has learned anything, a window's strength is its strongest input
        logits = by_part(strongest)
        m1, m2 = ({k: np.zeros(v.shape, np.float64) for k, v in self.net.p.items()} for _ in range(2))
        seen = [np.zeros(len(t), np.float32) for t in (self.features.word_table, self.features.gram_table)]
        step = 0
        for epoch in range(cfg.epochs):
            order = np.lexsort((-logits, owner))
            other = at_doc + (rng.random(len(at_doc)) * np.diff(np.append(at_doc, len(owner)))).astype(np.int64)
            chosen = np.concatenate([order[at_doc], other[labels == 0]])
            y = labels[owner[chosen]].astype(np.float32)
            weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
            for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // cfg.batch)):
                step += 1
                ids, mask = self._ids(flat, first[chosen[part]], size[chosen[part]])
                # the batch's words alone, each part's apart
                used, ids = np.unique(ids + (n + 1) * part_of[chosen[part]][:, None], return_inverse=True)
                ids, own, which = ids.reshape(mask.shape), used % (n + 1), used // (n + 1)
                x = np.concatenate([odds[which, own], self._embedded_rows(own, word, gram, gram_first)], 1)
                g = self.net.gradients(x, ids, mask, y[part], weight[part])
                self._learn_embeddings(g.pop("x")[:, ODDS:], own, common, word, gram, gram_first, seen)
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    move = m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
                    self.net.p[k] = (self.net.p[k] - cfg.rate * move).astype(np.float32)
            if epoch % cfg.rescan == cfg.rescan - 1 and epoch + 1 < cfg.epochs:
                embedded = np.concatenate([np.zeros((1, 2 * cfg.embedding), np.float32), self.features.embedded(word, gram, of)])
                logits = by_part(lambda k, f, z, e=embedded: self._logits(np.concatenate([odds[k], e], 1), flat, f, z))
                del embedded
        share = min(max(float(labels.mean()) if prior is None else prior, 0.02), 0.98)
        self.net.p["b"] = self.net.p["b"] + np.float32(np.log(share / (1 - share)))
        return self


    @staticmethod
    def _grams_of(word: np.ndarray, gram_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all n-grams of some words, and which of the words each is of."""
        many = gram_first[word + 1] - gram_first[word]
        at = np.repeat(gram_first[word] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return at, np.repeat(np.arange(len(word)), many)

    def _embedded_rows(self, own: np.ndarray, word: np.ndarray, gram: np.ndarray, gram_first: np.ndarray) -> np.ndarray:
        """Embeddings of words by their numbers; those of 0, padding, are 0."""
        at, of = self._grams_of(np.maximum(own - 1, 0), gram_first)
        out = self.features.embedded(word[np.maximum(own - 1, 0)], gram[at], of)
        out[own == 0] = 0
        return out

    def _learn_embeddings(self, g: np.ndarray, own: np.ndarray, common: np.ndarray, word: np.ndarray, gram: np.ndarray, gram_first: np.ndarray, seen: list[np.ndarray]) -> None:
        """One step of Adagrad, a rate for each row, on the rows that the batch touched."""
        cfg, d = self.cfg, self.cfg.embedding
        keep = (own > 0) & common[np.maximum(own - 1, 0)]
        own, g = own[keep] - 1, g[keep]
        at, of = self._grams_of(own, gram_first)
        share = 1 / np.maximum(gram_first[own + 1] - gram_first[own], 1)
        for table, total, rows, value in ((self.features.word_table, seen[0], word[own], g[:, :d]), (self.features.gram_table, seen[1], gram[at], (g[:, d:] * share[:, None])[of])):
            touched, place = np.unique(rows, return_inverse=True)
            step = np.zeros((len(touched), d), np.float32)
            np.add.at(step, place, value)
            total[touched] += (step * step).mean(1)
            table[touched] = (1 - cfg.embedding_decay) * table[touched] - cfg.embedding_rate * step / (np.sqrt(total[touched]) + 1e-8)[:, None]


def fit_toxicity(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fit on a bounded sample (``sample_per_class``, ``sample_chars``) of labelled
    documents outside the held-out fold, taken in the order of a hash of their id."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where(fold(F.col("doc_id"), cfg.holdout_mod) != cfg.holdout)
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    picked: list[tuple[int, int]] = []
    for y in (1, 0):
        rows = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.sample_per_class).collect()
        picked += [(r["doc_id"], y) for r in rows]
    order = [i for pair in zip(picked[: len(picked) // 2], picked[len(picked) // 2 :]) for i in pair]
    order += picked[2 * (len(picked) // 2) :]
    y_of = dict(picked)
    texts = bounded_texts(docs, [i for i, _ in order], cfg.sample_chars)
    y = np.array([y_of[i] for i in texts], np.int64)
    model = ToxicityModel(cfg).fit(list(texts.values()), y, prior)
    del texts
    release()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            own = texts.tolist()
            yield pd.Series(np.concatenate([np.zeros(0), *[model.scores(own[a:b]) for a, b in spans(own)]]))

    return docs.withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= model.cfg.threshold).cast("int"))
