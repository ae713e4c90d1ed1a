"""Soft-membership mixing of documents to target domain weights.

A softmax regression over byte-trigram shares, trained on labelled documents,
gives every document a posterior over domains.  A document of t tokens with rate
r gives each domain r t p(domain) expected tokens.  Nonnegative rates whose
domain totals match the targets are found by projected gradient descent on the
weighted least squares of the domains' relative errors, from rates of 1: each
iteration is one aggregation of a few sums over all documents, after which every
document moves against the gradient and is cut off at 0.  A document's rate
depends on its posterior and the few gradients so far, so that no rates need be
stored between iterations, and nothing but the domains' sums leaves the cluster.
``mix_with_report`` says what was reached; ``mix`` warns if that is not the target.

A document's tokens are its ids by the vocabulary of ``vocabulary``, or its words if
none is given.

Results at the edges: a null or empty text has no tokens and the posterior of an
empty text; texts of any length are read whole; ties do not arise; rows with a null id are mixed like others; repeated rows get equal
rates and equal copies; a domain that no document supports keeps its error, the
others are matched; an empty table gives an empty result; without labels to
learn from there is one domain and every rate is the scale of the total.  Other
columns pass through; columns named like an output are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, materialise, prefix, release, spans
from .packing import PackingConfig, encoder


@dataclass(frozen=True)
class MixingConfig:
    #: Domain name -> share of the tokens; the names are those of the labelled table's classes.
    targets: dict[str, float] = field(default_factory=lambda: {"high": 0.9, "low": 0.1})
    buckets: int = 4096
    #: Labelled documents of each domain that are learned from, and characters in all, at most.
    sample_per_domain: int = 800
    sample_chars: int = 5_000_000
    epochs: int = 300
    iterations: int = 60
    tolerance: float = 1e-3
    #: 'supply': the largest total at which no domain needs more than it has; 'corpus': the corpus' total.
    total: str = "supply"
    seed: int = 5
    #: A vocabulary file of the tokenizers library; empty: tokens are words.
    vocabulary: str = ""


class DomainModel:
    def __init__(self, cfg: MixingConfig, domains: list[str]):
        self.cfg, self.domains = cfg, domains
        self.w = np.zeros((cfg.buckets, len(domains)), np.float32)
        self.b = np.zeros(len(domains), np.float32)

    def _buckets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Trigram buckets of all bytes, each text between two zero bytes, and sizes."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        flat = np.frombuffer(b"\0" + b"\0\0".join(raw) + b"\0", np.uint8).astype(np.uint32)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 2
        code = np.zeros(len(flat), np.uint32)
        code[:-2] = (flat[:-2] * np.uint32(65599) + flat[1:-1]) * np.uint32(65599) + flat[2:]
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(self.cfg.buckets)))
        return code.astype(np.int64), size

    def _shares(self, texts: list[str | None]) -> np.ndarray:
        code, size = self._buckets(texts)
        owner = np.repeat(np.arange(len(size)), size)
        counts = np.bincount(owner * self.cfg.buckets + code, minlength=len(size) * self.cfg.buckets)
        return (counts.reshape(len(size), -1) / size[:, None]).astype(np.float32)

    def fit(self, texts: list[str], y: np.ndarray) -> DomainModel:
        k = len(self.domains)
        x = np.concatenate([self._shares(texts[i : i + 256]) for i in range(0, len(texts), 256)]) if texts else np.zeros((0, self.cfg.buckets), np.float32)
        if k < 2 or not len(x):
            return self
        scale = 1 / (np.sqrt((x**2).mean(0)) + 1e-3)
        x = x * scale
        hot = np.eye(k, dtype=np.float32)[y]
        weight = (1 / np.maximum(hot.sum(0), 1))[y] * (len(y) / k)
        w, b = np.zeros((self.cfg.buckets, k), np.float32), np.zeros(k, np.float32)
        rate = 4.0 / np.square(np.linalg.norm(x, axis=1)).mean()
        for _ in range(self.cfg.epochs):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - hot) * weight[:, None] / len(y)
            w -= rate * (x.T @ d + 1e-4 * w)
            b -= rate * d.sum(0)
        self.w, self.b = (w * scale[:, None]).astype(np.float32), b
        # the training classes were weighted alike: put the labelled table's shares back
        self.b = self.b + np.log(np.maximum(hot.mean(0), 1e-6)).astype(np.float32) + np.log(k)
        return self

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros((0, len(self.domains)))
        code, size = self._buckets(texts)
        start = np.cumsum(size) - size
        z = np.stack([np.add.reduceat(self.w[:, k][code], start, dtype=np.float64) / size for k in range(len(self.domains))], 1) + self.b
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_domains(docs: DataFrame, labelled: DataFrame, cfg: MixingConfig) -> DomainModel:
    """``labelled``: doc_id, domain.  Learns from a bounded sample of each domain that
    has a target, in the order of a hash of the ids."""
    domains = sorted(cfg.targets)
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    shares = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    model = DomainModel(cfg, domains)
    of: dict[str, list[int]] = {}
    for name in sorted(shares):
        rows = known.where(F.col("domain") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.sample_per_domain).collect()
        of[name] = [r["doc_id"] for r in rows]
    turn = [(ids[i], name) for i in range(cfg.sample_per_domain) for name, ids in of.items() if i < len(ids)]
    name_of = dict(turn)
    texts = bounded_texts(docs, [i for i, _ in turn], cfg.sample_chars)
    ids = list(texts)
    model.fit([texts[i] for i in ids], np.array([domains.index(name_of[i]) for i in ids], np.int64))
    del texts
    release()
    total, sample = sum(shares.values()), max(1, len(ids))
    for k, name in enumerate(domains):  # the sample was drawn by domain: the table's shares are the priors
        own = sum(name_of[i] == name for i in ids)
        model.b[k] += np.log(max(shares.get(name, 0) / max(1, total), 1e-6) / max(own / sample, 1e-6))
    return model


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """``docs`` with ``tokens`` and ``posterior`` (array in the order of domains)."""
    cfg = model.cfg

    @F.pandas_udf("tokens long, posterior array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids = encoder(cfg.vocabulary, PackingConfig.long_run) if cfg.vocabulary else str.split
        for texts in batches:
            own = texts.tolist()
            found = [p for a, b in spans(own) for p in model.posteriors(own[a:b])]
            yield pd.DataFrame({"tokens": [len(ids(t)) if t else 0 for t in own], "posterior": pd.Series(found, dtype=object)})

    own = f"{prefix(docs)}made"
    made = docs.withColumn(own, predict(F.col("text")))
    return made.withColumns({c: F.col(f"{own}.{c}") for c in ("tokens", "posterior")}).drop(own)


def _rate(moves: list[list[float]]):
    """The rate after the moves so far: one fused expression, as each step reads the
    last rate once."""
    rate = F.lit(1.0)
    for move in moves:
        step = F.lit(0.0)
        for k, g in enumerate(move):
            step = step + F.col("posterior")[k] * F.lit(float(g))
        rate = F.greatest(F.lit(0.0), rate - step)
    return rate


def fit_rates(made: DataFrame, cfg: MixingConfig, domains: list[str]) -> tuple[list[list[float]], dict]:
    """The moves that lead to the rates, and a report (totals, targets, iterations)."""
    k = len(domains)
    share = np.array([cfg.targets[d] for d in domains], float)
    share /= share.sum()
    t, p = F.col("tokens").cast("double"), F.col("posterior")
    sums = [F.sum(t * p[i]).alias(f"s{i}") for i in range(k)] + [F.sum(t * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
    row = made.agg(*sums).first()
    have = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
    report = {"domains": domains, "iterations": 0, "supply": have.tolist(), "target": [0.0] * k, "reached": have.tolist()}
    if have.sum() <= 0:
        return [], report
    gram = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = row[f"m{i}_{j}"] or 0.0
    total = have.sum()
    if cfg.total == "supply":
        total = min(have[i] / share[i] for i in range(k) if share[i] > 0 and have[i] > 0)
    target = share * total
    # relative errors weigh alike; steps of one over the largest curvature cannot overshoot
    scale = 1 / np.maximum(have, 1e-9 * have.sum())
    curvature = np.linalg.eigvalsh(np.sqrt(scale)[:, None] * gram * np.sqrt(scale)[None, :]).max()
    sums = [F.sum(t * p[i] * F.col("rate")).alias(f"s{i}") for i in range(k)]
    moves, reached, missed = [], have, []
    for _ in range(cfg.iterations):
        missed.append(float(np.abs(reached - target).max() / total))
        if missed[-1] <= cfg.tolerance or len(missed) > 8 and missed[-9] - missed[-1] < 1e-3 * missed[-1]:
            break  # reached, or as near as the documents allow
        moves.append(((reached - target) * scale / curvature).tolist())
        row = made.select("tokens", "posterior", _rate(moves).alias("rate")).agg(*sums).first()
        reached = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
    return moves, report | {"iterations": len(moves), "target": target.tolist(), "reached": reached.tolist()}


def mix_with_report(docs: DataFrame, labelled: DataFrame, cfg: MixingConfig = MixingConfig()) -> tuple[DataFrame, dict]:
    """(``docs`` with ``tokens``, ``posterior``, ``rate`` and ``copies``, the report of the fit):
    copies are the rate's whole part, and one more by a hash of the id with the chance
    of its fraction."""
    model = fit_domains(docs, labelled, cfg)
    plain = docs.drop("tokens", "posterior", "rate", "copies")
    made = materialise(posteriors(plain, model), "posteriors")  # one pass over the texts
    moves, report = fit_rates(made, cfg, model.domains)
    chance = F.pmod(F.xxhash64(F.lit(cfg.seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rated = made.withColumn("rate", _rate(moves))
    return rated.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("int")), report


def mix(docs: DataFrame, labelled: DataFrame, cfg: MixingConfig = MixingConfig()) -> DataFrame:
    """``mix_with_report`` without the report: warns if the targets were not met."""
    made, report = mix_with_report(docs, labelled, cfg)
    off = max((abs(a - b) for a, b in zip(report["reached"], report["target"], strict=True)), default=0.0)
    if off > cfg.tolerance * max(sum(report["target"]), 1e-9):
        warnings.warn(f"no nonnegative rates meet the targets: {report}", stacklevel=2)
    return made
