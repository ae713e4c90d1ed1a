"""Sequence packing by concatenate and cut.

All documents' ids, each document followed by an end id, form one long stream in
the order of the input's partitions; the stream is cut every ``length`` ids.

Pass 1 tokenises every partition once, numbers its documents' first ids within
the partition and writes ids and numbers to the shared folder.  Prefix sums over
the partitions' totals (one row each) then give every document's place in the
whole stream, and pass 2 cuts each document at the window borders without moving
it: a document that crosses a border leaves one record on either side.

Only the last sequence can be short, so padding is under one sequence in all.
(It stays unpadded if its size happens to be a power of two.)

Results at the edges: a null or empty text is its end id alone, in one piece;
texts of any length are read whole; repeated rows are packed as often as they
occur; an empty table gives no pieces; a null id stays null; extra columns are
ignored.  A text that contains the string of one of the vocabulary's added tokens has
that token's id there, as with the ``tokenizers`` library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices


@dataclass(frozen=True)
class PackingConfig:
    vocabulary: str = ""
    length: int = 2048
    end_id: int = 1
    #: A run of so many characters without white space goes to the slower encoder,
    #: whose time does not grow with the square of the run.
    long_run: int = 4000


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary file of the tokenizers library.

    The ids are those of ``tokenizers`` with add_special_tokens=False; the file's
    vocabulary lists its merges by id, so that the same ranks drive the faster
    tiktoken encoder (tests hold the two against each other).  Added tokens are cut out
    of a text first, the longest one at the leftmost place; where they have rules of their
    own (whole words, white space at their sides) the library reads all texts itself."""

    def __init__(self, path: str, long_run: int):
        import re

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _byte_letters()
        added = model.get("added_tokens") or []
        self.added = {t["content"]: t["id"] for t in added}
        self.mark = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.rules = bool(model.get("normalizer")) or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
        ranks = {bytes(letters[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in self.added}
        self.size = max([*model["model"]["vocab"].values(), *self.added.values()]) + 1
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self._sure = path, None
        self.run = re.compile(r"\S{%d}|\s{%d}" % (long_run, long_run))
        self.long_run = long_run

    @property
    def sure(self):
        if self._sure is None:
            from tokenizers import Tokenizer

            self._sure = Tokenizer.from_file(self.path)
        return self._sure

    def __call__(self, text: str) -> list[int]:
        if self.rules or len(text) >= self.long_run and self.run.search(text):
            return self.sure.encode(text, add_special_tokens=False).ids
        if self.mark is None or not any(c in text for c in self.added):
            return self.fast.encode_ordinary(text)
        out: list[int] = []
        for k, piece in enumerate(self.mark.split(text)):  # every other piece is an added token
            out += [self.added[piece]] if k % 2 else self.fast.encode_ordinary(piece)
        return out


@lru_cache(2)
def encoder(path: str, long_run: int) -> Encoder:
    """One encoder a worker: building it anew for each task takes time and memory."""
    return Encoder(path, long_run)


def tokenise(docs: DataFrame, cfg: PackingConfig) -> DataFrame:
    """(part, doc_id, first, n, ids): ids as little-endian numbers of 2 bytes, or 4
    where the vocabulary needs them; ``first`` counts the partition's ids before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(cfg.vocabulary, cfg.long_run), TaskContext.get().partitionId(), 0
        kind = "<u2" if max(encode.size, cfg.end_id + 1) <= 1 << 16 else "<u4"
        for batch in chain.from_iterable(map(slices, batches)):
            ids, firsts, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                own = np.array([*encode(text or ""), cfg.end_id], kind)
                ids.append(own.tobytes())
                firsts.append(at)
                sizes.append(len(own))
                at += len(own)
            columns = [pa.array([part] * len(ids), pa.int32()), batch.column(0), pa.array(firsts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "first", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"part int, doc_id {kind}, first long, n long, ids binary")


def pack(docs: DataFrame, cfg: PackingConfig) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and
    ``ids``, the piece's ids as little-endian numbers of 4 bytes."""
    tokens = materialise(tokenise(docs, cfg), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    placed = tokens.join(F.broadcast(before), "part")  # a row for each input partition
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            rows, out = [], [[] for _ in range(6)]
            for i, (at, n, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    size = min(n - start, cfg.length - (at + start) % cfg.length)
                    rows.append(i)
                    for column, value in zip(out, (start, size, n, (at + start) // cfg.length, (at + start) % cfg.length, own[start : start + size].tobytes()), strict=True):
                        column.append(value)
                    start += size
            numbers = [pa.array(c, pa.int64()) for c in out[:5]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *numbers, pa.array(out[5], pa.binary())], names)

    flat = placed.select("doc_id", (F.col("before") + F.col("first")).alias("at"), "n", "ids")
    return flat.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
