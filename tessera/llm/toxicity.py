"""Toxicity by a classifier chain: linear models in a fixed order, each seeing the probabilities of those before it.

While the chain is fitted, a training row's earlier probabilities come from models that did not see the row (out of
fold), so later models learn from inputs as uncertain as those they will meet. Models are fitted on a bounded sample of
labelled rows; scoring runs over whole texts of all rows, with no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import text_batches, tidied

#: The chain in its order: a category and what says so in a row of labels. Abuse in junk texts is a category of its own, which
#: reads the two before it; a document is toxic by either kind.
CHAIN = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_low_quality": "toxic = 1 and quality = 0"}
TOXIC = ("toxic", "toxic_low_quality")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")
#: Labelled rows that fitting reads at most, the smallest by a hash of the id.
MAX_LABELLED = 10_000
FOLDS = 4
MIN_WEIGHT, MIN_Z, MAX_FEATURES, RIDGE = 5.0, 5.0, 256, 0.1
#: Beside itself a word stands for its first letters, so that inflected and compound insults share weight.
STEMS = (4, 5, 6)


def word_code(word: str) -> int:
    return zlib.crc32(word.encode())


def codes_of(word: str) -> list[int]:
    return [word_code(word), *(word_code("^" + word[:n]) for n in STEMS if len(word) >= n)]


def words(text: str | None) -> set[str]:
    return set(TOKEN.findall(text.lower())) if text else set()


@dataclass
class Linear:
    """Logistic model over word codes (present or not) and extra columns."""

    codes: np.ndarray
    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def predict(self, present: np.ndarray, extra: np.ndarray) -> np.ndarray:
        z = present @ self.weights + extra @ self.extra + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sample:
    """Labelled rows as one array of word codes, with weights."""

    def __init__(self, codes: list[np.ndarray]):
        self.n = len(codes)
        flat = np.concatenate([*codes, np.empty(0, "<u4")])
        row = np.repeat(np.arange(self.n, dtype=np.int32), [len(c) for c in codes])
        # Codes of too few rows can never be chosen; without them the sample is a small part of its size.
        self.codes, counts = np.unique(flat, return_counts=True)
        self.codes = self.codes[counts >= MIN_WEIGHT]
        at = np.minimum(np.searchsorted(self.codes, flat), max(0, len(self.codes) - 1))
        hit = self.codes[at] == flat if len(self.codes) else np.zeros(len(flat), bool)
        self.row, self.at = row[hit], at[hit]
        # Near copies mostly share their four least mixed codes; they count once together.
        sketch = [np.sort(c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:4].tobytes() or i for i, c in enumerate(codes)]
        group: dict = {}
        of = np.array([group.setdefault(x, len(group)) for x in sketch], int)
        self.weight = 1.0 / np.bincount(of)[of] if self.n else np.empty(0)

    def present(self, codes: np.ndarray) -> np.ndarray:
        x = np.zeros((self.n, len(codes)), np.float32)
        column = np.full(len(self.codes), -1)
        column[np.searchsorted(self.codes, codes)] = np.arange(len(codes))
        hit = column[self.at] >= 0
        x[self.row[hit], column[self.at[hit]]] = 1
        return x

    def fit(self, y: np.ndarray, extra: np.ndarray, rows: np.ndarray) -> Linear:
        """rows: mask of those to learn from. Words are chosen by a two-sample test on these rows alone, then Newton steps with a ridge."""
        w = np.where(rows, self.weight, 0.0)
        pos, neg = float(w @ y), float(w @ (1 - y))
        if pos == 0 or neg == 0:
            return Linear(np.empty(0, "<u4"), np.empty(0), np.zeros(extra.shape[1]), -30.0 if pos == 0 else 30.0)
        a = np.bincount(self.at, (w * y)[self.row], len(self.codes))
        b = np.bincount(self.at, (w * (1 - y))[self.row], len(self.codes))
        p = np.clip((a + b) / (pos + neg), 1e-12, 1 - 1e-12)
        z = np.abs(a / pos - b / neg) / np.sqrt(p * (1 - p) * (1 / pos + 1 / neg))
        good = np.flatnonzero((a + b >= MIN_WEIGHT) & (z >= MIN_Z))
        codes = np.sort(self.codes[good[np.argsort(-z[good], kind="stable")[:MAX_FEATURES]]])
        x = np.hstack([self.present(codes), extra, np.ones((self.n, 1))]).astype(np.float64)
        beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
        ridge[-1] = 1e-6
        for _ in range(15):
            prob = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = x.T @ (w * (y - prob)) - ridge * beta
            curve = (x * (w * np.maximum(prob * (1 - prob), 1e-6))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(curve, slope)
            beta += step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-3:
                break
        k = len(codes)
        return Linear(codes, beta[:k], beta[k:-1], float(beta[-1]))


def fit_chain(codes: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """A model for each column of labels, in order; folds: a number for each row."""
    sample, models = Sample(codes), []
    earlier = np.zeros((sample.n, 0))
    everything = np.ones(sample.n, bool)
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(sample.fit(y, earlier, everything))
        out_of_fold = np.zeros(sample.n)
        for f in np.unique(folds) if k + 1 < labels.shape[1] else ():
            m = sample.fit(y, earlier, folds != f)
            out_of_fold[folds == f] = m.predict(sample.present(m.codes), earlier)[folds == f]
        earlier = np.column_stack([earlier, out_of_fold])
    return models


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, chain: dict[str, str] | None = None) -> list[Linear]:
    """The chain, fitted on at most max_labelled labelled documents. chain: conditions on the labels' columns by category, in order.

    Labels that have a null where a category looks, or no document, and null ids, take no part; an id labelled twice is in a
    category if any of its labels says so; of repeated documents the smallest text counts. Without labels of both kinds a
    model is constant. Empty tables give constant models; columns that clash with the categories' names do no harm.
    """
    text_batches(docs.sparkSession)
    chain = chain or CHAIN
    flags = [f"_{k}" for k in range(len(chain))]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.expr(c).cast("int").alias(f) for f, c in zip(flags, chain.values(), strict=True))).dropna()
    chosen = known.groupBy("doc_id").agg(*(F.max(f).alias(f) for f in flags)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *flags).agg(F.min("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [np.unique(np.fromiter((c for w in words(t) for c in codes_of(w)), "<u4")) for t in b.column(len(flags) + 1).to_pylist()]
            yield pa.record_batch([*b.columns[:-1], pa.array([c.tobytes() for c in codes], pa.binary())], ["doc_id", *flags, "codes"])

    got = rows.mapInArrow(tidied(encode), f"doc_id long, {', '.join(f'{f} int' for f in flags)}, codes binary").toArrow().sort_by("doc_id")  # max_labelled rows at most
    codes = [np.frombuffer(c, "<u4") for c in got["codes"].to_pylist()]
    folds = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in got["doc_id"].to_pylist()], int)
    return fit_chain(codes, np.column_stack([np.asarray(got[f]).astype(int) for f in flags]), folds)


class Scorer:
    """The chain applied to texts, a slice of them at a time; what a word stands for is kept from slice to slice."""

    def __init__(self, models: list[Linear], slice_chars: int = 2_000_000, kept_words: int = 400_000):
        self.models, self.slice_chars, self.kept_words = models, slice_chars, kept_words
        codes = np.unique(np.concatenate([m.codes for m in models]))
        self.index = {int(c): i for i, c in enumerate(codes)}
        self.columns = [np.searchsorted(codes, m.codes) for m in models]
        self.known: dict[str, list[int]] = {}

    def _present(self, texts: list[str | None]) -> np.ndarray:
        found = [words(t) for t in texts]
        every = set().union(*found)
        if len(self.known) > self.kept_words:
            self.known.clear()
        for w in every.difference(self.known):
            self.known[w] = [self.index[c] for c in codes_of(w) if c in self.index]
        relevant = {w for w in every if self.known[w]}
        present = np.zeros((len(texts), len(self.index)))
        for r, f in enumerate(found):
            for w in relevant & f:
                present[r, self.known[w]] = 1
        return present

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """(text, category)"""
        out, start = np.empty((len(texts), len(self.models))), 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < self.slice_chars):
                size += len(texts[stop] or "")
                stop += 1
            present, earlier = self._present(texts[start:stop]), np.zeros((stop - start, 0))
            for m, cols in zip(self.models, self.columns, strict=True):
                earlier = np.column_stack([earlier, m.predict(present[:, cols], earlier)])
            out[start:stop] = earlier
            start = stop
        return out


def _found(p: np.ndarray, chain: tuple[str, ...], toxic: tuple[str, ...], threshold: float) -> np.ndarray:
    """How many of the toxic categories each text is in."""
    return (p[:, [chain.index(c) for c in toxic]] >= threshold).sum(axis=1)


def score(docs: DataFrame, models: list[Linear], threshold: float = 0.5, chain: tuple[str, ...] = tuple(CHAIN), toxic: tuple[str, ...] = TOXIC) -> DataFrame:
    """(doc_id, a probability p_ for each category of the chain, n_toxic, toxic) for every row.

    n_toxic: categories of `toxic` with a probability of threshold or more; toxic: any. A null or empty text has no words and
    gets the models' base rates; null ids stay null; repeated rows are repeated; other columns aren't read; whole texts are
    read, a slice of rows at a time. No rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for b in batches:
            p = scorer(b.column(1).to_pylist())
            n = _found(p, chain, toxic, threshold)
            yield pa.record_batch([b.column(0), *(pa.array(p[:, k]) for k in range(len(chain))), pa.array(n, pa.int64()), pa.array(n > 0)], ["doc_id", *(f"p_{c}" for c in chain), "n_toxic", "toxic"])

    text_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(tidied(run), "doc_id long, " + ", ".join(f"p_{c} double" for c in chain) + ", n_toxic long, toxic boolean")


def drop_toxic(docs: DataFrame, models: list[Linear], threshold: float = 0.5, chain: tuple[str, ...] = tuple(CHAIN), toxic: tuple[str, ...] = TOXIC) -> DataFrame:
    """The rows of docs that score() doesn't call toxic, with all their columns, whatever these are called.

    Null and empty texts are judged by the models' base rates; rows without an id and repeated rows are judged each by its text.
    """
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for b in batches:
            n = _found(scorer(b.column(at).to_pylist()), chain, toxic, threshold)
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(n == 0)).columns, names=names)

    text_batches(docs.sparkSession)
    return docs.mapInArrow(tidied(run), docs.schema)
