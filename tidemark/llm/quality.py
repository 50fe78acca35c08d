"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. Its features are its own measures (letter case, marks, repetition, word
lengths and so on, each put into one of a few quantile bins) and those of the lines before and after it;
pairs of neighbouring labels have weights too. The field is fitted in numpy by its exact gradient, with the
document's label for all its lines. A document's quality is the mean of its lines' marginals for good, from the
forward-backward recursion, weighted by line length; a monotone map then puts the cut that serves the training
rows best at THRESHOLD.

The fit sees at most SAMPLE documents of each label, chosen by a hash of the id (of rows with one id, the least text);
everything else covers all rows. Null, empty and blank texts score 0. Without training rows of both labels every other
text scores 1. Null labels are not learnt from; a label given twice counts as bad if one is. Repeated rows and null ids
are scored row by row; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, lexer

SAMPLE, BINS = 2500, 8
MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.7

_KINDS = np.zeros((256, 6), np.int64)  # upper-case letters, letters, plain marks, other marks, digits, spaces
_KINDS[65:91, 0] = _KINDS[65:91, 1] = _KINDS[97:123, 1] = _KINDS[192:, 1] = 1
_KINDS[np.frombuffer(b".,;:'\"-()?", np.uint8), 2] = 1
_KINDS[np.frombuffer(b"!#$%&*+/<=>@[\\]^_`{|}~", np.uint8), 3] = 1
_KINDS[48:58, 4] = 1
_KINDS[[9, 32], 5] = 1
MEASURES = 11


def line_measures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, length in bytes, measures) of each line."""
    w = lexer.words(texts)
    data = w.data
    stop = np.flatnonzero(data == 10)
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    doc = np.searchsorted(w.edges, start, "right") - 1
    length = stop - start
    totals = []
    for k in range(_KINDS.shape[1]):
        sums = np.concatenate([[0], np.cumsum(_KINDS[data, k])])
        totals.append(sums[stop] - sums[start])
    # A capital of Latin-1: its first byte is 0xC3, its second below 0xA0.
    sums = np.concatenate([[0], np.cumsum(np.append((data[:-1] == 0xC3) & (data[1:] < 0xA0), False))]) if len(data) else np.zeros(1, int)
    upper, letters, plain, odd, digits, spaces = totals
    upper = upper + sums[stop] - sums[start]
    word = w.only(w.kind == lexer.LETTER)
    line = np.searchsorted(stop, word.start)
    h = word.hashes
    n_words = np.bincount(line, minlength=len(stop))
    order = np.lexsort((h, line))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], fresh, len(stop))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, again, len(stop))
    whole = lexer.mix(lexer.hash_spans(data, start, stop) ^ lexer.mix(doc.astype(np.uint64), 3)) if len(start) else np.zeros(0, np.uint64)
    _, at, copies = np.unique(whole, return_inverse=True, return_counts=True)
    copies = np.where(length > 0, copies[at] if len(at) else 0, 1)
    size, some, many = np.maximum(length, 1), np.maximum(letters, 1), np.maximum(n_words, 1)
    measures = np.stack([upper / some, plain / size, odd / size, digits / size, spaces / size, distinct / many, repeats / many, letters / many, np.log1p(length), np.minimum(copies - 1, 4), distinct], 1)
    return doc, length, measures


@dataclass
class Field:
    edges: np.ndarray  # (MEASURES, BINS - 1) bin bounds
    emission: np.ndarray  # weights for good of each (place, measure, bin); bin BINS stands for a missing neighbour
    transition: np.ndarray  # (2, 2)
    cut: float

    def bins(self, doc: np.ndarray, measures: np.ndarray) -> np.ndarray:
        """Emission weight numbers of each line: those of the line before, of its own, of the line after."""
        own = np.stack([np.searchsorted(e, m, "right") for e, m in zip(self.edges, measures.T, strict=True)], 1) if len(measures) else np.zeros((0, MEASURES), np.int64)
        before, after = np.full_like(own, BINS), np.full_like(own, BINS)
        same = doc[1:] == doc[:-1]
        before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
        places = np.stack([before, own, after], 1)
        return (places + (np.arange(3)[:, None] * MEASURES + np.arange(MEASURES)) * (BINS + 1)).reshape(len(own), -1)

    def marginals(self, doc: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The probability that each line is good."""
        e = self.emission[features].sum(1)
        return chain_marginals(doc, np.stack([np.zeros_like(e), e], 1), self.transition)[0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        doc, length, measures = line_measures(texts)
        good = self.marginals(doc, self.bins(doc, measures))
        weight = np.bincount(doc, length, len(texts))
        mean = np.bincount(doc, length * good, len(texts)) / np.maximum(weight, 1)
        score = np.where(mean < self.cut, mean / self.cut * THRESHOLD, THRESHOLD + (mean - self.cut) / max(1 - self.cut, 1e-9) * (1 - THRESHOLD))
        blank = np.array([not (t or "").strip() for t in texts], bool)
        return np.where(blank, 0.0, np.clip(score, 0, 1))


def chain_marginals(doc: np.ndarray, emit: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once, place by place: (P(label 1) of each line, pair marginals by line; first lines 0, log of its chain's total)."""
    n = len(doc)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2)), np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    add = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    forward[first] = emit[first]
    for t in range(1, length[0]):
        at = first[: active[t]] + t
        forward[at] = emit[at] + add((forward[at - 1][:, :, None] + transition).swapaxes(1, 2))
    for t in range(length[0] - 1, 0, -1):
        at = first[: active[t]] + t
        backward[at - 1] = add(transition + (emit[at] + backward[at])[:, None, :])
    both = forward + backward
    whole = add(both)
    pairs = np.zeros((n, 2, 2))
    inner = np.flatnonzero(np.concatenate([[False], doc[1:] == doc[:-1]]))
    pairs[inner] = np.exp(forward[inner - 1][:, :, None] + transition + (emit[inner] + backward[inner])[:, None, :] - whole[inner][:, None, None])
    return np.exp(both[:, 1] - whole), pairs, whole


def likelihood(field: Field, doc: np.ndarray, features: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """(log-likelihood of the labels, its gradient by emission and transition weights); label, weight: of each line, a document's weights being equal."""
    e = field.emission[features].sum(1)
    inner = np.flatnonzero(np.concatenate([[False], doc[1:] == doc[:-1]]))
    good, pairs, log_total = chain_marginals(doc, np.stack([np.zeros_like(e), e], 1), field.transition)
    held = e * label * weight
    own = held.sum() + (field.transition[label[inner - 1], label[inner]] * weight[inner]).sum()
    clamped = np.zeros((2, 2))
    np.add.at(clamped, (label[inner - 1], label[inner]), weight[inner])
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    emission = np.bincount(features.ravel(), np.repeat((label - good) * weight, features.shape[1]), len(field.emission))
    return float(own - (log_total[first] * weight[first]).sum()), np.append(emission, (clamped - np.einsum("nij,n->ij", pairs, weight)).ravel())


def fit_field(doc: np.ndarray, measures: np.ndarray, label: np.ndarray, epochs: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood, each document weighing the same; label: of each line."""
    edges = np.quantile(measures, np.arange(1, BINS) / BINS, axis=0).T
    field = Field(edges, np.zeros(3 * MEASURES * (BINS + 1)), np.zeros((2, 2)), 0.5)
    features = field.bins(doc, measures)
    _, at, lines = np.unique(doc, return_inverse=True, return_counts=True)
    weight = 1 / lines[at] / len(lines)
    theta = np.zeros(len(field.emission) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for epoch in range(1, epochs + 1):
        field.emission, field.transition = theta[:-4], theta[-4:].reshape(2, 2)
        gradient = likelihood(field, doc, features, label, weight)[1] - decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-9)
    field.emission, field.transition = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def best_cut(mean: np.ndarray, good: np.ndarray) -> float:
    """The cut on mean that gets most documents right, each label weighing half; the middle of the best gap."""
    order = np.argsort(mean, kind="stable")
    x, y = mean[order], good[order].astype(bool)
    right = np.concatenate([[0], np.cumsum(~y)]) / max((~y).sum(), 1) + (y.sum() - np.concatenate([[0], np.cumsum(y)])) / max(y.sum(), 1)
    k = int(np.argmax(right))
    low, high = (x[k - 1] if k else 0.0), (x[k] if k < len(x) else 1.0)
    return float(np.clip((low + high) / 2, 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Fit on labelled rows outside the held-out fold; None where a label is missing there."""
    known = labels.filter("doc_id is not null and quality is not null").filter(common.fold(F.col("doc_id"), MODULUS) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = lambda q: known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most twice the sample of small rows, so they may be broadcast.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(pick(0).unionByName(pick(1))), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            quality, own = (c.to_pylist() for c in batch.columns)
            for a, b in lexer.by_bytes(own):
                doc, length, measures = line_measures(own[a:b])
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                out = [(quality[a + k], length[i:j].astype("<i4").tobytes(), measures[i:j].astype("<f4").tobytes()) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["quality", "lengths", "measures"])

    rows = texts.select(F.col("quality").cast("int"), "text").mapInArrow(measure, "quality int, lengths binary, measures binary").collect()
    if len({r[0] for r in rows}) < 2:
        return None
    sizes = [len(r[1]) // 4 for r in rows]
    doc = np.repeat(np.arange(len(rows)), sizes)
    quality = np.array([r[0] for r in rows])
    length = np.concatenate([np.frombuffer(r[1], "<i4") for r in rows])
    measures = np.concatenate([np.frombuffer(r[2], "<f4") for r in rows]).reshape(-1, MEASURES).astype(np.float64)
    field = fit_field(doc, measures, quality[doc])
    good = field.marginals(doc, field.bins(doc, measures))
    field.cut = best_cut(np.bincount(doc, length * good, len(rows)) / np.maximum(np.bincount(doc, length, len(rows)), 1), quality)
    return field


def score(docs: DataFrame, field: Field | None, name: str = "quality_score") -> DataFrame:
    """docs with a quality score for every row in a further column of that name."""
    schema, at = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]), docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = batch.column(at).to_pylist()
            if field is None:
                values = [np.array([float(bool((t or "").strip())) for t in texts])]
            else:
                values = [field.score(texts[a:b]) for a, b in lexer.by_bytes(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(values) if values else np.zeros(0))], [*batch.schema.names, name])

    return docs.mapInArrow(apply, schema)


def accepted(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of docs that score THRESHOLD or more; columns stay."""
    name = common.fresh(docs, "quality_score")
    return score(docs, field, name).filter(F.col(name) >= THRESHOLD).drop(name)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    out = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), train(docs, labels))
    return out.select("doc_id", (common.fold(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
