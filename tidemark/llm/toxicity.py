"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, texts of the training folds the unlabelled set, and the share of
toxic rows among training labels is the class prior. Features are the presence of words and of their first
four and five bytes; those that positives have clearly more often than unlabelled texts are kept. A linear
model in numpy minimises ``prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))`` under the logistic loss:
where the corrected negative risk falls below zero its gradient is reversed, so that a flexible model cannot
profit from calling all positives' text negative. The score is the model's logistic output.

The fit sees at most POSITIVES toxic and UNLABELLED other texts, chosen by a hash of the id (of rows with one id, the
least text), and keeps at most FEATURES features, those that stand out by GAIN standard errors: the model's size, not
its data's. The class prior has half a case added to each label. Everything else covers all rows.

Null or empty texts have no features and score the model's floor. Without toxic training rows every score is 0. Null
labels count as not toxic; a label given twice counts as toxic if one is. Repeated rows and null ids are scored row by
row; an empty table gives no rows; extra columns are ignored, whatever their names.
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

POSITIVES, UNLABELLED, FEATURES, GAIN = 4000, 8000, 2048, 3
MODULUS, HELD_OUT = 3, 1
THRESHOLD = 0.7
_SIGNED = np.int64


def text_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of every word and prefix; repeated ones may occur."""
    w = lexer.words([(t or "").lower() for t in texts])
    w = w.only(w.kind == lexer.LETTER)
    parts, docs = [w.hashes], [w.doc]
    for n, salt in ((4, 4), (5, 5)):
        long = w.end - w.start >= n
        parts.append(lexer.mix(lexer.hash_spans(w.data, w.start[long], w.start[long] + n), salt))
        docs.append(w.doc[long])
    return np.concatenate(docs), np.concatenate(parts)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, feature number) of the kept features that each text has, once each."""
        doc, h = text_features(texts)
        n = len(self.features)
        if not n or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, h), n - 1)
        hit = self.features[at] == h
        pair = np.unique(doc[hit] * n + at[hit])
        return pair // n, pair % n

    def score(self, texts: list[str | None]) -> np.ndarray:
        doc, feature = self.rows(texts)
        z = self.bias + np.bincount(doc, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nnpu_step(theta: np.ndarray, doc: np.ndarray, feature: np.ndarray, positive: np.ndarray, prior: float, decay: float) -> tuple[float, float, np.ndarray]:
    """(risk of positives called positive, corrected risk of negatives, direction to descend along) at theta, whose last entry is the bias.

    Where the corrected risk is not negative the direction is the gradient of both risks and the decay; else it is that
    of minus the corrected risk, and of the decay.
    """
    share = np.where(positive, 1 / positive.sum(), 1 / max((~positive).sum(), 1))
    z = theta[-1] + np.bincount(doc, theta[feature], len(positive))
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    as_negative = np.logaddexp(0, z) * share  # loss with target -1
    called = prior * (np.logaddexp(0, -z) * share)[positive].sum()
    corrected = as_negative[~positive].sum() - prior * as_negative[positive].sum()
    # d loss(+) / dz = p - 1, d loss(-) / dz = p
    back = np.where(positive, -prior * p, p) * share
    step = np.where(positive, prior * (p - 1) * share, 0) + back if corrected >= 0 else -back
    return called, corrected, np.append(np.bincount(feature, step[doc], len(theta) - 1) + decay * theta[:-1] * prior, step.sum())


def fit_nnpu(doc: np.ndarray, feature: np.ndarray, positive: np.ndarray, n_features: int, prior: float, epochs: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias. (doc, feature): the ones of the design matrix; positive: whether each doc is a confirmed positive."""
    theta, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for epoch in range(1, epochs + 1):
        _, _, direction = nnpu_step(theta, doc, feature, positive, prior, decay)
        m, v = 0.9 * m + 0.1 * direction, 0.999 * v + 0.001 * direction**2
        theta -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-9)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    """Fit on rows outside the held-out fold."""
    learn = lambda df: df.filter(common.fold(F.col("doc_id"), MODULUS) != HELD_OUT)
    known = learn(labels.filter("doc_id is not null")).groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    totals = known.agg(F.count("*"), F.sum("toxic")).head()
    if not totals[1]:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    prior = (totals[1] + 0.5) / (totals[0] + 1)
    order = F.xxhash64(F.col("doc_id"))
    pos = known.filter("toxic = 1").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(True).alias("positive"))
    unl = learn(docs.select("doc_id").filter("doc_id is not null")).orderBy(order, "doc_id").limit(unlabelled).select("doc_id", F.lit(False).alias("positive"))
    # At most positives + unlabelled small rows, so they may be broadcast.
    sample = F.broadcast(pos.unionByName(unl))
    texts = common.written(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select("positive", "text"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            flags, own = (c.to_pylist() for c in batch.columns)
            for a, b in lexer.by_bytes(own):
                doc, h = text_features(own[a:b])
                key, at = np.unique(h, return_inverse=True)
                once = np.unique(at.astype(np.int64) * (b - a) + doc)
                f, d = once // (b - a), once % (b - a)
                positive = np.array(flags[a:b], bool)[d]
                n, p = np.bincount(f, minlength=len(key)), np.bincount(f, positive, len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(_SIGNED)), pa.array(p), pa.array((n - p).astype(np.int64))], ["h", "p", "u"])

    sizes = texts.agg(F.sum(F.col("positive").cast("int")), F.sum((~F.col("positive")).cast("int"))).head()
    n_pos, n_unl = sizes[0] or 0, sizes[1] or 0
    if not n_pos:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    counts = texts.mapInArrow(count, "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter("p >= 2")
    base = (F.col("u") + 0.5) / (n_unl + 1)
    gain = (F.col("p") / n_pos - base) / F.sqrt(base * (1 - base) / n_pos)
    chosen = [r[0] for r in counts.select("h", gain.alias("gain")).filter(F.col("gain") > GAIN).orderBy(F.desc("gain"), "h").limit(features).collect()]
    model = Model(np.sort(np.array(chosen, np.int64).view(np.uint64)), np.zeros(len(chosen)), -40.0)

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            flags, own = (c.to_pylist() for c in batch.columns)
            for a, b in lexer.by_bytes(own):
                doc, feature = model.rows(own[a:b])
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([pa.array(flags[a:b]), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature, pa.int32()))], ["positive", "features"])

    rows = texts.mapInArrow(design, "positive boolean, features array<int>").collect()
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    feature = np.array([f for r in rows for f in r[1]], np.int64)
    weights, bias = fit_nnpu(doc, feature, np.array([r[0] for r in rows]), len(chosen), prior)
    common.drop_written(docs.sparkSession, texts)
    return Model(model.features, weights, bias)


def score(docs: DataFrame, model: Model, name: str = "toxicity_score") -> DataFrame:
    """docs with a toxicity score for every row in a further column of that name."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = batch.column(at).to_pylist()
            values = [model.score(texts[a:b]) for a, b in lexer.by_bytes(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(values) if values else np.zeros(0))], [*batch.schema.names, name])

    at = docs.columns.index("text")
    return docs.mapInArrow(apply, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below THRESHOLD; columns stay."""
    name = common.fresh(docs, "toxicity_score")
    return score(docs, model, name).filter(F.col(name) < THRESHOLD).drop(name)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    out = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), train(docs, labels))
    return out.select("doc_id", (common.fold(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))
