"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is fitted from
confirmed toxic documents and unlabelled text; of all words those enter that
the confirmed documents have significantly more often than unlabelled ones. With the class prior ``pi`` (the toxic share of the
labelled training rows), the risk is ``pi R_p+ + max(0, R_u- - pi R_p-)``: the
unlabelled documents count as negative, corrected for the positives among them,
and where the corrected part falls below zero a step in the other direction
undoes the overfit. Features are chosen by document counts over all confirmed
and all unlabelled training rows; gradients are taken in numpy over samples of
``POSITIVES`` and ``UNLABELLED`` documents at most, the one bound here.

Defined cases: null, empty and wordless texts get the score of no word; with
no confirmed toxic row the score is the prior everywhere; several labels of one
id count as toxic if one is; rows that repeat an id are scored each; an empty
table gives an empty result; a long text is expanded whole (some 20 bytes for
each of its own); a null id counts as an empty text in the split;
labels, ``lang``, ``source`` and ids never enter a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deeptime.llm.common import broadcast_if_small, held_out, id_text, stored
from deeptime.llm.text_arrays import byte_view, filled, slices, word_hashes

POSITIVES, UNLABELLED = 4000, 12000
SAMPLE_PARTS = 12
#: Hashes or ids up to this number (8 MB of longs) are broadcast.
BROADCAST_FEATURES = 1_000_000
STEPS, RATE, DECAY = 200, 0.1, 1e-4
#: A feature is kept if this many confirmed documents have it and the excess over unlabelled text has this many standard errors.
LEAST_SEEN, LEAST_Z = 4, 4.0
#: First letters of a word that are a feature of their own, for inflected forms.
STEM_BYTES = 5


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


def features(column: pa.Array):
    """``(first row, rows, documents, hashes)``: each text's distinct features, slice by slice."""
    column = filled(column)
    data, offsets = byte_view(column)
    for a, b in slices(offsets):
        doc, h, stem = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], STEM_BYTES)
        yield a, b - a, np.concatenate((doc, doc)), np.concatenate((h, stem ^ np.uint64(0x5851F42D4C957F2D)))


def _distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))[: len(doc)]
    return doc[new], value[new]


def _known(hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``h`` are among the sorted ``hashes``, and where."""
    if not len(hashes):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return hashes[at] == h, at


def feature_rows(docs: DataFrame) -> DataFrame:
    """``h``: each document's distinct features."""

    def run(batches):
        for batch in batches:
            for _, _, doc, h in features(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_distinct(doc, h)[1].view(np.int64))], ["h"])

    return docs.select("text").mapInArrow(run, "h long")


def select_features(positive: DataFrame, n_positive: int, unlabelled: DataFrame, n_unlabelled: int) -> np.ndarray:
    """Sorted hashes of the features that confirmed documents have significantly more often.

    Counted by Spark over all rows of both; only the selected hashes reach the
    driver. They are words, so their number grows like a vocabulary.
    """
    seen = feature_rows(positive).groupBy("h").agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") >= LEAST_SEEN)
    seen = stored(seen, "toxic-features")
    known = feature_rows(unlabelled).join(broadcast_if_small(seen.select("h"), BROADCAST_FEATURES), "h", "left_semi")
    counts = seen.join(known.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h", "left")
    share = (F.coalesce("n", F.lit(0)) + 1) / (n_unlabelled + 2)
    z = (F.col("seen") / n_positive - share) / F.sqrt(share * (1 - share) / n_positive)
    return np.sort(counts.filter(z >= LEAST_Z).select("h").toArrow().column("h").to_numpy().view(np.uint64))


def sample_features(docs: DataFrame, hashes: np.ndarray) -> list[np.ndarray]:
    """For each document of a bounded sample, the positions of its features in ``hashes``."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, n, doc, h in features(batch.column(0)):
                known, at = _known(hashes, h)
                doc, at = _distinct(doc[known], at[known])
                cut = np.searchsorted(doc, np.arange(n + 1))
                rows += [at[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["at"])

    return [np.frombuffer(r.at, np.int32) for r in docs.select("text").mapInArrow(run, "at binary").collect()]


class _Rows:
    """Sparse rows of ones over the selected features."""

    def __init__(self, rows):
        self.n = len(rows)
        self.at = np.concatenate(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def scores(self, w):
        return np.bincount(self.row, w[self.at], self.n)

    def pull(self, g, dim):
        return np.bincount(self.at, g[self.row], dim)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, hashes: np.ndarray, steps: int = STEPS) -> Model:
    """Minimise the non-negative risk with the logistic loss, by Adam over the samples."""
    p, u, dim = _Rows(positive), _Rows(unlabelled), len(hashes)
    w, b = np.zeros(dim), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(dim + 1), np.zeros(dim + 1)
    for t in range(1, steps + 1):
        sp, su = p.scores(w) + b, u.scores(w) + b
        # derivatives of log(1 + e^-s) for positives and of log(1 + e^s) for negatives
        up = -_sigmoid(-sp) * prior / p.n
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        dp, du = -_sigmoid(sp) * prior / p.n, _sigmoid(su) / u.n
        if negative < 0:  # the corrected negative risk can't be below zero: step back
            gp, gu = -dp, -du
        else:
            gp, gu = up + dp, du
        g = np.append(p.pull(gp, dim) + u.pull(gu, dim) + DECAY * w, gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(hashes, w, b)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from the training part of ``labels`` and the training part's texts."""
    known = stored(labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    count = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    prior = min(0.95, max(0.001, count.t / count.n)) if count.n else 0.001
    flat = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not count.t:
        return flat
    part = docs.filter(~held_out()).select("doc_id", "text")
    ids = stored(known.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("__toxic")), "toxic-ids")
    toxic = stored(part.join(broadcast_if_small(ids, BROADCAST_FEATURES), F.col("doc_id").eqNullSafe(F.col("__toxic")), "left_semi"), "toxic-texts")
    n_toxic, n = toxic.count(), part.count()
    if not n_toxic or not n:
        return flat
    hashes = select_features(toxic, n_toxic, part, n)
    samples = (drawn(toxic, n_toxic, positives), drawn(part, n, unlabelled))
    return fit_nnpu(*(sample_features(rows, hashes) for rows in samples), prior, hashes)


def drawn(docs: DataFrame, n: int, most: int) -> DataFrame:
    """``most`` of the ``n`` documents at most (stored), by the hash of id and text, so that nothing but the rows decides."""
    h = F.xxhash64(id_text(), F.coalesce("text", F.lit("")))
    share = int(min(1.0, 1.1 * most / max(1, n)) * (1 << 30))
    near = docs.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 30)) < share)
    return stored(near.orderBy(F.pmod("h", F.lit(1 << 30)), "h", "doc_id", "text").limit(most).repartition(SAMPLE_PARTS), "toxicity-sample")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    hashes, weights, bias = model.hashes, model.weights, model.bias

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, n, doc, h in features(batch.column(2)):
                known, at = _known(hashes, h)
                doc, at = _distinct(doc[known], at[known])
                out[first : first + n] = _sigmoid(np.bincount(doc, weights[at], n) + bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
