"""Language identification: sparse multinomial logistic regression on TF-IDF.

Features are hashed character n-grams of one to three code points of the
lower-cased whole text, weighted by their share of the text and by the inverse
document frequency over all training documents. The weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a sample of
``PER_LANGUAGE`` training documents a language, the one bound here: at most that many times
the number of languages in all, of which one language may have a tenth more than its part (the
languages' names and counts are collected; they are few by nature). A temperature is then fitted on a part of the sample that the fit has not
seen. As features are linear in the counts, a prediction is a table lookup and a
sum for each position, never a vector for each document.

Defined cases: a null text or one without a letter (Unicode category L) is ``und`` with score 0; with
no labelled document everything is ``und``; with one language it is always that;
a very long text is expanded whole in one task, some tens of bytes for each of its bytes;
ties go to the language that sorts first; rows that repeat an id are predicted
each; an empty table gives an empty result; a null id counts as an empty text
in the split; ``lang``, ``source`` and ids never enter a prediction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deeptime.llm.common import held_out, id_text
from deeptime.llm.text_arrays import byte_view, filled, slices

DIM_BITS = 15
ORDERS = 3
PER_LANGUAGE = 800
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.02
#: Features of a text add up to this, so that steps are of a useful size.
SCALE = 60.0
#: Share of the sample that only the temperature sees.
CALIBRATION = 0.2
UNDETERMINED = "und"
_WORD_CHARACTER = re.compile(r"[^\W\d_]")
_MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L; other numerals (as in fractions) are none."""
    return any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(text))


def ngrams(texts: list[str]):
    """For each order, ``(starts, buckets)``: the texts' first positions and a bucket for each position.

    Positions whose n-gram would cross into another text get the bucket one past the last.
    """
    joined = "".join(f"\0 {t.lower()} " for t in (x.replace("\0", " ") for x in texts)) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    edge = cp == 0
    starts = np.flatnonzero(edge)[:-1]
    bad, h = edge.copy(), np.zeros(len(cp), np.uint32)
    for k in range(ORDERS):
        if k:
            bad[:-k] |= edge[k:]
            bad[-k:] = True
            h[:-k] = (h[:-k] << np.uint32(13) | h[:-k] >> np.uint32(19)) ^ (cp[k:] * np.uint32(_MIX[k]))
        else:
            h ^= cp * np.uint32(_MIX[0])
        b = (((h ^ np.uint32(k * 0x27D4EB2F)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM_BITS)).astype(np.int32)
        b[bad] = 1 << DIM_BITS
        yield starts, b


def _text_slices(column: pa.Array):
    column = filled(column)
    _, offsets = byte_view(column)
    for a, b in slices(offsets):
        for k in range(a, b, 64):
            yield k, column.slice(k, min(b, k + 64) - k).to_pylist()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each bucket, over all of ``docs``, and their number."""

    def run(batches):
        df, n = np.zeros(1 << DIM_BITS, np.int64), 0
        for batch in batches:
            for _, texts in _text_slices(batch.column(0)):
                seen = np.zeros((len(texts), (1 << DIM_BITS) + 1), np.uint8)
                for starts, b in ngrams(texts):
                    seen[np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(b)))), b[starts[0] :]] = 1
                df += np.add.reduce(seen[:, :-1], axis=0, dtype=np.uint16)
                n += len(texts)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], n))], ["bucket", "df"])

    rows = docs.select("text").mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(1 << DIM_BITS, np.int64), 0
    for r in rows:  # as many rows as there are buckets, at most
        if r.bucket < 0:
            n = r.df
        else:
            df[r.bucket] = r.df
    return df, n


def sample_features(docs: DataFrame, counts: dict[str, int], per_language: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """``(lang, buckets, counts)`` of a bounded sample, chosen by the ids' hashes."""

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                all_b = np.concatenate([b for _, b in ngrams([text or ""])])
                bucket, n = np.unique(all_b[all_b < 1 << DIM_BITS], return_counts=True)
                for o, v in zip(out, (lang, bucket.astype(np.int32).tobytes(), n.astype(np.int32).tobytes())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["lang", "b", "n"])

    h = F.xxhash64(id_text(), F.coalesce("text", F.lit("")))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.1 * per_language / n)).otherwise(share)
    near = docs.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    chosen = near.orderBy("h", "lang", "doc_id", "text").limit(per_language * len(counts))
    rows = chosen.select("lang", "text").mapInArrow(run, "lang string, b binary, n binary").collect()
    return [(r.lang, np.frombuffer(r.b, np.int32), np.frombuffer(r.n, np.int32)) for r in rows]


def fit_ftrl(rows, languages: list[str], idf: np.ndarray) -> Model:
    """Follow-the-regularised-leader, one example at a time, then the temperature."""
    number, k = {lang: i for i, lang in enumerate(languages)}, len(languages)
    examples = []
    for lang, b, n in rows:
        x = idf[b] * n
        if x.sum() > 0:
            examples.append((number[lang], b, SCALE * x / x.sum()))
    order = np.random.default_rng(7).permutation(len(examples))
    cut = int(len(order) * CALIBRATION) if len(order) >= 50 else 0
    z, g2 = np.zeros((len(idf) + 1, k)), np.zeros((len(idf) + 1, k))

    def weights(z, g2):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(g2)) / ALPHA + L2))

    def softmax(s):
        e = np.exp(s - s.max())
        return e / e.sum()

    for _ in range(EPOCHS):
        for i in order[cut:]:
            y, b, x = examples[i]
            at, val = np.append(b, len(idf)), np.append(x, 1.0)
            w = weights(z[at], g2[at])
            p = softmax(val @ w)
            p[y] -= 1
            g = val[:, None] * p
            new = g2[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(g2[at])) / ALPHA * w
            g2[at] = new
    w = weights(z, g2)
    model = Model(languages, idf, w[:-1], w[-1])
    if cut:
        logits = np.array([examples[i][2] @ w[examples[i][1]] + w[-1] for i in order[:cut]])
        truth = np.array([examples[i][0] for i in order[:cut]])

        def loss(t):
            s = logits / t
            return (np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(s)), truth]).mean()

        model.temperature = float(min(np.geomspace(0.2, 8, 60), key=loss))
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from the text and language of ``docs``' training part; None without labels."""
    part = docs.filter(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in part.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    df, n = document_frequencies(part)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    return fit_ftrl(sample_features(part, counts, per_language), sorted(counts), idf)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs``' columns with ``lang_pred`` and ``score`` (the calibrated probability)."""
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    k = len(model.languages)
    table = np.zeros(((1 << DIM_BITS) + 1, k + 1), np.float32)
    table[:-1, :k] = model.weights * model.idf[:, None] * SCALE
    table[:-1, k] = model.idf
    bias, temperature, names = model.bias, model.temperature, model.languages
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            lang, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            for first, texts in _text_slices(batch.column(at)):
                sums = np.zeros((len(texts), k + 1))
                for starts, b in ngrams(texts):
                    for c in range(k + 1):
                        sums[:, c] += np.add.reduceat(table[:, c][b], starts, dtype=np.float64)
                s = (sums[:, :k] / np.maximum(sums[:, k:], 1e-9) + bias) / temperature
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                for i, t in enumerate(texts):
                    if has_letter(t):
                        lang[first + i], score[first + i] = names[best[i]], p[i, best[i]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` whose language is determined with ``min_score`` at least; columns unchanged."""
    names = docs.columns
    inner = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col("text").alias("text"))
    found = predict(inner, train(docs))
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")
