"""Packing documents into token sequences along a space-filling curve.

Each document becomes a hashed vector of its byte trigrams, is projected to
``DIMS`` dimensions and placed on a Hilbert curve, so that documents of like
content are neighbours. Documents are range-partitioned by their place (ties are
broken by a hash of the id, so a place that very many share can be split),
sorted, tokenised and laid end to end into sequences of ``length`` tokens, cut
wherever a sequence is full. What is left at the end of a partition goes into
sequences whose lengths are powers of two, so nothing is padded.

The projection's scale comes from all documents, and so do the partitions' bounds,
as approximate percentiles of all places; every document is placed and packed whole.

Defined cases: a null or empty text is its closing token alone; rows that
repeat an id are packed each; a null id is packed under null; a text longer than
a sequence spans several; a special string of the vocabulary inside a text is its
one token, as the library has it; an empty table gives an empty result; columns beyond
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deeptime.llm.common import id_text, stored
from deeptime.llm.text_arrays import byte_view, filled, slices

LENGTH = 1024
#: Fixed value of the vocabulary: its added token.
SPECIAL = {"<|endoftext|>": 50256}
#: The id that closes each document.
CLOSE = 0
DIMS, BITS, BUCKETS = 4, 10, 256
TIE_BITS = 63 - DIMS * BITS
SEQUENCES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projected(column: pa.Array) -> np.ndarray:
    """Each text's hashed trigram vector, projected to ``DIMS`` dimensions."""
    column = filled(column)
    data, offsets = byte_view(column)
    matrix = np.random.default_rng(20).standard_normal((BUCKETS, DIMS)).astype(np.float32)
    out = np.zeros((len(column), DIMS), np.float32)
    for a, b in slices(offsets):
        own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(own) < 3:
            continue
        x = own.astype(np.uint32)
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
        h = (h * np.uint32(0x27D4EB2F)) >> np.uint32(24)
        doc = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(at))[:-2]
        counts = np.bincount(doc * BUCKETS + h, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
        v = np.sqrt(counts, dtype=np.float32)
        out[a:b] = (v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1)) @ matrix
    return out


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points ``(n, dims)`` with ``bits`` bits each.

    After J. Skilling, "Programming the Hilbert curve" (2004).
    """
    x = [points[:, i].astype(np.int64).copy() for i in range(points.shape[1])]
    for s in range(bits - 1, 0, -1):
        low = (1 << s) - 1
        for i in range(len(x)):
            up = (x[i] >> s & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(len(points), np.int64)
    for s in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> s & 1, (1 << s) - 1, 0)
    key = np.zeros(len(points), np.int64)
    for s in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v ^ turn) >> s & 1
    return key


def places(points: np.ndarray, mean: np.ndarray, deviation: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Sortable places: the Hilbert key, then the tie breaker."""
    unit = 0.5 * (1 + np.tanh(0.8 * (points - mean) / deviation))  # close to the normal distribution function
    return hilbert(np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)) << TIE_BITS | tie


def fit(docs: DataFrame, partitions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of the projection, and the places that bound the partitions, from all documents."""

    def run(batches):
        for batch in batches:
            p = projected(batch.column(0)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(pa.array(p[:, k]) for k in range(DIMS)), batch.column(1)], [*(f"p{k}" for k in range(DIMS)), "tie"])

    axes = [f"p{k}" for k in range(DIMS)]
    points = stored(docs.select("text", _tie().alias("tie")).mapInArrow(run, ", ".join(f"{a} double" for a in axes) + ", tie long"), "curve-points")
    row = points.agg(*(F.avg(a).alias(f"m_{a}") for a in axes), *(F.stddev_pop(a).alias(f"s_{a}") for a in axes)).first()
    mean = np.array([row[f"m_{a}"] or 0.0 for a in axes])
    deviation = np.array([max(row[f"s_{a}"] or 0.0, 1e-9) for a in axes])

    def key(batches):
        for batch in batches:
            p = np.stack([batch.column(k).to_numpy() for k in range(DIMS)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(places(p, mean, deviation, batch.column(DIMS).to_numpy()))], ["place"])

    cuts = [k / partitions for k in range(1, partitions)]
    bounds = points.mapInArrow(key, "place long").agg(F.percentile_approx("place", cuts, 20 * partitions).alias("b")).first().b if cuts else []
    return mean, deviation, np.array(bounds or [], np.int64)


def _tie():
    return F.xxhash64(id_text(), F.lit(1)).bitwiseAND(F.lit((1 << TIE_BITS) - 1))


def along_curve(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``part, place, doc_id, text``: documents sorted along the curve within range partitions."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    mean, deviation, bounds = fit(rows, n)

    def run(batches):
        for batch in batches:
            place = places(projected(batch.column(1)), mean, deviation, batch.column(2).to_numpy())
            part = np.searchsorted(bounds, place, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(place), batch.column(0), batch.column(1)], ["part", "place", "doc_id", "text"])

    placed = rows.withColumn("tie", _tie()).mapInArrow(run, "part int, place long, doc_id long, text string")
    return placed.repartitionById(n, F.col("part")).sortWithinPartitions("place", "doc_id", "text")


def tokenizer():
    """The ids of ``byte_bpe_50k.json``, by the ranks of the same vocabulary; its special string is one token."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode(text: str):
        return encoding.encode(text, allowed_special="all") if any(s in text for s in SPECIAL) else encoding.encode_ordinary(text)

    return encode


def powers(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class _Packer:
    """Lays pieces ``(doc_id, start, ids, doc_tokens)`` end to end."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence, self.used, self.open, self.rows = length, first_sequence, 0, [], []

    def add(self, doc_id, ids: np.ndarray):
        start = 0
        while start < len(ids):
            piece = ids[start : start + self.length - self.used]
            self.open.append((doc_id, start, piece, len(ids)))
            self.used += len(piece)
            start += len(piece)
            if self.used == self.length:
                self._close(self.open)
                self.open, self.used = [], 0

    def _close(self, pieces):
        offset = 0
        for doc_id, start, piece, total in pieces:
            self.rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), total, self.sequence, offset, piece))
            offset += len(piece)
        self.sequence += 1

    def finish(self):
        pieces, self.open = self.open[::-1], []
        for size in powers(self.used):
            taken = []
            while size:
                doc_id, start, piece, total = pieces.pop()
                if len(piece) > size:
                    pieces.append((doc_id, start + size, piece[size:], total))
                    piece = piece[:size]
                taken.append((doc_id, start, piece, total))
                size -= len(piece)
            self._close(taken)
        self.used = 0


def pack(docs: DataFrame, length: int = LENGTH, encode=tokenizer, partitions: int | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document; ``with_ids`` adds the piece's ids as little-endian unsigned 32-bit integers.

    ``encode`` is called in each task and returns a function from a text to ids.
    """
    schema = SEQUENCES_SCHEMA + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def batch_of(rows):
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
        if with_ids:
            columns.append(pa.array([r[7].tobytes() for r in rows], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        tokens, packer, last = encode(), None, (None, None)
        for batch in batches:
            parts, ids_of = batch.column(0), batch.column(1).to_pylist()
            for k, text in enumerate(batch.column(2)):
                if packer is None:
                    packer = _Packer(length, parts[k].as_py() << 32)
                text = text.as_py()
                if text != last[0]:  # copies are neighbours on the curve
                    last = (text, np.append(np.array(tokens(text), "<u4"), np.uint32(CLOSE)).astype("<u4"))
                packer.add(ids_of[k], last[1])
                if len(packer.rows) >= 4096:
                    yield batch_of(packer.rows)
                    packer.rows = []
        if packer is not None:
            packer.finish()
            yield batch_of(packer.rows)

    return along_curve(docs, partitions).select("part", "doc_id", "text").mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids`` of whole sequences from pieces with ids."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return whole.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
