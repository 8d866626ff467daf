import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deeptime.llm import packing


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, 0], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, want):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        at, ids = 0, want[doc]
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    full = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0  # no padding anywhere
        full += at == 1024
    return full / len(by_sequence)


def test_pieces_against_the_other_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = packing.pack(docs, partitions=3).collect()
    assert check(rows, dict(zip(texts, reference_ids(texts.values())))) > 0.95


def test_edges(spark):
    data = [(1, None, 5), (2, "", 5), (None, "x", 5), (3, "word " * 5000, 5), (4, "<|endoftext|> é😀", 5), (5, "ab", 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, part int")
    rows = packing.pack(docs, partitions=2, with_ids=True)
    check(rows.collect(), {d: i for (d, _, _), i in zip(data, reference_ids([t for _, t, _ in data]))})
    whole = packing.sequences(rows).collect()
    assert sum(len(w.ids) for w in whole) == 4 * sum(map(len, reference_ids([t for _, t, _ in data])))
    assert packing.pack(docs.limit(0)).count() == 0
    again = spark.createDataFrame([(7, "same text")] * 50, "doc_id long, text string")
    assert packing.pack(again, partitions=4).agg({"length": "sum"}).first()[0] == 50 * len(reference_ids(["same text"])[0])


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    side = 1 << bits
    cells = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(side)] * dims)], axis=1)
    key = packing.hilbert(cells, bits)
    assert sorted(key) == list(range(side**dims))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_like_documents_are_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    order = packing.along_curve(docs.select("doc_id", "text"), 1).select("doc_id").collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    run = [lang[r.doc_id] for r in order]
    same = sum(a == b for a, b in zip(run, run[1:])) / (len(run) - 1)
    counts = np.unique(run, return_counts=True)[1] / len(run)
    assert same > (counts**2).sum() + 0.1


def test_the_curve_is_fitted_to_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    points = packing.projected(docs.select("text").toArrow().column("text").combine_chunks()).astype(float)
    for partitions in (1, 4):
        mean, deviation, bounds = packing.fit(docs, partitions)
        assert np.allclose(mean, points.mean(0)) and np.allclose(deviation, points.std(0))
        assert len(bounds) == partitions - 1
