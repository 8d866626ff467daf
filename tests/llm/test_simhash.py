import itertools

import numpy as np
import pytest
import xxhash

from deeptime.llm import simhash
from deeptime.llm.components import components


def brute(texts, width=3, radius=3):
    fps = []
    for t in texts:
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return fps, [find(i) for i in range(len(fps))]


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    texts = docs.text.tolist() + [None, "", "  ", "one", "One", "two words", "a b c", "A b  C"]
    fps, root = brute(texts)
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int").repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(frame).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in range(len(texts))}


@pytest.mark.parametrize("n,flips", [(40, 2), (400, 4), (1500, 6)])
def test_tree_finds_every_pair(n, flips):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, n // 20 + 1, dtype=np.uint64)
    fps = base[rng.integers(0, len(base), n)]
    for _ in range(flips):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if int(fps[i] ^ fps[j]).bit_count() <= 3}
    got = {tuple(sorted((int(i), int(j)))) for a, b in simhash.tree_pairs(fps) for i, j in zip(a, b)}
    assert got == want


def test_shards_hold_every_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
    rows = [(int(x),) for x in np.concatenate((base, near)).view(np.int64)]
    found = simhash.shards(spark.createDataFrame(rows, "fp long")).collect()
    where: dict[int, set] = {}
    for r in found:
        where.setdefault(r.fp, set()).add((r.forest, r.cell, r.shell))
    for a, b in zip(base.view(np.int64), near.view(np.int64)):
        assert where[int(a)] & where[int(b)]


def test_empty_table_and_null_ids(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = simhash.near_groups(spark.createDataFrame([(None, "x y z"), (3, "x y z"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("3", "3"), ("None", "3"), ("None", "None")]


@pytest.mark.parametrize(("bits", "n", "most"), [(38, 400, 100), (20, 1500, 30)])
def test_large_shards_are_dealt_again_without_loss(spark, bits, n, most):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << bits, n, dtype=np.uint64)  # the upper blocks agree in all
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    rows = [(int(x),) for x in np.unique(np.concatenate((base, near))).view(np.int64)]
    frame = spark.createDataFrame(rows, "fp long")
    dealt = simhash.dealt_again(simhash.shards(frame), most=most)
    assert dealt.groupBy("forest", "cell", "shell").count().agg({"count": "max"}).first()[0] <= most
    assert dealt.agg({"forest": "max"}).first()[0] >= (1_001_000 if bits == 20 else 1000)  # dealt three times, or twice
    where: dict[int, set] = {}
    for r in dealt.collect():
        where.setdefault(r.fp, set()).add((r.forest, r.cell, r.shell))
    for a, b in zip(base.view(np.int64), near.view(np.int64)):
        assert where[int(a)] & where[int(b)]
    joined = [{tuple(r) for r in components(simhash.links(frame, most=m)).collect()} for m in (most, simhash.MOST)]
    assert joined[0] == joined[1] and len(joined[0]) >= n * 0.9
