"""SimHash near-duplicates: exact pairs within a Hamming radius by vantage-point trees.

Fingerprints that are equal are first merged into one class. Classes are dealt
to shards by their Hamming distances: with ``radius`` 3 and ``blocks`` 5, two
fingerprints within the radius agree on at least two of the five blocks, so for
each choice of two blocks a shard holds the fingerprints at distance zero from
each other there, cut into shells by the distance of the remaining bits from a
vantage point. A fingerprint near a shell's upper edge is also placed in the
next shell, so no pair is lost at a boundary. A shard of more than ``MOST``
fingerprints is dealt again by the same rule on its remaining bits, and again
until none is larger: after three dealings some 14 bits are left, and a shard can't hold
more than 2**14 fingerprints.

Inside a shard a vantage-point tree splits at the median distance, prunes by
the triangle bound and visits the two boundary strips for pairs across; parts of
``LEAF`` fingerprints or fewer are compared directly. Most shards of a table of
some hundred thousand documents are that small and never split; the tree works in
shards of texts that are alike, and in larger tables. A vantage-point tree over
all 64 bits can't take the place of the blocks: distances of unrelated
fingerprints gather at 32 +- 4, so each split at the median would copy three
tenths of the rows.

Each shard gives every fingerprint one edge to a representative that it is
connected with, never all pairs of a group; components then join the shards.

Defined cases: null and blank texts have fingerprint zero, linked like any
other; fewer words than the shingle width make one shingle; repeated rows and
ids share their class; an empty table gives an empty result; columns beyond
``doc_id`` and ``text`` are not read; a null id is never a component's id unless
no other is there.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deeptime.llm.common import broadcast_if_small, stored
from deeptime.llm.components import components

SEED = 42
SHELL = 8
LEAF = 48
#: Fingerprints of a shard (2 MB) up to which it is not dealt again.
MOST = 1 << 16
#: Large shards up to which their keys are broadcast.
BROADCAST_SHARDS = 100_000
#: A fixed vantage point: the fractional bits of the golden ratio.
VANTAGE = 0x9E3779B97F4A7C15


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text's word shingles, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        starts = [0] + [e + 1 for e in ends[:-width]]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        part = np.array(hashes[k : k + 8192], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every document."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = np.array([fingerprint(x.as_py() or b"", width) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(radius: int = 3, blocks: int = 5, within: int = (1 << 64) - 1) -> list[int]:
    """One mask for each choice of ``blocks - radius`` blocks of the bits in ``within``."""
    bits = [k for k in range(64) if within >> k & 1]
    block = [sum(1 << k for k in bits[len(bits) * b // blocks : len(bits) * (b + 1) // blocks]) for b in range(blocks)]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def shards(fps: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``(forest, mask, cell, shell, fp)``: each fingerprint's shards, whose members agree on ``mask``; two within the radius share one at least."""
    fp = F.col("fp")
    places = []
    for k, mask in enumerate(block_masks(radius, blocks)):
        rest = ~mask & ((1 << 64) - 1)
        d = F.bit_count(fp.bitwiseXOR(F.lit(_signed(VANTAGE))).bitwiseAND(F.lit(_signed(rest))))
        places.append(F.struct(F.lit(k).cast("long").alias("forest"), F.lit(_signed(mask)).alias("mask"), fp.bitwiseAND(F.lit(_signed(mask))).alias("cell"), d.alias("d")))
    spread = fps.select("fp", F.explode(F.array(*places)).alias("p")).select("fp", "p.*")
    home: Column = F.floor(F.col("d") / SHELL).cast("int")
    shells = F.when(F.col("d") % SHELL >= SHELL - radius, F.array(home, home + 1)).otherwise(F.array(home))
    return spread.select("forest", "mask", "cell", F.explode(shells).alias("shell"), "fp")


def dealt_again(dealt: DataFrame, radius: int = 3, blocks: int = 5, most: int = MOST) -> DataFrame:
    """``dealt`` shards with those of more than ``most`` fingerprints cut by blocks of their remaining bits, until none is larger."""
    spark, key, masks, done = dealt.sparkSession, ["forest", "cell", "shell"], block_masks(radius, blocks), None
    while True:
        large = stored(dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).drop("n"), "large-shards")
        large_ones = broadcast_if_small(large, BROADCAST_SHARDS)
        within = dealt.join(large_ones, key, "left_anti")
        done = within if done is None else done.unionByName(within)
        if large.isEmpty():
            return done
        # ten masks for each mask before: a thousand at the third dealing
        finer = {m: [_signed(m | f) for f in block_masks(radius, blocks, ~m & ((1 << 64) - 1))] for m in masks}
        table = spark.createDataFrame([(_signed(m), f) for m, f in finer.items()], "mask long, finer array<long>")
        again = dealt.join(large_ones, key, "left_semi").join(F.broadcast(table), "mask").select("forest", "shell", "fp", F.posexplode("finer").alias("j", "mask"))
        again = again.select(((F.col("forest") + 1) * 1000 + F.col("j")).alias("forest"), "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("cell"), "shell", "fp")
        dealt, masks = stored(again, "dealt-again"), list({f & ((1 << 64) - 1) for fs in finer.values() for f in fs})


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` items is connected with through the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _near(fps, a, b, radius, same):
    """Index pairs within the radius, by comparing blocks of ``a`` with ``b``."""
    for k in range(0, len(a), 1024):
        part = a[k : k + 1024]
        hit = np.bitwise_count(fps[part][:, None] ^ fps[b][None, :]) <= radius
        if same:
            hit &= part[:, None] < b[None, :]
        i, j = np.nonzero(hit)
        yield part[i], b[j]


def tree_pairs(fps: np.ndarray, radius: int = 3):
    """Every pair within the radius (some more than once), found by a vantage-point tree."""
    work: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(fps)), None)]
    while work:
        a, b = work.pop()
        if not len(a) or b is not None and not len(b):
            continue
        if len(a) * len(a if b is None else b) <= LEAF * LEAF:
            yield from _near(fps, a, a if b is None else b, radius, b is None)
            continue
        v = fps[a[0]]
        da = np.bitwise_count(fps[a] ^ v).astype(np.int16)
        db = da if b is None else np.bitwise_count(fps[b] ^ v).astype(np.int16)
        both = da if b is None else np.concatenate((da, db))
        m = int(np.median(both))
        if m >= both.max():
            m = int(both.max()) - 1
        if m < both.min():  # all at one distance: nothing to prune
            yield from _near(fps, a, a if b is None else b, radius, b is None)
            continue
        inner, outer = (da <= m), (da > m)
        rim, strip = (da <= m) & (da > m - radius), (da > m) & (da <= m + radius)
        if b is None:
            work += [(a[inner], None), (a[outer], None), (a[rim], a[strip])]
            continue
        parts = [(a[inner], b[db <= m]), (a[outer], b[db > m]), (a[rim], b[(db > m) & (db <= m + radius)]), (a[strip], b[(db <= m) & (db > m - radius)])]
        if sum(len(x) * len(y) for x, y in parts) >= 0.9 * len(a) * len(b):
            yield from _near(fps, a, b, radius, False)
        else:
            work += parts


def shard_links(fps: np.ndarray, cut: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For shards laid end to end (``cut``: their bounds), an edge from each linked item to its root."""
    sizes = np.diff(cut)
    shard = np.repeat(np.arange(len(sizes)), sizes)
    small = np.repeat(sizes <= LEAF, sizes)
    left, right = [], []
    rest = np.flatnonzero(small)
    for k in range(1, LEAF):
        rest = rest[rest + k < len(fps)]
        rest = rest[shard[rest] == shard[rest + k]]
        if not len(rest):
            break
        hit = rest[np.bitwise_count(fps[rest] ^ fps[rest + k]) <= radius]
        left.append(hit)
        right.append(hit + k)
    for s in np.flatnonzero(sizes > LEAF):
        held, pairs = 0, []
        for a, b in tree_pairs(fps[cut[s] : cut[s + 1]], radius):
            pairs.append((a, b))
            held += len(a)
            if held > 1 << 20:  # keep what connects, not every pair
                root = _roots(sizes[s], *map(np.concatenate, zip(*pairs)))
                far = np.flatnonzero(root != np.arange(sizes[s]))
                pairs, held = [(far, root[far])], 0
        for a, b in pairs:
            left.append(a + cut[s])
            right.append(b + cut[s])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = _roots(len(fps), np.concatenate(left), np.concatenate(right))
    far = np.flatnonzero(root != np.arange(len(fps)))
    return far, root[far]


def links(fps: DataFrame, radius: int = 3, blocks: int = 5, most: int = MOST) -> DataFrame:
    """Edges ``(u, v)`` between the stored fingerprints ``fps`` that connect all pairs within the radius."""

    def run(batches):
        def emit(key, fp, end):
            cut = np.append(np.flatnonzero(np.concatenate(([True], np.any(key[1:end] != key[: end - 1], axis=1)))), end)
            a, b = shard_links(fp[:end], cut, radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["u", "v"])

        keys, fps = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            keys.append(key)
            fps.append(batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if np.array_equal(keys[0][0], key[-1]):
                continue  # one shard so far
            key, fp = np.concatenate(keys), np.concatenate(fps)
            end = int(np.flatnonzero(np.any(key != key[-1], axis=1))[-1]) + 1  # the last shard may go on
            yield emit(key, fp, end)
            keys, fps = [key[end:]], [fp[end:]]
        if keys:
            key, fp = np.concatenate(keys), np.concatenate(fps)
            yield emit(key, fp, len(fp))

    key = ["forest", "cell", "shell"]
    dealt = shards(fps, radius, blocks)
    if fps.count() > most:  # else no shard can be so large
        dealt = dealt_again(dealt, radius, blocks, most)
    return dealt.select(*key, "fp").repartition(*key).sortWithinPartitions(*key, "fp").mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, width: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document.

    Documents whose fingerprints differ in ``radius`` bits at most are linked; the
    component is named by the smallest id that can be reached.
    """
    rows = stored(fingerprints(docs, width), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    label = components(links(classes.select("fp"), radius, blocks))
    named = stored(classes.join(label, classes["fp"] == label["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label")), "labels")
    least = stored(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "component-ids")
    final = stored(named.join(least, "label").select("fp", "component_id"), "fingerprint-components")
    return rows.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
