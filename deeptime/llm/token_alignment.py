"""Cross-tokenizer alignment with corpus-wide counts of linked id pairs, counted outside memory.

A text with a space before it is cut into tokens by two vocabularies, A (byte-level
BPE) and B (pieces with byte fallback). Where tokens of both end at one byte, a
group ends and the two tokens that end there are linked. A pair's count is how
many links of the whole corpus hold it.

*Tokens.* No token of either vocabulary reaches from a character that is not white
space over a following space (for B the vocabulary is asked, else texts stay
whole), so texts are cut there and each distinct segment is tokenised and aligned
once in a task.

*Counting.* Tasks gather ``(pair, row)`` records, sort them by radix partition of
the B id, pair and row, and write them as runs of zstd blocks to the shared
folder. Runs of one partition are dealt to shards of bounded size (by whole runs,
so a B id that all texts hold is spread too). A shard's blocks come in the order of
their first pair; a heap of open blocks merges them, with one block of each run in
memory, and gives each pair's records together: their sums are the shard's counts,
and Spark adds up the shards'. Pairs are B-major, so each B id's highest
count is known when its pairs end. The totals, in blocks of the same order, then
go through the merge beside the records, which streams each row's contributions
back.

Defined cases: null and empty texts, and texts whose joined tokens differ from the
text (a literal U+2581) have zeros and ''; rows that repeat an id and rows with a
null id are counted each; a very long text is tokenised in one task, segment by
segment (a segment without spaces at once); an empty table gives no rows; columns beyond
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_left
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deeptime.llm.common import arrow_rows, stored
from deeptime.llm.text_arrays import byte_view, filled, slices

#: Radix partitions of the B ids; records in a run's buffer and in a block.
PART_BITS, BUFFER, BLOCK = 5, 1 << 22, 4096
PARTS = 1 << PART_BITS
#: Compressed bytes of runs that one shard merges.
SHARD_BYTES = 64 << 20
#: Blocks in one Arrow batch.
BATCH_BLOCKS = 64
#: Distinct segments and their bytes that a worker remembers.
SEGMENTS, SEGMENT_BYTES = 400_000, 32 << 20
#: A pair is its A id plus its B id << ``B_BITS``; in a buffer an id has ``ID_BITS`` and a row number the rest of 64.
B_BITS, ID_BITS = 32, 20
ROW_BITS = 64 - 2 * ID_BITS
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RECORDS = f"kind int, row long, {COLUMNS}, part int, run long, first long, size long, block binary"
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32, 28, 29, 30, 31]] = True


class Vocabularies:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as f:
            ranks = {base64.b64decode(x): int(r) for x, r in map(bytes.split, f)}
        self.a = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = dict(zip(ranks.values(), ranks, strict=True))
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        #: Whether every piece has its spaces before all else.
        if max(max(self.a_bytes), len(pieces)) >= 1 << ID_BITS:
            raise ValueError(f"ids of at most {ID_BITS} bits are counted")
        self.separable = not any("▁" in p.lstrip("▁") for p in pieces)

    def tokens(self, texts: list[str]):
        """For each text, which begins with a space, its ids by A and by B."""
        own = self.b.encode([t[1:] for t in texts], num_threads=1)
        # no space is put before nothing
        return ((self.a.encode_ordinary(t), b if len(t) > 1 else [self.space]) for t, b in zip(texts, own, strict=True))


_LOADED: dict[tuple, Vocabularies] = {}


def vocabularies(*paths: str) -> Vocabularies:
    if paths not in _LOADED:
        _LOADED[paths] = Vocabularies(*paths)
    return _LOADED[paths]


def public_paths() -> tuple[str, str, str]:
    """Paths of the two vocabularies (A as the rank file of the same ids) and A's pattern."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.PATTERN


def align(a: list[int], b: list[int], a_bytes, b_bytes) -> tuple[list[int], str]:
    """Linked pairs of one text (A id + B id << 32) and its groups as text, each closed by ``;``."""
    ends_a, ends_b = list(accumulate(len(a_bytes[i]) for i in a)), list(accumulate(len(b_bytes[i]) for i in b))
    both = sorted(set(ends_a).intersection(ends_b))
    pairs, out, i, j = [], [], 0, 0
    for end in both:
        to_a, to_b = bisect_left(ends_a, end, i) + 1, bisect_left(ends_b, end, j) + 1
        out.append(f"{','.join(map(str, a[i:to_a]))}|{','.join(map(str, b[j:to_b]))};")
        pairs.append(a[to_a - 1] | b[to_b - 1] << B_BITS)
        i, j = to_a, to_b
    return pairs, "".join(out)


class Segments:
    """What is known of each segment; ids are given in the order of arrival."""

    def __init__(self, vocabs: Vocabularies):
        self.vocabs = vocabs
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.good, self.n_a, self.n_b, self.groups = (np.zeros(0, np.int64) for _ in range(4))
        self.pairs, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.text: list[bytes] = []

    def ids(self, segments: list[bytes]) -> np.ndarray:
        if len(self.index) > SEGMENTS or self.held > SEGMENT_BYTES:
            self.clear()
        new = [s for s in segments if s not in self.index]
        good, n_a, n_b, pairs, ends = [], [], [], [], []
        v, total = self.vocabs, int(self.ends[-1])
        for s, (a, b) in zip(new, v.tokens([s.decode() for s in new]), strict=True):
            whole = b"".join(map(v.a_bytes.__getitem__, a)) == s and b"".join(map(v.b_bytes.__getitem__, b)) == s
            linked, text = align(a, b, v.a_bytes, v.b_bytes) if whole else ([], "")
            self.index[s] = len(self.index)
            good.append(whole)
            n_a.append(len(a))
            n_b.append(len(b))
            pairs.extend(linked)
            total += len(linked)
            ends.append(total)
            self.text.append(text.encode())
            self.held += len(s) + len(text)
        if new:
            join = lambda x, y: np.concatenate([x, np.array(y, np.int64)])
            self.good, self.n_a, self.n_b = join(self.good, good), join(self.n_a, n_a), join(self.n_b, n_b)
            self.pairs, self.ends = join(self.pairs, pairs), join(self.ends, ends)
        return np.array([self.index[s] for s in segments], np.int64)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments begin: at each text, and at each space after a character that is not white space.

    Characters of several bytes whose first two bytes are those of white space count as such.
    """
    before, second, third = (np.concatenate((np.full(k, 32, np.uint8), data[: len(data) - k]))[: len(data)] for k in (1, 2, 3))
    wide = ((second == 0xC2) & ((before == 0x85) | (before == 0xA0))) | ((third >= 0xE1) & (third <= 0xE3) & np.isin(second, (0x80, 0x81, 0x9A)) & (before >= 0x80))
    start = (data == 32) & ~_SPACES[before] & ~wide
    start[offsets[:-1]] = True
    return np.flatnonzero(start)


def pack_block(columns: list[np.ndarray], base: int) -> bytes:
    """Little-endian columns, byte planes apart, the first (ascending) as differences, in one zstd frame."""
    head = np.array([len(columns[0]), base, int(columns[0][0])], np.int64).tobytes()
    planes = [np.diff(columns[0], prepend=columns[0][:1]), *columns[1:]]
    body = b"".join(np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in planes)
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def read_block(block: bytes) -> list[np.ndarray]:
    """The columns of ``pack_block``; the second with its base."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    n, base, first = raw[:24].view(np.int64)
    out = [np.ascontiguousarray(c.reshape(8, n).T).view(np.int64).ravel() for c in raw[24:].reshape(-1, 8 * n)]
    out[0], out[1] = np.cumsum(out[0]) + first, out[1] + base
    return out


class Runs:
    """Gathers ``(pair, row)`` records and gives them out as runs of blocks, one run for each radix partition."""

    def __init__(self):
        self.pairs, self.rows, self.held = [], [], 0

    def add(self, pairs: np.ndarray, rows: np.ndarray):
        self.pairs.append(pairs)
        self.rows.append(rows)
        self.held += len(pairs)
        if self.held >= BUFFER:
            yield from self.flush()

    def flush(self):
        if not self.held:
            return
        pairs, rows = np.concatenate(self.pairs), np.concatenate(self.rows)
        self.__init__()
        # one sortable number a record: radix partition and B id, A id, number of the row in the buffer (rows ascend)
        new = np.concatenate(([True], rows[1:] != rows[:-1]))
        known, local = rows[new], np.cumsum(new) - 1
        b, a = pairs >> B_BITS, pairs & ((1 << B_BITS) - 1)
        key = ((b % PARTS) << (ID_BITS - PART_BITS) | b >> PART_BITS) << (ID_BITS + ROW_BITS) | a << ROW_BITS | local
        key = np.sort(key.view(np.uint64))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(first, len(key)))
        key = key[first].view(np.int64)
        high = key >> (ID_BITS + ROW_BITS) & ((1 << ID_BITS) - 1)
        part = high >> (ID_BITS - PART_BITS)
        pairs = ((high & ((1 << (ID_BITS - PART_BITS)) - 1)) << PART_BITS | part) << B_BITS | key >> ROW_BITS & ((1 << ID_BITS) - 1)
        rows, base = known[key & ((1 << ROW_BITS) - 1)], int(known[0])
        edges = np.searchsorted(part, np.arange(PARTS + 1))
        for p in range(PARTS):
            for k in range(edges[p], edges[p + 1], BLOCK):
                at = slice(k, min(k + BLOCK, edges[p + 1]))
                yield p, base, int(pairs[k]), pack_block([pairs[at], rows[at] - base, count[at]], base)


def aligned(docs: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """Rows of two kinds (``RECORDS``): 0, a document with its counts; 1, a block of a run."""

    def run(batches):
        segments, runs = Segments(vocabularies(*paths)), Runs()
        schema = pa.schema([("kind", pa.int32()), ("row", pa.int64()), *((c.split()[0], pa.string() if "string" in c else pa.int64()) for c in COLUMNS.split(", ")), ("part", pa.int32()), ("run", pa.int64()), ("first", pa.int64()), ("size", pa.int64()), ("block", pa.binary())])

        def table(n: int, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def spilled(blocks):
            found = list(zip(*blocks, strict=True))
            if found:
                yield table(len(found[0]), kind=[1] * len(found[0]), part=found[0], run=found[1], first=found[2], size=[len(b) for b in found[3]], block=found[3])

        for batch in batches:
            for a, b in slices(byte_view(filled(batch.column(2)))[1]):
                own = batch.slice(a, b - a)
                columns, links = documents(own.column(2), segments)
                yield table(b - a, kind=[0] * (b - a), row=own.column(0), doc_id=own.column(1), **columns)
                rows = own.column(0).to_numpy()
                for pairs, doc in links:
                    yield from spilled(runs.add(pairs, rows[doc]))
        yield from spilled(runs.flush())

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, RECORDS)


def documents(column: pa.Array, segments: Segments) -> tuple[dict, list]:
    """Columns of the texts, and ``[(pairs, numbers of their texts)]``."""
    column = filled(column)
    empty = pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    data, offsets = byte_view(pc.binary_join_element_wise(" ", column, ""))
    start = cuts(data, offsets) if segments.vocabs.separable else offsets[:-1]
    ends = np.append(start, len(data))
    pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    seg = segments.ids(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    bound = np.searchsorted(start, offsets)
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[bound])
    good = (total(1 - segments.good[seg]) == 0) & ~empty
    n_links = np.diff(segments.ends)[seg]
    columns = {"n_a": total(segments.n_a[seg]) * good, "n_b": total(segments.n_b[seg]) * good, "n_groups": total(n_links) * good}
    codes, text = seg.tolist(), segments.text
    digest = lambda i: hashlib.sha256(b"".join([text[c] for c in codes[bound[i] : bound[i + 1]]])[:-1]).hexdigest()
    columns |= {"n_links": columns["n_groups"], "groups_sha256": [digest(i) if ok else "" for i, ok in enumerate(good)]}
    # the links of every segment of the good texts, in bounded steps
    doc = np.repeat(np.arange(len(column)), np.diff(bound))
    keep = good[doc]
    seg, doc, n_links = seg[keep], doc[keep], n_links[keep]
    first, upto, links, lo = segments.ends[seg], np.cumsum(n_links), [], 0
    while lo < len(seg):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BUFFER // 2, "right")))
        n = n_links[lo:hi]
        at = np.repeat(first[lo:hi] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        links.append((segments.pairs[at], np.repeat(doc[lo:hi], n)))
        lo = hi
    return columns, links


def merged(blocks):
    """K-way merge of blocks that come in batches, in the order of their first pair.

    Takes lists of ``(kind, block)`` and gives ``(kind 0 columns, kind 1 columns)`` of ascending,
    disjoint ranges of pairs; all that is known of a range comes at once. The heap holds
    the open blocks by their next pair.
    """
    heap: list = []
    number = 0
    for batch in chain(blocks, [None]):
        bound = None
        for kind, block in batch or ():
            columns = read_block(block)
            bound = int(columns[0][0])  # whatever comes later begins here or after
            heapq.heappush(heap, (bound, number, kind, columns))
            number += 1
        taken: dict[int, list] = {0: [], 1: []}
        while heap and (bound is None or heap[0][0] < bound):
            _, n, kind, columns = heapq.heappop(heap)
            cut = len(columns[0]) if bound is None else int(np.searchsorted(columns[0], bound))
            taken[kind].append([c[:cut] for c in columns])
            if cut < len(columns[0]):
                rest = [c[cut:] for c in columns]
                heapq.heappush(heap, (int(rest[0][0]), n, kind, rest))
        out = []
        for kind in (0, 1):
            columns = [np.concatenate(c) for c in zip(*taken[kind], strict=True)] or [np.zeros(0, np.int64)] * 3
            order = np.argsort(columns[0], kind="stable")
            out.append([c[order] for c in columns])
        if len(out[0][0]) or len(out[1][0]):
            yield out


def _shards(batches):
    """``(key, lists of (kind, block))`` of each shard in turn, from Arrow batches in the order of the shards."""
    rows = ((r["part"], r["shard"], r["kind"], r["block"]) for batch in batches for k in range(0, batch.num_rows, BATCH_BLOCKS) for r in batch.slice(k, BATCH_BLOCKS).to_pylist())
    ahead = next(rows, None)

    def lists(key):
        nonlocal ahead
        held = []
        while ahead is not None and ahead[:2] == key:
            held.append(ahead[2:])
            ahead = next(rows, None)
            if len(held) == BATCH_BLOCKS:
                yield held
                held = []
        if held:
            yield held

    while ahead is not None:
        yield ahead[:2], lists(ahead[:2])


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values))


def partial_counts(batches):
    """A shard's counts: ``pair, n``, one row for each pair of a merged range."""
    for _, lists in _shards(batches):
        for _, (pairs, _, count) in merged(lists):
            keys, n = _sums(pairs, count)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])


def contributions(batches):
    """``row, n_best, count_sum`` of each shard, from its records and the totals that come beside them."""
    give = lambda sums: pa.RecordBatch.from_arrays([pa.array(c) for c in sums], ["row", "n_best", "count_sum"])
    for _, lists in _shards(batches):
        held, size = [], 0
        for (known, total, best), (pairs, rows, count) in merged(lists):
            if not len(pairs):
                continue
            at = np.searchsorted(known, pairs)
            held.append(_sums(rows, count * best[at], count * total[at]))
            size += len(held[-1][0])
            if size > BUFFER:
                # as many as the shard has rows
                held = [_sums(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > BUFFER // 2:
                    yield give(held.pop())
                    size = 0
        if held:
            yield give(_sums(*map(np.concatenate, zip(*held, strict=True))))


def _total_blocks(batches):
    """Blocks of ``part, pair, total, best`` rows that come in the order of their pairs."""
    held: dict[int, list] = {}

    def packed(part, columns):
        block = pack_block(columns, 0)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int(columns[0][0])]), pa.array([block], pa.binary())], ["part", "first", "block"])

    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(4)]
        for p in np.unique(columns[0]):
            mine = [c[columns[0] == p] for c in columns[1:]]
            mine = [np.concatenate(c) for c in zip(held[int(p)], mine, strict=True)] if int(p) in held else mine
            while len(mine[0]) >= BLOCK:
                yield packed(int(p), [c[:BLOCK] for c in mine])
                mine = [c[BLOCK:] for c in mine]
            held[int(p)] = mine
    for p, columns in held.items():
        if len(columns[0]):
            yield packed(p, columns)


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.select("part", "shard", "kind", "first", "block").repartition("part", "shard").sortWithinPartitions("part", "shard", "first", "kind")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``part, pair, total, best`` (stored): each linked pair's count and whether it is its B id's highest."""
    with arrow_rows(blocks.sparkSession, BATCH_BLOCKS):
        partial = _dealt(blocks).mapInArrow(partial_counts, "pair long, n long")
        total = partial.groupBy("pair").agg(F.sum("n").alias("total"))
        side = F.shiftright("pair", B_BITS)
        # as many rows for a B id as A has ids
        top = F.max("total").over(Window.partitionBy("side"))
        total = total.withColumn("side", side).withColumn("best", (F.col("total") == top).cast("long"))
        return stored(total.select((F.col("side") % PARTS).cast("int").alias("part"), "pair", "total", "best"), "pair-totals")


def count_links(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """A row for each document: its tokens, groups and links, and what the corpus-wide counts give it."""
    spark = docs.sparkSession
    found = stored(aligned(docs, paths or public_paths()), "aligned")
    blocks = found.filter("kind = 1").select("part", "run", "first", "size", "block")
    # a row for each radix partition
    shards = blocks.groupBy("part").agg(F.ceil(F.sum("size") / SHARD_BYTES).cast("int").alias("shards"))
    shards = F.broadcast(stored(shards, "run-shards"))
    runs = blocks.join(shards, "part").withColumn("shard", F.pmod(F.xxhash64("run"), F.col("shards")).cast("int")).withColumn("kind", F.lit(1))
    totals = pair_counts(runs)
    known = totals.repartition("part").sortWithinPartitions("part", "pair").mapInArrow(_total_blocks, "part int, first long, block binary")
    known = known.join(shards, "part").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("kind", F.lit(0))
    both = _dealt(runs.select("part", "shard", "kind", "first", "block").unionByName(known.select("part", "shard", "kind", "first", "block")))
    with arrow_rows(spark, BATCH_BLOCKS):
        given = stored(both.mapInArrow(contributions, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "link-sums")
    rows = found.filter("kind = 0").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(given, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
