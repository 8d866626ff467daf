import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from deeptime.llm import token_alignment


def byte_level():
    """Characters that stand for bytes in the byte-level vocabulary's entries."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def brute():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    back = byte_level()
    bytes_a = {i: bytes(back[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode()

    def run(rows):
        found, links = [], []
        for _, text in rows:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
            ids_b = b.encode(text) if text else []
            want = (" " + text).encode() if text else b""
            if b"".join(map(bytes_a.get, ids_a)) != want or b"".join(map(bytes_b, ids_b)) != want:
                ids_a, ids_b = [], []
            ends = []
            for ids, size in ((ids_a, bytes_a.get), (ids_b, bytes_b)):
                at, out = 0, {}
                for k, i in enumerate(ids):
                    at += len(size(i))
                    out[at] = k
                ends.append(out)
            both = sorted(set(ends[0]) & set(ends[1]))
            groups, i, j, own = [], 0, 0, []
            for e in both:
                ka, kb = ends[0][e], ends[1][e]
                groups.append(",".join(map(str, ids_a[i : ka + 1])) + "|" + ",".join(map(str, ids_b[j : kb + 1])))
                own.append((ids_a[ka], ids_b[kb]))
                i, j = ka + 1, kb + 1
            found.append((len(ids_a), len(ids_b), len(both), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""))
            links.append(own)
        count = Counter(p for own in links for p in own)
        top = defaultdict(int)
        for (_, y), n in count.items():
            top[y] = max(top[y], n)
        return sorted(str((i, *f[:4], sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), f[4])) for (i, _), f, own in zip(rows, found, links, strict=True))

    return run


def rows_of(frame):
    return sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in frame.collect())


ODD = [
    None, "", " ", "   ", "a", "\n\n  x \t y ", "it's  don't we'LL", "<s> </s> <|endoftext|> [INST]", "na\u00efve \u00fcber stra\u00dfe", "\u4e2d\u6587 \u65e5\u672c\u8a9e \u3000 wide",
    "no\u00a0break \u00a0 here\u2003em \u2028 line", "a\u2581b", "\u2581", "\U0001f600 smile \U0001f468\u200d\U0001f469", "x" * 400, "1234567890 3.14", "nul\x00 \x1f unit", "tab\t tab", "end ", "\u0085 next", "e\u0301 combining",
]


def test_alignment_equals_brute_force(spark, brute, monkeypatch):
    rng = random.Random(12)
    words = ["the", "of", "alignment", "Tokenizer", "\u00e9t\u00e9", "2024", "foo-bar", "http://x.org/a?b=c", "\n", "  ", "zzz", "\u00a0"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)] + ["the same text"] * 40 + ["long " * 30_000]
    rows = [(k % 90 if k else None, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS part", "3 AS n_a").repartition(3)
    assert rows_of(token_alignment.count_links(frame)) == brute(rows)
    # many runs, blocks and shards; a small memory of segments
    for name, value in (("BUFFER", 300), ("BLOCK", 8), ("SHARD_BYTES", 700), ("BATCH_BLOCKS", 3)):
        monkeypatch.setattr(token_alignment, name, value)
    small = frame.filter("length(text) < 1000 or text is null")
    assert rows_of(token_alignment.count_links(small)) == brute([r for r in rows if len(r[1] or "") < 1000])
    assert token_alignment.count_links(frame.limit(0)).count() == 0


def test_merge_gives_all_of_a_range_at_once():
    import numpy as np

    rng = np.random.default_rng(5)
    blocks = []
    for kind in (0, 1, 1, 1):
        pairs = np.sort(rng.choice(60, 40, replace=kind == 1)).astype(np.int64)
        if kind == 0:
            pairs = np.arange(60)
        blocks += [(int(pairs[k]), kind, token_alignment.pack_block([pairs[k : k + 6], pairs[k : k + 6] * 2, pairs[k : k + 6] * 3], 0)) for k in range(0, len(pairs), 6)]
    blocks.sort(key=lambda b: b[:2])
    lists = [[b[1:] for b in blocks[k : k + 2]] for k in range(0, len(blocks), 2)]
    seen, last = Counter(), -1
    for (known, *_), (pairs, twice, _) in token_alignment.merged(iter(lists)):
        assert set(pairs.tolist()) <= set(known.tolist()) and (not len(known) or known[0] > last) and (twice == 2 * pairs).all()
        last = max([last, *known.tolist()])
        seen.update(pairs.tolist())
    assert sum(seen.values()) == 120


def test_vocabulary_files_agree():
    """The rank file and the published vocabulary give the same ids."""
    docs = ["".join(chr(random.Random(k).randrange(32, 0x2FFF)) for _ in range(300)) for k in range(40)] + [t for t in ODD if t]
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    own = token_alignment.vocabularies(*token_alignment.public_paths()).a
    for t in docs:
        assert own.encode_ordinary(t) == a.encode(t, add_special_tokens=False).ids
