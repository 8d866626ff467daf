import hashlib
import random
import zlib

from deeptime.llm import merkle

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    trees = {}
    for i, source, lang, n, text in rows:
        hit = i is not None and text is not None and zlib.crc32(str(i).encode()) % 3 == 0
        claim = leaf(i, source, lang, n, text.translate(A_Z) if hit else text)
        trees.setdefault(lang, []).append((i is not None, i or 0, leaf(i, source, lang, n, text), claim))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = [levels([r[2] for r in sorted(trees[lang])]) for lang in order]
    top = levels([t[-1][0] for t in built])
    for k, lang in enumerate(order):
        for at, (has, i, own, claim) in enumerate(sorted(trees[lang])):
            proof, folded = [], claim
            for tree, place in ((built[k], at), (top, k)):
                for level in tree[:-1]:
                    run, j = level[place // 8 * 8 : place // 8 * 8 + 8], place % 8
                    proof += run[:j] + run[j + 1 :]
                    folded = h(*run[:j], folded, *run[j + 1 :])
                    place //= 8
            root = top[-1][0]
            yield str((i if has else None, own, built[k][-1][0], root, h(*proof), folded, folded == root))


def test_proofs_equal_brute_force(spark):
    rng = random.Random(13)
    rows = [(None, None, None, None, None)] * 3 + [(5, "s", "zz", 1, "X")] * 2 + [(7, "", "", 0, "")]
    rows += [(rng.randrange(-50, 400), "Ö", f"l{k % 10}", None, "Längerer TEXT " * rng.randrange(4)) for k in range(90)]
    rows += [(1000 + k, "hot", "en", k, "Word " * (30_000 if k == 4 else 2)) for k in range(140)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS leaf", "2 AS tree", "3 AS idx", "4 AS n", "5 AS place")
    got = merkle.verify(frame.repartition(5)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(brute(rows))
    assert 0 < sum(r.verified for r in got) < len(got)


def test_one_row_one_language_and_empty_table(spark):
    rows = [(3, "s", "en", 4, "Text"), (4, "s", "en", 4, "text"), (6, "s", "en", 4, None)]
    frame = spark.createDataFrame(rows, COLUMNS)
    for n in (1, 3):
        assert sorted(str(tuple(r)) for r in merkle.verify(frame.limit(n)).collect()) == sorted(brute(rows[:n]))
    assert merkle.verify(frame.limit(0)).count() == 0


def test_only_what_is_changed_fails(spark):
    rows = [(k, "s", "en", 1, f"text {k}") for k in range(70)]
    frame = spark.createDataFrame(rows, COLUMNS)
    from pyspark.sql import functions as F

    got = {r.doc_id: r.verified for r in merkle.verify(frame, F.when(F.col("doc_id") == 41, "other").otherwise(F.col("text"))).collect()}
    assert [k for k, v in got.items() if not v] == [41]
