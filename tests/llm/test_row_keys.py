"""Stages judge rows, also where ids are null or repeat."""

from deeptime.llm import decontaminate, exact_dedup, near_copies

SCHEMA = "doc_id long, text string"


def left(frame):
    return sorted((str(r.doc_id), r.text) for r in frame.collect())


def test_keep_first(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (1, "A"), (2, "c"), (2, "c"), (2, "d"), (3, "D"), (None, "e"), (None, "e")], SCHEMA)
    assert left(exact_dedup.keep_first(docs)) == [("1", "A"), ("2", "c"), ("3", "D"), ("None", "b"), ("None", "e")]


def test_keep_one(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "quite another text here"), (1, "A b c d"), (2, "one of its own kind"), (2, "one of its own kind"), (2, "a  b c d")], SCHEMA)
    assert left(near_copies.keep_one(docs)) == [("1", "A b c d"), ("2", "one of its own kind"), ("None", "quite another text here")]


def test_drop_leaks(spark):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x a b c d e f g"), (None, "clean"), (1, "A b c d e f g"), (1, "clean too")], SCHEMA)
    assert left(decontaminate.drop_leaks(docs, items)) == [("1", "clean too"), ("None", "clean")]


def test_columns_that_clash_come_through(spark):
    names = ["__row", "__kept", "__out", "__met", "__at", "row", "label", "key"]
    docs = spark.createDataFrame([(1, "a b c d e f", *range(8)), (2, "A b c d e f", *range(8)), (3, "of its own kind", *range(8))], SCHEMA + "".join(f", {n} int" for n in names))
    items = spark.createDataFrame([(1, "z y x w v u")], "item_id long, text string")
    for out, kept in ((exact_dedup.keep_first(docs), {2, 3}), (near_copies.keep_one(docs), {1, 3}), (decontaminate.drop_leaks(docs, items), {1, 2, 3})):
        rows = out.collect()
        assert out.columns == docs.columns and {r.doc_id for r in rows} == kept and all(list(r)[2:] == list(range(8)) for r in rows)
