"""Near-duplicate search of rows with repeated and null ids."""

from geochron.llm import near_dedup


def test_repeated_and_null_ids(spark):
    text = lambda name, last="end": " ".join([f"{name}{i}" for i in range(200)] + [last])
    rows = [(1, text("a")), (1, text("b")), (2, text("b", "last")), (7, text("a", "last")), (None, text("c")), (None, text("c", "last")), (5, text("c", "final")), (9, text("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r["doc_id"]), repr(r["class_id"]), r["class_size"]) for r in near_dedup.near_classes(docs).collect())
    assert got == [("1", "1", 2), ("1", "1", 2), ("2", "1", 2), ("5", "None", 3), ("7", "1", 2), ("9", "9", 1), ("None", "None", 3), ("None", "None", 3)]
    kept = [tuple(r) for r in near_dedup.keep_one(docs).collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 1, 9]
    assert {t for i, t in kept if i == 1} == {text("a"), text("b")} and sum(i is None for i, _ in kept) == 1
