"""Idf of near-duplicate search: exact for rare shingles too."""

from geochron.llm import near_dedup


def test_rare_shingles_weigh_by_their_own_frequency(spark):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    both = words("both", 82)
    # Of 1,032 documents, two share 78 shingles that only they have; each has 10 more that three others have.  All are in less
    # than one document in 256.  With ln(1 + N / df) the similarity is 0.815, with one idf for all of them 0.796.
    rows = [(i, " ".join(both + words(tail, 10))) for i, tail in enumerate(("left", "right"))]
    rows += [(10 + i, " ".join(words(f"own{i}w", 60) + both[-4:] + words(("left", "right")[i % 2], 10))) for i in range(6)]
    rows += [(100 + i, f"plain{i} text{i}") for i in range(1024)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == {i: 0 if i == 1 else i for i, _ in rows}
