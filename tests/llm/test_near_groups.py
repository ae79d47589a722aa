"""Near copies within a larger group of copies: what all share has a low idf there, each one's changes a high one."""

import random

from geochron.llm import near_dedup
from geochron.llm.registry import QUERIES


def test_near_copies_in_a_group_of_copies(spark, tmp_path):
    draw = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    # Copies with one word of their own each: any two share 86 of 106 shingles (0.81), by weight they are at 0.74.
    rows = [(i, " ".join(f"own{i}" if j == 6 + 5 * i else w for j, w in enumerate(base))) for i in range(18)]
    # Three of another text, of which many shingles come twice; the fourth has too many changes.
    other = [f"v{i % 60}" for i in range(120)]
    for i, changes in enumerate(([], [40], [80], [5, 25, 45, 65, 85, 105])):
        rows.append((50 + i, " ".join(f"x{i}" if j in changes else w for j, w in enumerate(other))))
    rows += [(100 + i, " ".join(f"plain{draw.randrange(10**9)}" for _ in range(3))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in QUERIES["op4_near_dedup"](spark, str(tmp_path)).collect()}
    assert {i: got[i] for i in range(18)} == {i: (0, 18) for i in range(18)}
    assert [got[i] for i in range(50, 54)] == [(50, 3), (50, 3), (50, 3), (53, 1)]
    assert all(got[i] == (i, 1) for i, _ in rows if i >= 100)
    kept = near_dedup.keep_one(docs.where("doc_id < 100"), plain=True)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 50, 53]
