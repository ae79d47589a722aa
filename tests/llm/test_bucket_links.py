"""Links of near-duplicate search between members of a bucket whose smallest vertex is neither of them."""

import random

from geochron.llm import near_dedup


def test_link_of_which_few_samples_agree(spark):
    # Found by search: texts 1 and 2 have similarity 0.801, but only 27 of their 48 samples agree; they share buckets with text 0 only, to which neither is linked.
    r = random.Random(58472)
    w = [f"w{r.randrange(10**9)}" for _ in range(70)]
    own = lambda n: [f"x{r.randrange(10**9)}" for _ in range(n)]
    texts = [w + own(7), w + own(7)]
    r = random.Random(58472 * 1000 + 4)
    a = r.randrange(0, 14)
    texts.insert(0, w[a : a + 56] + own(8))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, f"plain{i} text{i}") for i in range(1000)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 1 if i == 2 else i for i, _ in rows}
