"""Pieces of near-duplicate search: what they send takes less room than texts and whole hashes."""

import random

import numpy as np

from geochron.llm import near_dedup


def test_pieces_travel_small(spark):
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(4000)]
    rows = [(i, " ".join(draw.choices(words, k=400))) for i in range(500)] + [(None, None), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    pieces, n, bits = near_dedup.in_pieces(docs)
    packed = pieces.collect()
    assert n == len(rows) and sum(len(b["packed"]) for b in packed) < 0.6 * sum(len(t or "") for _, t in rows)
    back = [tuple(r.values()) for p in packed for b in near_dedup.pa.ipc.open_stream(p["packed"]) for r in b.select(["doc_id", "text"]).to_pylist()]
    assert sorted(map(repr, back)) == sorted(map(repr, rows))


def test_differences_of_shingles():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (1, 1 << 48), (300, 1 << 20), (5400, 1 << 48)):
        keys = np.unique(rng.integers(0, top, n).astype(np.uint64))
        data = near_dedup._steps(keys)
        assert (near_dedup._from_steps(data, len(keys)) == keys).all()
    assert len(data) == 5 * len(keys)


def test_few_other_sets_pass_the_bitmap(spark):
    rows = spark.range(40_000).selectExpr("xxhash64(id) as v", "id")
    wanted = rows.where("id % 5 = 0").select("v")
    got = near_dedup._probably_in(rows, wanted).select("id").collect()
    found = {r["id"] for r in got}
    assert found >= set(range(0, 40_000, 5)) and len(got) == len(found) < 8000 + 32_000 / 10
    assert near_dedup._probably_in(rows, wanted.limit(0)).count() == 0
