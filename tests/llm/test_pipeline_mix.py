"""The mix shows in the pipeline's rows."""

from geochron.llm import mixing


def test_result_meets_the_target_weights(spark, tmp_path):
    import corpus_pipeline as p

    sizes = {"a": 640, "b": 160, "c": 40}
    texts = [(s, f"The {s} report number {i} tells about the weather of town {i * 37 % 1009} and the price of {i * 91 % 997} houses there in the year {1000 + i}.") for s, n in sizes.items() for i in range(n)]
    rows = [(i, t, "en", s, len(t)) for i, (s, t) in enumerate(texts)]
    place = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    got = sorted(p.run(spark, place).collect(), key=lambda r: r["position"])
    assert len({r["position"] for r in got}) == len(got) and {r["source"] for r in got} == set(sizes)
    of = {r[0]: r[3] for r in rows}
    assert all(r["source"] == of[r["doc_id"]] and r["slot"] == r["position"] // mixing.BLOCK_DOCS for r in got)
    left = {s: sum(r["source"] == s for r in got) for s in sizes}
    slots = mixing.frame_slots(left, None)
    total = sum(slots.values())
    first = [r["source"] for r in got if r["in_mix"]]
    assert first and [r["in_mix"] for r in got] == sorted((r["in_mix"] for r in got), reverse=True)
    blocks = len(first) // mixing.BLOCK_DOCS
    assert len(first) == blocks * mixing.BLOCK_DOCS
    for t in range(1, blocks + 1):
        for s in sizes:
            assert abs(first[: t * mixing.BLOCK_DOCS].count(s) / mixing.BLOCK_DOCS - t * slots[s] / total) < 1
