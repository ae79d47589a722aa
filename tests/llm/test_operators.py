"""Each operator against a brute-force version, on a small table with nulls, empty texts, repeats and an extra column."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geochron.llm import bpe, exact_dedup, gsaca, language_id, lm_score, mixing, near_dedup, pii, substring_dedup, topk, toxicity
from geochron.llm.shared import fold_of, new_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def rows(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    out = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x") for r in own]
    long = " ".join(f"w{i % 977}x{i * i % 8191}" for i in range(30_000))
    more = [None, "", "   ", "one two", "Ünïcode \U0001f600 text", out[3][1], out[3][1].upper(), long, long + " tail", "12 34 !!", "<|endoftext|> a  b", "A@b.co +1 (684) 555-0954 10.0.0.1 4111 1111 1111 1111"]
    out += [(1000 + i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src0", None, "x") for i, t in enumerate(more)]
    return out + [out[5], out[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = new_path(spark, "test-docs")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < -1")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_lm(docs, none, rows):
    held = fold_of("doc_id", 10) == 0
    got = {r["doc_id"]: r for r in lm_score.score_corpus(docs, held, segments=8).collect()}
    passes = {r["doc_id"]: r for r in lm_score.score_corpus(docs, held, segments=8, broadcast_bytes=100_000).collect()}
    assert all(abs(got[k]["score"] - passes[k]["score"]) < 1e-9 and got[k]["n_known"] == passes[k]["n_known"] for k in got)
    toks = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", lower(r[1])) + [None]) for r in rows]
    c, pairs, before = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in toks:
        if zlib.crc32(str(i).encode()) % 10:
            c.update(t)
            z = ["^", *t]
            before.update(z[:-1])
            pairs.update(zip(z, z[1:]))
    n, v = sum(c.values()), len(c)
    for i, t in toks:
        base = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        want, level = 0.0, 0.0
        for h, w, b in zip(["^", *t], t, base):
            q = pairs[h, w].bit_length()
            k = min(1.5 * 2 ** (q - 1) - 0.5 if q else 0, c[w], before[h])
            want += math.log10((k + lm_score.MU * b) / (before[h] + lm_score.MU))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(map(math.log10, base)), rel=1e-12)
        assert r["score"] == pytest.approx(want, rel=0.05, abs=level + 0.5)  # false items of the filter raise a few
    assert lm_score.score_corpus(none, held, segments=2).count() == 0


def test_language(spark, docs, none, rows):
    model = language_id.learned(docs)
    got = {r["doc_id"]: r for r in language_id.predicted(docs, model).collect()}
    assert len(got) == len({r[0] for r in rows})
    for i, t, lang, *_ in rows:
        r = got[i]
        assert (r["lang_pred"] == "und") == (t is None or not any(ch.isalpha() for ch in t))
        assert 0 <= r["score"] <= 1
    held = [(lang, got[i]["lang_pred"]) for i, t, lang, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2 and i < 1000]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert language_id.learned(none) is None and language_id.predicted(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.predicted(none, model).count() == 0
    for k in (1, 2, 4, 9, 40):
        code = language_id.codewords(k)
        assert len({tuple(c) for c in code.tolist()}) == k


def test_mixing(spark, docs, none, rows):
    got = mixing.mixed(docs, block_docs=4, frame=100).collect()
    assert len(got) == len(rows) and len({r["_position"] for r in got}) == len(rows)
    slots = {}
    for r in got:
        assert r["_release"] <= r["_slot"] < r["_deadline"]
        slots[r["_slot"]] = r["_source"]
    assert {r["_source"] for r in got if r["source"] is None} == {""}
    share = mixing.frame_slots({"a": 5, "b": 5, "c": 90}, {"a": 0.5, "b": 0.3, "c": 0.2}, 10)
    assert share == {"a": 5, "b": 3, "c": 2}
    order = [r["source"] for r in mixing.schedule(spark, {"a": 5, **{f"b{i}": 1 for i in range(5)}}).orderBy("slot").collect()]
    for t in range(1, 11):
        assert abs(order[:t].count("a") - t / 2) < 1 and all(abs(order[:t].count(f"b{i}") - t / 10) < 1 for i in range(5))
    assert mixing.mixed(none).count() == 0 and mixing.interleaved(docs).columns == docs.columns
    with pytest.raises(ValueError):
        mixing.mixed(docs, {"src0": 1.0})


def components(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_near_dedup(docs, none, rows):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    idf = near_dedup.document_frequencies(docs)
    ids = sorted({r[0] for r in rows})
    text = {r[0]: r[1] for r in rows}
    sets = []
    for i in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text[i]))
        sets.append(collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter())
    df = collections.Counter(s for r in rows for s in set(sets[ids.index(r[0])]))
    weigh = [{s: n * math.log1p(len(rows) / max(df[s], len(rows) / near_dedup.RARE)) for s, n in x.items()} for x in sets]
    pairs = []
    for a in range(len(ids)):
        for b in range(a):
            both = weigh[a].keys() & weigh[b].keys()
            low = sum(min(weigh[a][s], weigh[b][s]) for s in both)
            total = sum(weigh[a].values()) + sum(weigh[b].values()) - low
            if weigh[a] == weigh[b] or (total and low / total >= 0.8):
                pairs.append((a, b))
    want = components(len(ids), pairs)
    assert {i: ids[w] for i, w in zip(ids, want)} == got
    assert near_dedup.near_classes(none).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())


def test_consistent_sampling_estimates_similarity():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.choice(1 << 53, 600, replace=False).astype(np.uint64))
    w = rng.integers(1, 5, 600).astype(float)
    v = w.copy()
    v[:150] *= 2
    v[150:200] = 0
    at = lambda n: np.array([0, n])
    a = near_dedup.samples(keys, w, at(600), 2000)[0]
    b = near_dedup.samples(keys[v > 0], v[v > 0], at(int((v > 0).sum())), 2000)[0]
    assert abs((a == b).mean() - np.minimum(v, w).sum() / np.maximum(v, w).sum()) < 0.04


def test_exact_dedup(spark, docs, none, rows):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "digests"), 4)
    got = exact_dedup.add(index, docs.where("doc_id % 2 = 0")).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        if r[0] % 2 == 0:
            groups[hashlib.sha256(lower(r[1]).encode()).hexdigest()].append(r[0])
    for r in got:
        g = groups[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), r["doc_id"] == max(g))
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    assert not any(r["kept"] for r in exact_dedup.add(again, docs.where("doc_id % 2 = 0")).collect())
    assert again.table().count() == len(groups) and exact_dedup.add(again, none).count() == 0
    plan = again.new_in(again.table().select("digest"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    kept = exact_dedup.keep_documents(exact_dedup.DigestIndex(spark, new_path(spark, "digests"), 4), docs)
    assert kept.columns == docs.columns and kept.count() == len({lower(r[1]) for r in rows})


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for _ in range(60):
        strings = [rng.integers(0, rng.choice([1, 2, 3, 20]), rng.integers(0, 40)).tolist() for _ in range(5)]
        start = np.cumsum([0] + [len(s) for s in strings[:-1]])
        want = [o + i for o, s in zip(start, strings) for i in sorted(range(len(s)), key=lambda i: s[i:])]
        assert gsaca.suffix_arrays(np.array([c for s in strings for c in s], dtype=np.int64), start).tolist() == want


def trimmed_by_force(rows):
    """Sorted rows of trimmed(); a null id counts as smaller than any other."""
    rows = sorted((-1 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows)
    first, out = {}, []
    for i, b in rows:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def trimmed_rows(df, block_bytes):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.trimmed(df, block_bytes).collect())


def test_substring_dedup(docs, none, rows):
    assert trimmed_rows(docs, 200_000) == trimmed_by_force(rows)
    assert substring_dedup.trimmed(none).count() == 0


def test_substring_dedup_of_repeated_and_null_ids(spark):
    draw = random.Random(3)
    passages = ["".join(draw.choices("abcdefgh", k=90)) for _ in range(12)]
    rows = []
    for i in range(200):
        text = "".join(draw.choices("xyzuvw", k=30))
        for _ in range(3):
            a = draw.randrange(25)
            text += draw.choice(passages)[a : a + draw.randrange(40, 66)] + draw.choice("0123456789")
        rows.append((None if i % 41 == 0 else i // 3, text))
    assert trimmed_rows(spark.createDataFrame(rows, "doc_id long, text string"), 2000) == trimmed_by_force(rows)


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (12 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, docs, none, rows):
    odd = ["a@b.co_x@d.com, z@q", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255", "+12 +1..........2 1 2 3 4111-1111 1111 1111", "a." * 2000 + "@x" + ".y" * 3000 + " z@z.z", "Dr. Anna Smith password=b7db7aa4a5fcc78305 (684) 555-0954"]
    more = spark.createDataFrame([(2000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(more)
    text = {r[0]: r[1] or "" for r in rows} | {2000 + i: t for i, t in enumerate(odd)}
    for r in pii.found(every).collect():
        base = [(s["lo"], s["kind"], s["hi"]) for s in r["spans"] if s["base"]]
        assert base == base_spans(text[r["doc_id"]])
        extra = [s for s in r["spans"] if not s["base"]]
        assert not any(s["lo"] < b[2] and b[0] < s["hi"] for s in extra for b in base)
        if r["doc_id"] == 2004:
            assert "secret" in {pii.KINDS[s["kind"]] for s in extra}
    assert pii.found(none).count() == 0
    post, chance = pii.reliabilities([((1, 1, 1, 1), 50), ((-1, -1, 0, -1), 50), ((1, -1, 0, 1), 5)])
    assert post[1, 1, 1, 1] > 0.9 > 0.1 > post[-1, -1, 0, -1]


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(300, 8)).round(1).tolist()
    data = [(i, v) for i, v in enumerate(vecs)] + [(400, None), (401, [float("nan")] * 8), (402, [None] * 8), (450, [1e30] * 8), (500, [1.0] * 3), (7, vecs[7])]
    q = topk.quantised(spark.createDataFrame([d for d in data if d[0] != 450], "vec_id long, embedding array<double>").repartition(3))
    got = [tuple(r) for r in topk.top_k(q, q.where("vec_id % 50 = 0"), 5, block_rows=4, tile_rows=16).orderBy("query_id", "rank").collect()]
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in data if i != 450 and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, a in ints:
        if i % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in ints if j != i and len(a) == len(b))
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:5])]
    assert got == sorted(want)
    assert topk.top_k(q.where("vec_id < 0"), q.where("vec_id < 0")).count() == 0


def test_bpe(docs, none, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.encoded(docs).collect()}
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        x = got[r[0]]
        assert x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    own = bpe.BPE(path)
    for text in ("it's'll 'd don't  've '", "a's b'RE c're' ''s", "  \n x\t y  ", "<|endoftext|>  <|endoftext|> a", "aaaa" * 99, "été 12٣ 　x"):
        ids = own.encode(text)
        assert ids == t.encode(text, add_special_tokens=False).ids and own.decode(np.array(ids)) == text
    assert bpe.encoded(none).count() == 0


def test_toxicity(spark, docs, none):
    words = ["lorem", "ipsum", "dolor", "amet", "women", "men", "sed", "quia", "nemo", "enim"]
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(words, 30)) + (" moron" if i % 4 == 0 else "") + (" women women" if i % 8 == 0 else "") for i in range(800)]
    labels = [int(i % 4 == 0) for i in range(800)]
    model = toxicity.fit(texts[:600], labels[:600], 0.25)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[600:])] + [(1000, None), (1001, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.scored(df, model).collect()}
    assert all(got[i]["predicted"] == labels[600 + i] for i in range(200)) and got[1000]["score"] == got[1001]["score"]
    a, b = (r["score"] for r in toxicity.scored(spark.createDataFrame([(1, "women people live here"), (2, "men people live here")], "doc_id long, text string"), model).orderBy("doc_id").collect())
    assert abs(a - b) < 0.05 and a < 0.5
    assert toxicity.swapped("The Women and nothing") == "The men and nothing" and toxicity.swapped("nothing") is None
    one = toxicity.fit(*toxicity.training_rows(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert toxicity.scored(none, one).count() == 0


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline as p

    place = str(tmp_path / "sf")
    keep = [r for r in rows if r[0] < 60 or 1000 <= r[0] < 1012]
    spark.createDataFrame([r[:5] for r in keep], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns
        out.write.parquet(f"{place}/{name}")
        nxt = spark.read.parquet(f"{place}/{name}")
        before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (docs, nxt))
        assert after <= before
        if name == "language_id":
            assert before - after >= {1000, 1001, 1002, 1009}  # nothing that has a language goes but ambiguous texts
        if name == "exact_dedup":
            assert nxt.count() == len({lower(r["text"]) for r in docs.collect()})
        if name == "mixing":
            assert before == after
        docs = nxt
    got = p.run(spark, place).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.collect())
