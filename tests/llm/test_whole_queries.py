"""The registered queries as they are, on one small table of odd rows: their columns, and their values against SQL or brute force."""

import glob
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geochron.llm import bpe, exact_dedup, language_id, mixing, near_dedup, pii, toxicity
from geochron.llm.registry import QUERIES, SQL
from geochron.llm.shared import new_path

from test_operators import base_spans, lower

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """A folder of tables: documents with nulls, empty texts, repeats and columns whose names clash with the operators' own."""
    top = str(tmp_path_factory.mktemp("tables"))
    own = spark.read.parquet(f"{SF}/documents.parquet").collect()
    draw = random.Random(1)
    odd = [None, "", " ", "Mr. John Smith a@b.co " * 3, "x" * 30_000, "1.2.3.4 " * 400, own[4]["text"], (own[4]["text"] or "").upper()]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in own]
    rows += [(5000 + i, t, None, draw.choice([None, "web"]), None) for i, t in enumerate(odd)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumns({"_source": F.lit("mine"), "digest": F.lit(1), "score": F.lit("x"), "_mark": F.lit(2)}).repartition(3).write.parquet(f"{top}/documents.parquet")
    for name in ("labels", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{top}/{name}.parquet")
    return top, rows


@pytest.fixture(scope="module")
def other(place):
    con = duckdb.connect()
    for p in glob.glob(f"{place[0]}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}/*.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, place, other, name):
    df, want = QUERIES[name](spark, place[0]), other.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(repr(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(repr(r[i]) for i in at) for r in want.fetchall())


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1_score_is_the_models(spark, place):
    top, rows = place
    got = {r["doc_id"]: r for r in QUERIES["op1_lm_score"](spark, top).collect()}
    from collections import Counter

    from geochron.llm import lm_score

    toks = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", lower(r[1])) + [None] for r in rows}
    c, pairs, before = Counter(), Counter(), Counter()
    for i, t in toks.items():
        if fold(i, 10):
            c.update(t)
            before.update(["^", *t][:-1])
            pairs.update(zip(["^", *t], t))
    n, v = sum(c.values()), len(c)
    raised = 0
    for i, t in toks.items():
        r, want, most = got[i], 0.0, 0.0
        for h, w in zip(["^", *t], t):
            b, q = (c[w] + 0.1) / (n + 0.1 * (v + 1)), pairs[h, w].bit_length()
            k = min(1.5 * 2 ** (q - 1) - 0.5 if q else 0, c[w], before[h])
            want += math.log10((k + lm_score.MU * b) / (before[h] + lm_score.MU))
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (fold(i, 10) == 0, len(t), n)
        # The filter errs to one side only: a false item raises a pair's count.
        assert r["score"] >= want - 1e-6
        raised += r["score"] - want
    assert raised / sum(map(len, toks.values())) < 0.02


def test_op2_by_plain_arithmetic(spark, place):
    top, rows = place
    docs = spark.read.parquet(f"{top}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, top).collect()}
    assert len(got) == len(rows)
    model = language_id.learned(docs)
    mask = (1 << language_id.TRAIN_BITS) - 1
    for i, t, *_ in rows[::7] + rows[-8:]:
        data = lower(t).encode()
        grams = [b & mask for b in data] + [((a << 8 | b) + 256) & mask for a, b in zip(data, data[1:])]
        grams += [((((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> (32 - language_id.TRAIN_BITS)) & mask for a, b, c in zip(data, data[1:], data[2:])]
        r = got[i]
        assert r["held_out"] == (fold(i, 4) == 2)
        if t is None or not any(ch.isalpha() for ch in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        mean = model.weights[grams].astype(float).mean(0)
        margin = np.clip(mean * model.scale + model.shift, -30, 30)
        loss = [sum(trust * math.log1p(math.exp(-m * bit)) for m, bit, trust in zip(margin, code, model.trust)) for code in model.code.tolist()]
        share = [math.exp(min(loss) - x) for x in loss]
        best = int(np.argmin(loss))
        assert r["lang_pred"] == model.languages[best] and r["score"] == pytest.approx(share[best] / sum(share), abs=2e-3)


def test_long_codes_keep_apart():
    code = language_id.codewords(700).astype(int)
    bits = code.shape[1]
    near = (bits - (code @ code.T - 2 * bits * np.eye(700, dtype=int)).max()) // 2
    assert near > bits // 5


def test_op7_base_columns(spark, place):
    top, rows = place
    got = {r["doc_id"]: r for r in QUERIES["op7_pii"](spark, top).collect()}
    for i, t, *_ in rows:
        base = base_spans(t or "")
        shown = ",".join(f"{pii.KINDS[k]}:{lo}:{hi}" for lo, k, hi in base)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(b[1] == j for b in base) for j in range(4)]
        every = [x for x in r["spans"].split(",") if x]
        assert set(shown.split(",")) - {""} <= set(every) and len(set(every)) == len(every)


def test_pii_of_a_long_list(spark):
    """A megabyte of addresses: twenty times the time of a twentieth, not four hundred times."""
    text = " ".join(f"user{i}@mail{i}.example.com +49 30 {i:07d}" for i in range(24_000))
    rows = pii.found(spark.createDataFrame([(1, text), (2, text[:50_000])], "doc_id long, text string")).collect()
    for r in rows:
        base = [(s["lo"], s["kind"], s["hi"]) for s in r["spans"] if s["base"]]
        assert base == base_spans(text if r["doc_id"] == 1 else text[:50_000])


def test_op9_columns(spark, place):
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in QUERIES["op9_bpe"](spark, place[0]).collect()}
    for i, text, *_ in place[1]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    own, draw = bpe.BPE(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    for text in ("ab" * 20_000, "a" * 30_001, "".join(draw.choices("etaoinshrdlu", k=120_000)), "".join(draw.choices("éüßñ", k=9_000))):
        assert own.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_bpe_raises_on_other_files(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="pre_tokenizer"):
        bpe.BPE(public_tokenizers.path("word_bpe_49k.json"))


def test_op10_by_plain_arithmetic(spark, place):
    top, rows = place
    docs, labels = (spark.read.parquet(f"{top}/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, top).collect()}
    model = toxicity.fit(*toxicity.training_rows(docs, labels))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    for i, t, *_ in rows[::9] + rows[-8:]:
        (found,) = toxicity._rows([t or ""]) if t else (np.zeros(0, np.uint64),)
        z = model.intercept + sum(weight.get(f, 0.0) for f in found.tolist())
        r = got[i]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
        assert (r["held_out"], r["predicted"]) == (fold(i, 5) == 0, int(r["score"] >= 0.5))


def test_clashing_columns_are_kept(spark, place):
    docs = spark.read.parquet(f"{place[0]}/documents.parquet")
    kept = exact_dedup.keep_documents(exact_dedup.DigestIndex(spark, new_path(spark, "digests"), 4), docs)
    known = language_id.known_documents(docs, language_id.learned(docs))
    for df in (kept, known, near_dedup.keep_one(docs), mixing.interleaved(docs)):
        assert df.schema.names == docs.schema.names
        r = df.first()
        assert (r["_source"], r["digest"], r["score"], r["_mark"]) == ("mine", 1, "x", 2)
    assert mixing.mixed(docs).columns[-7:] == ["__source", "_block", "_release", "_deadline", "_slot", "_position", "_in_mix"]


def test_digest_indices_of_like_paths_and_batches(spark):
    top = new_path(spark, "indices")
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (None, "c")], "doc_id long, text string")
    one, two = exact_dedup.DigestIndex(spark, f"{top}/a-b", 4), exact_dedup.DigestIndex(spark, f"{top}/a_b", 8)
    first = sorted(map(repr, exact_dedup.add(one, docs, "first").collect()))
    assert two.table().count() == 0
    again = exact_dedup.DigestIndex(spark, f"{top}/a-b", 16)
    assert again.buckets == 4
    # A batch that is tried again gives what it gave; another one keeps nothing.
    assert sorted(map(repr, exact_dedup.add(again, docs, "first").collect())) == first
    assert not any(r["kept"] for r in exact_dedup.add(again, docs, "second").collect()) and again.table().count() == 3


def test_weights_are_exact():
    slots = mixing.frame_slots({"a": 9, "b": 9, "c": 9}, {"a": 0.0001, "b": 0.3, "c": 0.6999})
    assert slots == {"a": 1, "b": 3000, "c": 6999}
    assert mixing.frame_slots({"a": 1, "b": 1}, {"a": "1/3", "b": "2/3", "gone": 5}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError, match="denominator"):
        mixing.frame_slots({"a": 1, "b": 1}, {"a": math.pi, "b": 1})


def test_long_frame(spark):
    slots = {"a": 1, "b": 300, "c": 699}
    order = [r["source"] for r in mixing.schedule(spark, slots).orderBy("slot").collect()]
    done = dict.fromkeys(slots, 0)
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[x] - t * slots[x] / 1000) < 1 for x in slots)
    assert done == slots


def test_scores_beyond_64_bits_raise(spark):
    from geochron.llm import topk

    rows = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.quantised(rows).collect()
    big = np.array([[1 << 40, 1 << 40]])
    with pytest.raises(OverflowError):
        topk._product(big, big)
    assert topk._product(np.array([[1 << 30]]), np.array([[1 << 31]])).tolist() == [[1 << 61]]


def test_recall_of_near_duplicates(spark):
    """Links found, as components, against all pairs: by brute force over an inverted index of shingles of a thousand documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    from collections import Counter, defaultdict

    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"])) for r in docs.collect()}
    sets = {i: Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter() for i, w in texts.items()}
    df = Counter(s for x in sets.values() for s in x)
    weigh = {i: {s: n * math.log1p(len(texts) / df[s]) for s, n in x.items()} for i, x in sets.items()}
    total, holders, common = {i: sum(x.values()) for i, x in weigh.items()}, defaultdict(list), Counter()
    for i, x in weigh.items():
        for s, w in x.items():
            for j, v in holders[s]:
                common[j, i] += min(v, w)
            holders[s].append((i, w))
    links = [p for p, low in common.items() if low / (total[p[0]] + total[p[1]] - low) >= near_dedup.SIMILARITY]
    assert len(links) > 50
    assert sum(got[a] == got[b] for a, b in links) / len(links) >= 0.99
    # Nothing else is joined: every class is connected by links.
    joined, up = defaultdict(set), {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    for i, c in got.items():
        joined[c].add(root(i) if sets[i] else "empty")
    assert all(len(r) == 1 for r in joined.values())
