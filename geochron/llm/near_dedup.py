"""Near-duplicate classes by improved consistent weighted sampling.

A document is the weighted set of its shingles of five words (fewer, if it has fewer),
weight = occurrences * idf.  Idf is ln(1 + N / df), with the exact document frequency of every shingle: runs of
texts are pieces, a piece sends its distinct shingles to the segments of the hash range, and a segment adds up the counts of
its shingles and answers each piece.  No table of all shingles is held or sent to all.  Pieces travel compressed, shingles as
differences from the one before.

Each of BANDS * ROWS hash functions draws one consistent weighted sample of the set (Ioffe 2010);
the samples of a band together are a bucket.  Texts with equal weighted sets are one vertex,
known by a hash of the set, so repeated or null doc_ids don't merge different texts.
Of every bucket all members are compared with its smallest vertex; a pair is a link if its exact weighted
Jaccard similarity is at least 0.8.  With ``plain`` it is a link too if the Jaccard similarity of the occurrences, without idf, is:
what a large group of copies shares has a low idf and each one's few changes have the highest, the more so the larger the
table, so that near copies in such groups are far apart by weight.  These links have samples and buckets of their own, as many.
Links give components; then members of a bucket that
weren't linked to its smallest vertex are compared with the bucket's members in other components, but for pairs that can't
be links by their weights (and, with ``plain``, their counts) or by the triangle inequality of the Jaccard distance with the smallest vertex between them.
A bucket with many members to compare
is cut into blocks of about BLOCK members; a task compares two blocks by matrix products, without a row for each pair, and
returns only links that join components.  Classes are the components.

Defined cases: null text counts as empty; texts without words have one weighted set,
the empty one, and are copies of each other; repeated rows are copies; class_id is the
smallest doc_id of the class (null doc_ids are smaller than any and class_id is then null), so classes that share
a smallest doc_id share a class_id, but have a class_size each;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_names, passing_tables, table, written
from .textbytes import mix64, packed_counts, pieces, row_sums, text_buffer, unpacked_counts, word_hashes

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares a bucket with probability 1 - (1 - 0.8 ** 4) ** 12 = 0.998, at 0.85 with 0.9999.
BANDS, ROWS = 12, 4
#: Idf has no bound; the tests' formula reads this, and tables of fewer documents don't reach it.
RARE = 256
#: Bytes of text in a piece, and those whose shingles share a segment.
PIECE, SEGMENT = 1 << 21, 1 << 24
#: Buckets with more pairs to compare than this are compared block by block.
PAIRS, BLOCK = 2048, 192
#: Bytes of weighted sets that a block holds, about: documents may be very long.
BLOCK_BYTES = 48 << 20
#: Most bitmaps, of 32,768 bits each, that are broadcast to tell which sets are to be compared.
MAPS = 8192
_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (54-bit hashes, ascending in each row), their occurrences, and each row's offsets.  At most 1,000 rows."""
    words, at = word_hashes(buf, off)
    n = np.diff(at)
    count = np.where(n >= SHINGLE_WORDS, n - SHINGLE_WORDS + 1, np.minimum(n, 1))
    short = np.flatnonzero((n > 0) & (n < SHINGLE_WORDS))
    first = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    row = np.repeat(np.arange(len(n)), count)
    padded = np.append(words, np.zeros(SHINGLE_WORDS, np.uint64))
    h = np.zeros(len(first), np.uint64)
    for i in range(SHINGLE_WORDS):
        h = (h + padded[first + i]) * _STEP
    if len(short):
        where = (np.cumsum(count) - count)[short]
        for r, w in zip(short, where):
            v = np.uint64(0)
            for x in words[at[r] : at[r + 1]]:
                v = np.uint64(((int(v) + int(x)) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF)
            h[w] = v
    key = (row.astype(np.uint64) << np.uint64(54)) | (mix64(h) >> np.uint64(10))
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    ends = np.searchsorted(key >> np.uint64(54), np.arange(len(n) + 1))
    return key & np.uint64((1 << 54) - 1), times, ends


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each piece of the batches: the batch, first and end row, shingles, occurrences, offsets."""
    for batch in batches:
        for lo, hi, b, o in pieces(*text_buffer(batch["text"])):
            yield batch, lo, hi, *weighted_sets(b, o)


def in_pieces(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """piece (a hash of what is in it) and packed (doc_id, text and mark, a hash of the text, of a run of about PIECE bytes of text); how many documents; bits of a segment's number."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    bits = min(20, max(6, ((size or 0) // SEGMENT).bit_length()))

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for x in held:
                out.write_batch(x)
        data = sink.getvalue().to_pybytes()
        name = int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["piece", "packed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes = [], 0
        for batch in batches:
            for lo, hi, b, _ in pieces(*text_buffer(batch["text"]), PIECE, len(batch)):
                if held and held_bytes + len(b) > PIECE:
                    yield packed(held)
                    held, held_bytes = [], 0
                held.append(batch.slice(lo, hi - lo))
                held_bytes += len(b)
        if held:
            yield packed(held)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(pack, "piece long, packed binary"), n, bits


def _sets_of(table: pa.Table) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Parts of a piece as _sets gives them, the piece's distinct shingles in order, and in how many rows each stands.  Runs that are equal make one piece."""
    parts = list(_sets(b for x in table["packed"].to_pylist() for b in pa.ipc.open_stream(x)))
    distinct, times = np.unique(np.concatenate([p[3] for p in parts] or [np.zeros(0, np.uint64)]), return_counts=True)
    return parts, distinct, times


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, each in as many bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_steps(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """piece, segment, small, big: document frequencies of the distinct shingles of each piece, in order."""
    rows, _, bits = in_pieces(docs)
    return _frequencies(rows, bits)


def _frequencies(rows: DataFrame, bits: int) -> DataFrame:
    """A piece sends the shingles of each segment (the highest bits of a shingle) with its own counts; the segment sends back the sums."""
    shift = np.uint64(54 - bits)

    def ask(table: pa.Table) -> pa.Table:
        _, distinct, times = _sets_of(table)
        piece = table["piece"][0].as_py()
        at = np.searchsorted(distinct >> shift, np.arange((1 << bits) + 1).astype(np.uint64))
        out = {c: [] for c in ("piece", "segment", "keys", "small", "big")}
        for s in np.flatnonzero(at[1:] > at[:-1]).tolist():
            lo, hi = at[s], at[s + 1]
            low = distinct[lo:hi] & ((np.uint64(1) << shift) - np.uint64(1))
            for c, x in zip(out, (piece, s, _steps(low), *packed_counts(times[lo:hi]))):
                out[c].append(x)
        return pa.table(out, _ASKED)

    def answer(table: pa.Table) -> pa.Table:
        keys = [_from_steps(k, len(n)) for k, n in zip(table["keys"].to_pylist(), table["small"].to_pylist())]
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.concatenate([unpacked_counts(*x) for x in zip(table["small"].to_pylist(), table["big"].to_pylist())])
        total = np.bincount(which, weights=times).astype(np.int64)[which]
        packed = [packed_counts(x) for x in np.split(total, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table({"piece": table["piece"], "segment": table["segment"], "small": pa.array([a for a, _ in packed], pa.binary()), "big": pa.array([b for _, b in packed], pa.binary())})

    asked = rows.groupBy("piece").applyInArrow(ask, "piece long, segment long, keys binary, small binary, big binary")
    return asked.groupBy("segment").applyInArrow(answer, "piece long, segment long, small binary, big binary")


_ASKED = pa.schema([("piece", pa.int64()), ("segment", pa.int64()), ("keys", pa.binary()), ("small", pa.binary()), ("big", pa.binary())])


_tables: list[np.ndarray] = []


def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 2 ** 16 midpoints, and their logarithms."""
    if not _tables:
        q = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.where(q < 0.1, np.sqrt(2 * q), 1 - np.log1p(-q))
        for _ in range(60):  # Newton on 1 - (1 + x) exp(-x) = q
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - q) / (x * np.exp(-x)), x / 4)
        _tables.extend([x.astype(np.float32), np.log(x).astype(np.float32)])
    return _tables[0], _tables[1]


def samples(shingles: np.ndarray, weights: np.ndarray, at: np.ndarray, hashes: int = BANDS * ROWS) -> np.ndarray:
    """Consistent weighted samples (rows x hashes, uint64) of non-empty sets."""
    return samples_of(shingles, [weights], at, hashes)[0]


def samples_of(shingles: np.ndarray, weightings: list[np.ndarray], at: np.ndarray, hashes: int = BANDS * ROWS) -> list[np.ndarray]:
    """The samples by each of several weightings of the same sets, with the same draws.

    For each element r and c are drawn from Gamma(2, 1) and beta from [0, 1), all from its hash; t = floor(ln(w) / r + beta), and the
    sample is the (element, t) that minimises ln(c) - r * (t - beta + 1).
    """
    gamma, log_gamma = _gamma_tables()
    logs = [np.log(w).astype(np.float32) for w in weightings]
    outs = [np.zeros((len(at) - 1, hashes), np.uint64) for _ in weightings]
    full = np.flatnonzero(at[1:] > at[:-1])
    if not len(full):
        return outs
    begin = at[:-1][full]
    low16, unit = np.uint64(0xFFFF), np.float32(1 / 65536)
    for k in range(hashes):
        u = mix64(shingles + np.uint64(((k + 1) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF))
        r = gamma[u & low16]
        beta = ((u >> np.uint64(16)) & low16).astype(np.float32) * unit
        log_c, high = log_gamma[(u >> np.uint64(32)) & low16], u >> np.uint64(33)
        for log_w, out in zip(logs, outs):
            t = np.floor(log_w / r + beta)
            a = log_c - r * (t - beta + np.float32(1))
            # The value in the high bits, the element and t in the low ones: one minimum finds both.
            rank = ((np.clip(a, -1000, 24) + np.float32(1000)) * np.float32(1 << 21)).astype(np.uint64)
            tag = high ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1))
            out[full, k] = np.minimum.reduceat((rank << np.uint64(32)) | (tag & np.uint64(0xFFFFFFFF)), begin)
    return outs


def buckets_of(sample: np.ndarray) -> np.ndarray:
    """rows x bands, int64."""
    h = np.zeros((len(sample), BANDS), np.uint64)
    for r in range(ROWS):
        h = mix64(h * _STEP + (sample[:, r * BANDS : (r + 1) * BANDS] & np.uint64(0xFFFFFFFF)) + np.uint64(1))
    return h.view(np.int64)


def weighted(docs: DataFrame, plain: bool = False) -> DataFrame:
    """doc_id, mark, digest_a, digest_b (equal for equal weighted sets only), weight (of the whole set), buckets, and the
    set as bytes: keys, 4 a shingle, and weights, 4 a shingle unless all weigh the same.  With plain the same of the occurrences:
    count, further buckets, and times; else these are null, none, and empty."""
    rows, n, bits = in_pieces(docs)

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        parts, distinct, _ = _sets_of(table)
        answers = sorted(zip(found["segment"].to_pylist(), found["small"].to_pylist(), found["big"].to_pylist()))
        df = np.concatenate([unpacked_counts(a, b) for _, a, b in answers] or [np.zeros(0, np.int64)])
        if len(df) != len(distinct):
            raise ValueError(f"{len(df)} document frequencies for {len(distinct)} shingles")
        idf = np.log1p(n / df)
        out = []
        for batch, lo, hi, shingles, times, at in parts:
            w = idf[np.searchsorted(distinct, shingles)] * times
            h = mix64(shingles * _STEP + times.astype(np.uint64))
            a, b = row_sums(h, at), row_sums(mix64(h), at)
            s = np.hstack([buckets_of(x) for x in samples_of(shingles, [w, times.astype(np.float64)] if plain else [w], at)])
            total, count = row_sums(w, at), row_sums(times, at)
            w, times = w.astype(np.float32), times.astype(np.float32)
            short = (shingles >> np.uint64(22)).astype(np.uint32)
            keys = [short[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
            vals = [[(x[i : i + 1] if j > i and (x[i:j] == x[i]).all() else x[i:j]).tobytes() for i, j in zip(at[:-1], at[1:])] for x in ((w, times) if plain else (w,))]
            own = [pa.array(count.astype(np.float64)), pa.array(vals[1], pa.binary())] if plain else [pa.nulls(hi - lo, pa.float64()), pa.array([b""] * (hi - lo), pa.binary())]
            cols = [batch["doc_id"].slice(lo, hi - lo), batch["mark"].slice(lo, hi - lo), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(total), _lists(s), pa.array(keys, pa.binary()), pa.array(vals[0], pa.binary()), *own]
            out.append(pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "digest_a", "digest_b", "weight", "buckets", "keys", "weights", "count", "times"]))
        return pa.Table.from_batches(out)

    kinds = "doc_id long, mark long, digest_a long, digest_b long, weight double, buckets array<long>, keys binary, weights binary, count double, times binary"
    return rows.groupBy("piece").cogroup(_frequencies(rows, bits).groupBy("piece")).applyInArrow(run, kinds)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))


def _similarity(ka: bytes, wa: bytes, kb: bytes, wb: bytes) -> float:
    if not wa and not wb and (ka or kb):
        return 0.0  # not asked for
    a, b = np.frombuffer(ka, np.uint32), np.frombuffer(kb, np.uint32)
    x = np.broadcast_to(np.frombuffer(wa, np.float32), a.shape) if len(wa) == 4 else np.frombuffer(wa, np.float32)
    y = np.broadcast_to(np.frombuffer(wb, np.float32), b.shape) if len(wb) == 4 else np.frombuffer(wb, np.float32)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = a[at] == b
    common = float(np.minimum(x[at[both]], y[both]).sum())
    return common / (float(x.sum()) + float(y.sum()) - common)


def similarities(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """a, b, their exact weighted Jaccard similarity, and that of their occurrences (0 if vecs has none).  Both tables are files, so Spark can split a partition that a hot vertex fills."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch[c].to_pylist() for c in ("ka", "wa", "ta", "kb", "wb", "tb")}
            sims = [pa.array([_similarity(*x) for x in zip(*(col[c] for c in own))], pa.float64()) for own in (("ka", "wa", "kb", "wb"), ("ka", "ta", "kb", "tb"))]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *sims], ["a", "b", "sim", "alike"])

    left = vecs.toDF("a", "ka", "wa", "ta")
    right = vecs.toDF("b", "kb", "wb", "tb")
    one = written(pairs.join(left, "a"), "near-half")
    return one.join(right, "b").select("a", "b", "ka", "wa", "ta", "kb", "wb", "tb").mapInArrow(run, "a long, b long, sim double, alike double")


#: Two vertices whose similarities are measured are linked.
_LINK = f"sim >= {SIMILARITY} or alike >= {SIMILARITY}"


_PACKED = pa.schema([("band", pa.int32()), ("h", pa.int64()), ("blk", pa.int64()), ("blocks", pa.int64()), *((c, pa.binary()) for c in ("ids", "comps", "sizes", "keys", "weights", "times"))])


def _pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sets of a block in one row."""
    rows = [r for b in batches for r in b.to_pylist()]
    keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
    weights, times = ([np.broadcast_to(np.frombuffer(r[c], np.float32), k.shape) for r, k in zip(rows, keys) if r[c]] for c in ("weights", "times"))
    none = [np.zeros(0, np.float32)]
    col = lambda x, t: np.array(x, t).tobytes()
    row = {"band": rows[0]["band"], "h": rows[0]["h"], "blk": rows[0]["blk"], "blocks": rows[0]["blocks"], "ids": col([r["v"] for r in rows], np.int64), "comps": col([r["c"] for r in rows], np.int64)}
    row |= {"sizes": col([len(k) for k in keys], np.int64), "keys": np.concatenate(keys).tobytes(), "weights": np.concatenate(weights or none).tobytes(), "times": np.concatenate(times or none).tobytes()}
    yield pa.RecordBatch.from_pylist([row], schema=_PACKED)


def _compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks, or within one, that join components."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["blk"])
    join = lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in rows])
    ids, comps, sizes = join("ids", np.int64), join("comps", np.int64), join("sizes", np.int64)
    edges = []
    if (comps != comps[0]).any():
        first = len(rows[0]["ids"]) // 8
        sim = np.zeros((len(ids), len(ids)))
        for weights in (join(c, np.float32).astype(np.float64) for c in ("weights", "times")):
            if len(weights):
                common = common_weights(join("keys", np.uint32), weights, sizes)
                total = np.diag(common)
                sim = np.maximum(sim, common / (total[:, None] + total[None, :] - common))
        wanted = (sim >= SIMILARITY) & (comps[:, None] != comps[None, :]) & (np.arange(len(ids))[:, None] < np.arange(len(ids)))
        if len(rows) > 1:
            wanted[:first, :first] = wanted[first:, first:] = False
        up = {int(c): int(c) for c in comps}
        for i, j in np.argwhere(wanted).tolist():
            a, b = int(comps[i]), int(comps[j])
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            if a != b:
                up[b] = a
                edges.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    yield pa.RecordBatch.from_arrays([pa.array([int(a) for a, _ in edges], pa.int64()), pa.array([int(b) for _, b in edges], pa.int64())], ["a", "b"])


def common_weights(keys: np.ndarray, weights: np.ndarray, sizes: np.ndarray, width: int = 4096) -> np.ndarray:
    """For every two sets (back to back in keys and weights) the sum over keys of the smaller weight.

    Each weight of a key is a step above the next smaller one; a set has the steps up to its own weight, so the sum
    of the steps that two sets share is a product of matrices, taken over ``width`` steps at a time.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((weights, keys))
    k, w, row = keys[order], weights[order], row[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new_step = new_key | np.append(True, w[1:] != w[:-1])
    step = np.cumsum(new_step) - 1
    height = w[new_step] - np.where(new_key[new_step], 0, np.append(0, w[new_step][:-1]))
    bottom = np.maximum.accumulate(np.where(new_key, step, 0))
    n = step - bottom + 1
    col = np.repeat(bottom - (np.cumsum(n) - n), n) + np.arange(n.sum())
    row = np.repeat(row, n)
    out = np.zeros((len(sizes), len(sizes)))
    again = np.argsort(col, kind="stable")
    col, row = col[again], row[again]
    cut = np.searchsorted(col, np.arange(0, len(height) + width, width))
    for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])):
        x = np.zeros((len(sizes), min(width, len(height) - i * width)))
        if not x.shape[1]:
            break
        x[row[lo:hi], col[lo:hi] - i * width] = 1
        out += (x * height[i * width : i * width + x.shape[1]]) @ x.T
    return out


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """v, c: the smallest vertex of each vertex's component, by rounds of minimum labels with pointer jumping; vertices without edges are left out."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("v", "u"), "near-edges")
    label = written(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("c")), "near-labels")
    while True:
        heard = both.join(label.toDF("u", "cu"), "u").groupBy("v").agg(F.min("cu").alias("m"))
        lower = written(label.join(heard, "v").select("v", F.least("c", "m").alias("c"), F.col("c").alias("was")), "near-heard")
        jump = lower.join(lower.select(F.col("v").alias("c"), F.col("c").alias("cc")), "c", "left")
        nxt = written(jump.select("v", F.least("c", F.coalesce("cc", "c")).alias("c"), (F.least("c", F.coalesce("cc", "c")) < F.col("was")).alias("moved")), "near-labels")
        if not nxt.where("moved").limit(1).count():
            return nxt.select("v", "c")
        label = nxt.select("v", "c")


def _probably_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose v is in wanted, and about one in sixteen of the others, by a bitmap: so that few sets are shuffled to be joined.  The bitmap
    has at most MAPS * 4 KB; if that is too few bits, more rows pass."""
    maps = max(1, min(MAPS, math.ceil(wanted.count() * 16 / (1 << 15))))
    place = F.pmod("v", F.lit(maps << 15))
    slot, bit = F.shiftright(place, 15).alias("slot"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")
    bitmaps = wanted.select(slot, bit).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
    on = F.expr("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1")
    return rows.select("*", slot, bit).join(F.broadcast(bitmaps), "slot").where(on).select(*rows.columns)


def _members(docs: DataFrame, plain: bool) -> DataFrame:
    """doc_id, mark, v and c of each row: hashes of its text and weighted set, and its class.  A table; those on the way to it are deleted."""
    with passing_tables():
        return _found_members(docs, plain)


def _found_members(docs: DataFrame, plain: bool) -> DataFrame:
    spark = docs.sparkSession
    sets = written(weighted(docs, plain).withColumn("v", F.xxhash64("digest_a", "digest_b")), "near-sets")
    vertex = sets.select("v", "weight", "count", "buckets", ((3 if plain else 2) * F.octet_length("keys")).alias("bytes")).dropDuplicates(["v"])
    bucket = written(vertex.select("v", "weight", "count", F.posexplode("buckets").alias("band", "h")), "near-buckets")
    heads = bucket.groupBy("band", "h").agg(F.min(F.struct("v", "weight", "count")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = written(heads.select("band", "h", F.col("p.v").alias("p"), F.col("p.weight").alias("pw"), F.col("p.count").alias("pc")), "near-heads")
    # A set of weight x can't reach similarity s with one of weight y unless s <= x / y <= 1 / s.
    near = lambda x, y: F.coalesce(F.least(x, y) >= SIMILARITY * 0.999 * F.greatest(x, y), F.lit(False))
    shared = written(bucket.join(heads, ["band", "h"]).where("v <> p").select("band", "h", "v", "weight", "count", "p", "pw", "pc", (near(F.col("weight"), F.col("pw")) | near(F.col("count"), F.col("pc"))).alias("fits")), "near-shared")
    pairs = written(shared.where("fits").select(F.col("p").alias("a"), F.col("v").alias("b")).distinct(), "near-pairs")
    ends = pairs.select("a").union(pairs.select("b")).union(shared.select("v")).distinct().toDF("v")
    vecs = _probably_in(sets.select("v", "keys", "weights", "times"), ends := written(ends, "near-ends")).join(ends, "v")  # a semi join would be planned below the bitmap
    vecs = written(vecs.dropDuplicates(["v"]), "near-vectors")
    sims = written(similarities(pairs, vecs), "near-similarities")
    edges = sims.where(_LINK).select("a", "b")
    comp = components(spark, edges)
    # Members that aren't linked to their bucket's head, against the members of other components.  Their distances from the head,
    # where not measured, are at least what the weights say.
    shared = shared.join(sims.toDF("p", "v", "sim", "alike"), ["p", "v"], "left")
    ratios = [F.least(x, y) / F.greatest(x, y) for x, y in (("weight", "pw"), ("count", "pc"))]
    (low, high), (own_low, own_high) = [(F.coalesce(1 - F.col(c), 1 - r), F.coalesce(1 - F.col(c), F.lit(1.0))) for c, r in zip(("sim", "alike"), ratios)]
    state = shared.withColumns({"low": low, "high": high, "own_low": own_low, "own_high": own_high}).join(comp, "v", "left").withColumn("c", F.coalesce("c", "v")).join(vertex.select("v", "buckets", "bytes"), "v")
    linked = F.coalesce(F.expr(_LINK), F.lit(False)).alias("linked")
    state = written(state.select("band", "h", "v", "weight", "count", "c", "low", "high", "own_low", "own_high", "buckets", "bytes", linked), "near-state")
    size = state.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("linked"), 1)).alias("r"), F.sum("bytes").alias("bucket_bytes")).where("r > 0")
    state = state.join(written(size, "near-open"), ["band", "h"])
    large = state.where(F.col("n") * F.col("r") > PAIRS).withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bucket_bytes") / BLOCK_BYTES))).withColumn("blk", F.pmod(F.xxhash64("v"), "blocks"))
    packed = large.select("band", "h", "blocks", "blk", "v", "c").join(vecs, "v").groupBy("band", "h", "blk").applyInArrow(_pack, "band int, h long, blk long, blocks long, ids binary, comps binary, sizes binary, keys binary, weights binary, times binary")
    meet = written(packed, "near-packed").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    joined = written(meet.groupBy("band", "h", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y")).applyInArrow(_compare, "a long, b long"), "near-joined")
    state = state.where(F.col("n") * F.col("r") <= PAIRS)
    state = state.drop("bytes", "bucket_bytes")
    rest = state.where("not linked")
    names = [c for c in state.columns if c not in ("band", "h")]
    others = state.toDF(*[f"u_{c}" if c in names else c for c in state.columns])
    u = lambda c: F.col("u_" + c)
    apart = lambda low, high: F.greatest(F.col(low) - u(high), u(low) - F.col(high)) <= 1.001 * (1 - SIMILARITY)
    possible = near(F.col("weight"), u("weight")) & apart("low", "high")
    if plain:
        possible = possible | near(F.col("count"), u("count")) & apart("own_low", "own_high")
    earlier = F.exists(F.slice(F.zip_with("buckets", "u_buckets", lambda x, y: x == y), F.lit(1), F.col("band")), lambda x: x)
    worth = (F.col("c") != u("c")) & (u("linked") | (F.col("v") < u("v"))) & possible & ~earlier
    more = rest.join(others.withColumnsRenamed({"band": "u_band", "h": "u_h"}), (F.col("band") == F.col("u_band")) & (F.col("h") == F.col("u_h")) & worth)
    more = written(more.select(F.least("v", "u_v").alias("a"), F.greatest("v", "u_v").alias("b")).distinct(), "near-pairs")
    found = similarities(more, vecs).where(_LINK).select("a", "b")
    comp = written(components(spark, edges.union(found).union(joined)), "near-components")
    return written(sets.select("doc_id", "mark", "v").join(comp, "v", "left").select("doc_id", "mark", "v", F.coalesce("c", "v").alias("c")), "near-classes", keep=True)


def near_classes(docs: DataFrame, plain: bool = False) -> DataFrame:
    """doc_id, class_id, vertex_id (the smallest doc_id of those with the same weighted set), class_size."""
    members = _members(docs, plain)
    least = F.min(F.struct("doc_id"))["doc_id"]  # of structs, as min() leaves out nulls
    vertices = written(members.groupBy("v", "c").agg(least.alias("doc_id"), F.count(F.lit(1)).alias("n")), "near-vertices")
    classes = written(vertices.groupBy("c").agg(least.alias("class_id"), F.sum("n").alias("class_size")), "near-sizes")
    named = members.join(vertices.select("v", F.col("doc_id").alias("vertex_id")), "v").join(classes, "c")
    return named.select("doc_id", "class_id", "vertex_id", "class_size")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), plain=True)


def keep_one(docs: DataFrame, plain: bool = False) -> DataFrame:
    """One document of each class, the one with the smallest doc_id (null first, then by the text's hash), with all its columns and repeats."""
    row = F.struct("doc_id", "mark")
    ident, hashed = free_names(docs, "_id", "_mark")
    members = _members(docs, plain)
    kept = written(members.groupBy("c").agg(F.min(row).alias("kept")), "near-kept")
    drop = members.join(kept, "c").where(row != F.col("kept")).select(F.col("doc_id").alias(ident), F.col("mark").alias(hashed)).distinct()
    drop = written(drop, "near-drop")  # its size is known then, and texts aren't shuffled to meet few rows
    return docs.join(drop, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(hashed)), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
