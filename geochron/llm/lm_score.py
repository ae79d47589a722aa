"""Language-model scoring with a log-frequency Bloom filter.

Counts of token pairs go into a Bloom filter (Talbot & Osborne 2007): a pair whose count is
quantised to level q = 1 + floor(log2(count)) is entered as the q items (pair, 1) .. (pair, q),
so its level is read back by probing (pair, 1), (pair, 2), ... until one is missing.
A pair isn't probed unless both of its tokens are known, and its count is held to that of either token.
The count behind a level is the middle of what it stands for.  The probability of a token is

    (count(before, token) + MU * base(token)) / (count(before) + MU),

where base is the additively smoothed share of the token; base probabilities and token counts are exact.

Token counts and filter are cut into segments by hash, and the texts are dealt to pieces.  A piece sends each segment the
distinct tokens and pairs that fall into it, with their counts in the texts to learn from; the segment adds them up, makes its
part of the filter, and answers each piece with the counts and levels of what it asked for.  So texts are read twice however large the
model is, and no task holds more of it than a segment.

Tokens: A-Z lower-cased words, and one end a text.  Null text counts as empty, which is the end
alone.  Rows without doc_id hash as the empty text; repeated rows all count and score alike; with
nothing to learn from, every base probability is 1 / (V + 1) with V = 0; an empty table gives no rows; further columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold_of, table
from .textbytes import mix64, packed_counts, pieces, row_sums, text_buffer, unpacked_counts, word_hashes

ADD, MU = 0.1, 3.0
#: Bits of the filter for each item in it, and probes for each item: a false item turns up with probability 0.8 %.
ITEM_BITS, PROBES = 10, 5
#: Bytes of text in a piece (less in tables under 64 pieces, for tasks of like size), and those whose tokens and pairs share a segment.
PIECE, SEGMENT = 16 << 20, 24 << 20
_END = np.uint64(0x2545F4914F6CDD1D)
_BEGIN = np.uint64(0x9E6C63D0876A9A47)
#: Pairs go by the upper 48 bits of their hash.
_PAIR_BITS = ~np.uint64(0xFFFF)


def tokens_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row's offsets, and the hash of the token before each (a row begins after _BEGIN)."""
    words, at = word_hashes(buf, off)
    rows = len(off) - 1
    ends = at[1:] + np.arange(1, rows + 1) - 1  # where each row's end stands
    token = np.empty(len(words) + rows, np.uint64)
    is_word = np.ones(len(token), bool)
    is_word[ends] = False
    token[is_word] = words
    token[ends] = _END
    start = np.append(0, ends + 1)
    before = np.append(_BEGIN, token[:-1]) if len(token) else token
    before[start[:-1]] = _BEGIN
    return token, start, before


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + token) & _PAIR_BITS


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)), exact for whole numbers."""
    return np.frexp(counts.astype(np.float64))[1]


def level_count(level: np.ndarray) -> np.ndarray:
    """The middle of 2 ** (level - 1) .. 2 ** level - 1; 0 for level 0."""
    return np.where(level > 0, (1.5 * 2.0 ** (level - 1) - 0.5), 0.0)


def _probe(key: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    h = mix64(key + np.uint64((level * 0xA24BAED4963EE407 + probe * 0x9FB21C651E98DF25) & 0xFFFFFFFFFFFFFFFF))
    return ((h >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)


class Filter:
    """A log-frequency Bloom filter of one segment's pairs."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.bytes = np.zeros((bits + 7) // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Filter:
        level = levels(counts)
        out = cls(max(64, int(level.sum()) * ITEM_BITS))
        on = np.zeros(out.bits, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            some = keys[level >= q]
            for p in range(PROBES):
                on[_probe(some, q, p, out.bits).astype(np.int64)] = True
        out.bytes = np.packbits(on, bitorder="little")
        return out

    def level(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        q = 0
        while len(left):
            q += 1
            for p in range(PROBES):
                at = _probe(keys[left], q, p, self.bits)
                left = left[(self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                if not len(left):
                    break
            out[left] = q
        return out


class Segment:
    """Exact counts of the tokens, and the filter of the pairs, whose hash falls into it."""

    def __init__(self, keys: bytes, counts: bytes, bits: int, data: bytes):
        self.keys, self.counts, self.filter = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64), Filter(bits, data)

    def count(self, token: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(token), np.int64)
        at = np.minimum(np.searchsorted(self.keys, token), len(self.keys) - 1)
        return np.where(self.keys[at] == token, self.counts[at], 0)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(keys) else counts


_ASKED = pa.schema([("piece", pa.int64()), ("segment", pa.int64()), *((c, pa.binary()) for c in ("tokens", "small", "big", "pairs", "pair_small", "pair_big"))])
_ANSWER = "piece long, segment long, small binary, big binary, levels binary, n long, v long"


def in_pieces(docs: DataFrame, held_out: Column, segments: int | None = None) -> tuple[DataFrame, int]:
    """doc_id, text, held (not to learn from) and piece (by a hash of the row); the number of segments."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    piece = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + max(size // PIECE, min(63, size >> 20))))
    return docs.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held"), piece.alias("piece")), segments or max(12, 1 + size // SEGMENT)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens_of the whole piece."""
    parts = [tokens_of(b, o) for _, _, b, o in pieces(*text_buffer(table["text"]))]
    start = np.cumsum(np.concatenate([[0], *(np.diff(p[1]) for p in parts)]))
    return np.concatenate([p[0] for p in parts]), start, np.concatenate([p[2] for p in parts])


def _asked(rows: DataFrame, segments: int) -> DataFrame:
    """A row for each piece and segment: the piece's distinct tokens and pairs there, in order, and how often they are to be learned."""

    def ask(table: pa.Table) -> pa.Table:
        token, start, before = _tokens(table)
        learn = 1 - table["held"].combine_chunks().cast(pa.int64()).to_numpy()
        # What comes before a text's first token counts as a token of its own, so that counts of histories are whole.
        times = np.repeat(learn, np.diff(start))
        k, n = _sums(np.append(token, _BEGIN), np.append(times, learn.sum()))
        p, m = _sums(pair_key(before, token), times)
        at, to = (np.searchsorted(segment_of(x, segments), np.arange(segments + 1)) for x in (k, p))
        six = p.view(np.uint8).reshape(-1, 8)[:, 2:]
        piece = table["piece"][0].as_py()
        rows = [(piece, s, k[at[s] : at[s + 1]].tobytes(), *packed_counts(n[at[s] : at[s + 1]]), six[to[s] : to[s + 1]].tobytes(), *packed_counts(m[to[s] : to[s + 1]])) for s in range(segments)]
        return pa.table(list(map(pa.array, zip(*rows), _ASKED.types)), _ASKED)

    kinds = "piece long, segment long, tokens binary, small binary, big binary, pairs binary, pair_small binary, pair_big binary"
    return rows.groupBy("piece").applyInArrow(ask, kinds)


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]:
    """Tokens, their counts, pairs, their counts of a segment's rows; how many tokens and pairs each row has."""
    col = {c: table[c].to_pylist() for c in table.column_names}
    counts = [np.concatenate([unpacked_counts(a, b) for a, b in zip(col[x], col[y])]) for x, y in (("small", "big"), ("pair_small", "pair_big"))]
    pairs = np.zeros((len(counts[1]), 8), np.uint8)
    pairs[:, 2:] = np.frombuffer(b"".join(col["pairs"]), np.uint8).reshape(-1, 6)
    return np.frombuffer(b"".join(col["tokens"]), np.uint64), counts[0], pairs.view(np.uint64).ravel(), counts[1], [len(x) for x in col["small"]], [len(x) for x in col["pair_small"]]


def _built(token: np.ndarray, times: np.ndarray, pair: np.ndarray, pair_times: np.ndarray) -> tuple[Segment, int, int]:
    """A segment, its tokens' occurrences, and how many tokens it has."""
    k, c = _sums(token, times)
    k, c = k[c > 0], c[c > 0]
    f = Filter.of(*_sums(pair, pair_times))
    real = k != _BEGIN
    return Segment(k.tobytes(), c.tobytes(), f.bits, f.bytes.tobytes()), int(c[real].sum()), int(real.sum())


def _answered(table: pa.Table, built: tuple[Segment, int, int] | None) -> pa.Table:
    """What a segment, or one made of what it is asked, answers to each piece."""
    token, times, pair, pair_times, tokens, pairs = _arrays(table)
    segment, n, v = built or _built(token, times, pair, pair_times)
    every, place = np.unique(pair, return_inverse=True)
    level = segment.filter.level(every).astype(np.uint8)[place]
    packed = [packed_counts(x) for x in np.split(segment.count(token), np.cumsum(tokens)[:-1])]
    levels_of = [x.tobytes() for x in np.split(level, np.cumsum(pairs)[:-1])]
    cols = [pa.array([a for a, _ in packed], pa.binary()), pa.array([b for _, b in packed], pa.binary()), pa.array(levels_of, pa.binary()), *(pa.array([x] * len(table), pa.int64()) for x in (n, v))]
    return pa.table([table["piece"], table["segment"], *cols], ["piece", "segment", "small", "big", "levels", "n", "v"])


def learned(docs: DataFrame, segments: int | None = None) -> DataFrame:
    """One row a segment: its number, tokens, their counts, and the filter; n: its tokens' occurrences, v: how many tokens."""
    rows, segments = in_pieces(docs, F.lit(False), segments)

    def build(table: pa.Table) -> pa.Table:
        s, n, v = _built(*_arrays(table)[:4])
        row = {"segment": table["segment"][0].as_py(), "keys": s.keys.tobytes(), "counts": s.counts.tobytes(), "bits": s.filter.bits, "filter": s.filter.bytes.tobytes(), "n": n, "v": v}
        return pa.table({k: pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for k, x in row.items()})

    return _asked(rows, segments).groupBy("segment").applyInArrow(build, "segment long, keys binary, counts binary, bits long, filter binary, n long, v long")


def scored(docs: DataFrame, model: DataFrame, segments: int) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score.  model: learned() with as many segments, as a written table."""

    def answer(table: pa.Table, own: pa.Table) -> pa.Table:
        r = (own.to_pylist() or [{"keys": b"", "counts": b"", "bits": 64, "filter": bytes(8), "n": 0, "v": 0}])[0]
        built = Segment(r["keys"], r["counts"], r["bits"], r["filter"]), r["n"], r["v"]
        return _answered(table, built) if len(table) else pa.table({c: pa.array([], t) for c, t in zip(("piece", "segment", "small", "big", "levels", "n", "v"), (pa.int64(),) * 2 + (pa.binary(),) * 3 + (pa.int64(),) * 2)})

    rows, segments = in_pieces(docs, F.lit(True), segments)
    return _scores(rows, _asked(rows, segments).groupBy("segment").cogroup(model.groupBy("segment")).applyInArrow(answer, _ANSWER))


def _scores(rows: DataFrame, answers: DataFrame) -> DataFrame:
    def score(table: pa.Table, found: pa.Table) -> pa.Table:
        answer = sorted(found.to_pylist(), key=lambda r: r["segment"])
        total, kinds = sum(r["n"] for r in answer), sum(r["v"] for r in answer)
        token, start, before = _tokens(table)
        known = np.concatenate([unpacked_counts(r["small"], r["big"]) for r in answer])
        every, place = np.unique(np.append(token, _BEGIN), return_inverse=True)
        pair, pair_place = np.unique(pair_key(before, token), return_inverse=True)
        level = np.frombuffer(b"".join(r["levels"] for r in answer), np.uint8)
        if (len(known), len(level)) != (len(every), len(pair)):
            raise ValueError(f"{len(known)} counts for {len(every)} tokens, {len(level)} levels for {len(pair)} pairs")
        begin, place = place[-1], place[:-1]
        at = np.append(begin, place[:-1])
        at[start[:-1]] = begin
        c, h = known[place], known[at]
        base = (c + ADD) / (total + ADD * (kinds + 1))
        of_pair = np.where((c > 0) & (h > 0), level.astype(np.int64)[pair_place], 0)
        p = (np.minimum(level_count(of_pair), np.minimum(c, h)) + MU * base) / (h + MU)
        cols = [np.diff(start), row_sums((c > 0).astype(np.int64), start), np.full(len(table), total, np.int64), row_sums(np.log10(base), start), row_sums(np.log10(p), start)]
        return pa.table([table["doc_id"], *map(pa.array, cols)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(score, schema)


def score_corpus(docs: DataFrame, held_out: Column, segments: int | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    """Learns from the rows that aren't held out and scores all.  Nothing is broadcast: broadcast_bytes, which callers may still give, changes nothing."""
    rows, segments = in_pieces(docs, held_out, segments)
    return _scores(rows, _asked(rows, segments).groupBy("segment").applyInArrow(lambda table: _answered(table, None), _ANSWER))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score_corpus(docs, fold_of("doc_id", 10) == 0)
    return rows.select("doc_id", (fold_of("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
