"""Removal of repeated substrings with suffix arrays.

A byte goes if a string of WIDTH bytes that covers it also starts in a document with a smaller doc_id.  All suffixes of a
corpus can't be sorted in one place, so strings are dealt by content: a string belongs to its anchor, the smallest hash of its 26-byte
grams, hence equal strings to equal anchors.  Neighbouring strings of one anchor make a context, a run of WIDTH to WIDTH + 24 bytes.
Anchors that two documents share are looked up across the corpus; equal contexts are taken together with the smallest document that has
them.  Contexts are told apart by two 64-bit hashes, the anchor and that of all their bytes, across the corpus; by the second alone within a block.
Where an anchor has several contexts, these are gathered and their suffixes sorted (see gsaca): suffixes that
agree in WIDTH bytes stand together and tell the smallest document their string starts in.

Documents are handled in blocks of about BLOCK_BYTES; within a block equal anchors and contexts are merged before they are shuffled,
so a passage that a third of all documents share reaches its task once a block.  Text is shuffled once, into a table bucketed by block.

Defined cases: null text counts as empty; an empty or short document loses nothing; matches don't cross documents; rows that repeat a doc_id are
one document as far as "smaller" goes, so they don't remove each other; a null doc_id is smaller than any other; an
empty table gives no rows; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gsaca import suffix_arrays
from .shared import new_path, table, written
from .textbytes import mix64, pieces, prefix_hash, span_hash, text_buffer, window_hash

WIDTH = 50
GRAM = 26
REACH = WIDTH - GRAM
BLOCK_BYTES = 8 << 20
#: Bytes of contexts whose suffixes are sorted in one go.
SORT_BYTES = 3 << 20
_NULL_ID = np.iinfo(np.int64).min


def contexts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and end byte, and row of each context, in order of place.  Every string of WIDTH bytes within a row is in the context of its anchor."""
    n = len(buf) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    least = window_hash(prefix_hash(buf), GRAM) | np.uint64(1)
    for step in (1, 2, 4, 8, 9):  # least of 2, 4, 8, 16 and 25 neighbours
        least = np.minimum(least[:-step], least[step:])
    cut = off[1:-1]
    for back in range(1, WIDTH):  # strings that run over the end of their row
        w = cut - back
        least[w[(w >= 0) & (w < n)]] = 0
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    size = np.diff(np.append(first, n))
    real = least[first] > 0
    first, size = first[real], size[real]
    # Repetitive text can have one anchor for long; such runs are cut.
    parts = -(-size // (REACH + 1))
    start = np.repeat(first, parts) + (REACH + 1) * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    end = np.minimum(start + REACH, np.repeat(first + size - 1, parts)) + WIDTH
    return least[start], start, end, np.searchsorted(off, start, "right") - 1


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(_NULL_ID))


def _pack(**cols: np.ndarray) -> dict[str, bytes]:
    return {k: np.ascontiguousarray(v).tobytes() for k, v in cols.items()}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return (((mix64(keys) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _block_texts(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, bytes and offsets of a whole block."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    t = pa.Table.from_batches(rows)
    return _ids(t["doc_id"].combine_chunks()), *text_buffer(t["text"])


_ANCHOR_ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("anchors", pa.binary()), ("many", pa.binary())])
_SHARED_ROWS = pa.schema([("block", pa.int32()), ("anchors", pa.binary())])
_CONTEXT_ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("anchors", pa.binary()), ("keys", pa.binary()), ("owners", pa.binary())])
_TEXT_ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("anchors", pa.binary()), ("keys", pa.binary()), ("owners", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])
#: owners: the smallest owner of each context (keys); masks: what of the context its owner loses, or -1 for a question.
_ANSWER_ROWS = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("masks", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int32(): 'int', pa.binary(): 'binary'})[f.type]}" for f in schema)


def _heads(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _firsts(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place where each stands, and its smallest owner."""
    order = np.argsort(keys)
    keys = keys[order]
    new = _heads(keys)
    return keys[new], order[new], np.minimum.reduceat(owners[order], new) if len(new) else owners[:0]


def _block_contexts(ids: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, key (a hash of anchor and bytes), owner, first and end byte of every context of a block."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    for lo, hi, b, o in pieces(buf, off, max_rows=1 << 30):
        gram, a, z, row = contexts(b, o)
        parts.append((gram, span_hash(prefix_hash(b), a, z), ids[lo + row], a + off[lo], z + off[lo]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _dealt(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(edges)):
        yield int(i), order[edges[i] : edges[i + 1]]


def _answers(block: np.ndarray, keys: np.ndarray, owners: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
    blocks, which = np.unique(block, return_inverse=True)
    return _batch([{"block": int(blocks[i]), **_pack(keys=keys[part], owners=owners[part], masks=masks[part].astype(np.int32))} for i, part in _dealt(which, len(blocks))], _ANSWER_ROWS)


def window_owners(data: np.ndarray, size: np.ndarray, owner: np.ndarray, string: np.ndarray) -> np.ndarray:
    """For each context a mask whose bit o is set if the WIDTH bytes from its byte o also stand in a context of a smaller owner.

    Contexts of one string (an anchor) are compared with each other; they come string by string.
    """
    mask = np.zeros(len(size), np.int64)
    begin = np.cumsum(size) - size
    # A separator after each context: its suffixes then differ from those of longer contexts.
    at = np.repeat(begin + np.arange(len(size)) - begin, size) + np.arange(len(data))
    text = np.zeros(len(data) + len(size), np.int64)
    text[at] = data.astype(np.int64) + 1
    heads = begin + np.arange(len(size))
    start = heads[np.append(True, string[1:] != string[:-1])]
    order = suffix_arrays(text, start)
    context = np.repeat(np.arange(len(size)), size + 1)[order]
    place = order - heads[context]
    whole = place + WIDTH <= size[context]
    order, context, place = order[whole], context[whole], place[whole]
    if not len(order):
        return mask
    view = np.lib.stride_tricks.sliding_window_view(text, WIDTH)
    alike = np.zeros(len(order), bool)
    for lo in range(1, len(order), 100_000):
        a = order[lo - 1 : lo - 1 + 100_000][: len(order) - lo]
        b = order[lo : lo + 100_000]
        alike[lo : lo + len(b)] = (view[a] == view[b]).all(axis=1) & (string[context[lo - 1 : lo - 1 + len(b)]] == string[context[lo : lo + len(b)]])
    group = np.flatnonzero(~alike)
    least = np.repeat(np.minimum.reduceat(owner[context], group), np.diff(np.append(group, len(order))))
    hit = least < owner[context]
    np.bitwise_or.at(mask, context[hit], np.int64(1) << place[hit])
    return mask


def trimmed(docs: DataFrame, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document (and kept, the bytes that stay, if asked)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(64, blocks // 2)
    files = max(1, min(blocks, 4096))
    name = f"substring_blocks_{uuid.uuid4().hex}"
    cut = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    cut.repartition(files, "block").write.bucketBy(files, "block").option("path", new_path(spark, "blocks")).saveAsTable(name)
    cut = spark.table(name)

    def find(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _, docs_of, _, _ = _block_contexts(*_block_texts(batches))
        order = np.argsort(keys)
        keys, docs_of = keys[order], docs_of[order]
        new = _heads(keys)
        many = np.minimum.reduceat(docs_of, new) != np.maximum.reduceat(docs_of, new) if len(new) else np.zeros(0, bool)
        keys = keys[new]
        yield _batch([{"bucket": i, "block": key[0].as_py(), **_pack(anchors=keys[part], many=many[part])} for i, part in _dealt(_buckets(keys, buckets), buckets)], _ANCHOR_ROWS)

    def share(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [(b, np.frombuffer(k, np.uint64), np.frombuffer(m, bool)) for x in batches for b, k, m in zip(x["block"].to_pylist(), x["anchors"].to_pylist(), x["many"].to_pylist())]
        every = np.sort(np.concatenate([k for _, k, _ in t]))
        shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[k[m] for _, k, m in t]]))
        out = []
        for block, keys, _ in t:
            mine = keys[np.isin(keys, shared, assume_unique=True)]
            if len(mine):
                out.append({"block": block, **_pack(anchors=mine)})
        yield _batch(out, _SHARED_ROWS)

    found = cut.groupBy("block").applyInArrow(find, _ddl(_ANCHOR_ROWS))
    shared = written(found.groupBy("bucket").applyInArrow(share, _ddl(_SHARED_ROWS)), "anchors")

    def gather(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = [np.frombuffer(k, np.uint64) for k in right["anchors"].to_pylist()]
        ids, buf, off = _block_texts(left.to_batches())
        if not wanted or not len(ids):
            return _CONTEXT_ROWS.empty_table()
        gram, keys, owner, _, _ = _block_contexts(ids, buf, off)
        some = np.flatnonzero(_in_sorted(gram, np.sort(np.concatenate(wanted))))
        keys, first, owner = _firsts(keys[some], owner[some])
        gram = gram[some][first]
        return pa.Table.from_batches([_batch([{"bucket": i, "block": key[0].as_py(), **_pack(anchors=gram[part], keys=keys[part], owners=owner[part])} for i, part in _dealt(_buckets(gram, buckets), buckets)], _CONTEXT_ROWS)])

    def decide(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tells blocks of contexts that smaller documents have too, and asks for one copy of each context of anchors with several."""
        rows = [r for b in batches for r in b.to_pylist()]
        gram, keys = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows]) for c in ("anchors", "keys"))
        owner = np.concatenate([np.frombuffer(r["owners"], np.int64) for r in rows])
        block = np.repeat([r["block"] for r in rows], [len(r["keys"]) // 8 for r in rows])
        # Equal contexts have equal anchors: both hashes must agree.
        order = np.lexsort((keys, gram))
        new = np.flatnonzero(np.append(True, (keys[order][1:] != keys[order][:-1]) | (gram[order][1:] != gram[order][:-1])))
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(owner[order], new), np.diff(np.append(new, len(order))))
        # The smallest document of each context stands for it (each block's, if rows repeat its id).  Contexts of an anchor
        # are compared unless one document is the smallest of all: it can't lose anything, and the others are told.
        one = np.flatnonzero(least == owner)
        one = one[np.argsort(gram[one])]
        new = _heads(gram[one])
        unlike = np.minimum.reduceat(owner[one], new) != np.maximum.reduceat(owner[one], new)
        ask = one[np.repeat(unlike, np.diff(np.append(new, len(one))))]
        tell = np.flatnonzero(least < owner)
        every = np.concatenate([tell, ask])
        yield _answers(block[every], keys[every], least[every], np.append(np.zeros(len(tell)), np.full(len(ask), -1)))

    def fetch(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        asked = _heard(right)
        asked = np.sort(asked[0][asked[2] < 0])
        ids, buf, off = _block_texts(left.to_batches())
        if not len(asked) or not len(ids):
            return _TEXT_ROWS.empty_table()
        gram, keys, owner, a, z = _block_contexts(ids, buf, off)
        some = np.flatnonzero(_in_sorted(keys, asked))
        keys, first, owner = _firsts(keys[some], owner[some])
        gram, a, z = gram[some][first], a[some][first], z[some][first]
        out = []
        for i, part in _dealt(_buckets(gram, buckets), buckets):
            n = (z - a)[part]
            data = buf[np.repeat(a[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            out.append({"bucket": i, "block": key[0].as_py(), **_pack(anchors=gram[part], keys=keys[part], owners=owner[part], sizes=n.astype(np.uint8), bytes=data)})
        return pa.Table.from_batches([_batch(out, _TEXT_ROWS)])

    def sort(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        gram, keys = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows]) for c in ("anchors", "keys"))
        owner = np.concatenate([np.frombuffer(r["owners"], np.int64) for r in rows])
        size = np.concatenate([np.frombuffer(r["sizes"], np.uint8) for r in rows]).astype(np.int64)
        data = np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in rows])
        block = np.repeat([r["block"] for r in rows], [len(r["keys"]) // 8 for r in rows])
        begin = np.cumsum(size) - size
        order = np.argsort(gram, kind="stable")
        string = np.cumsum(np.append(True, gram[order][1:] != gram[order][:-1])) - 1
        # Strings of like length together: they are sorted in step.
        weight = np.bincount(string, weights=size[order])
        again = np.lexsort((string, weight[string]))
        order, string = order[again], string[again]
        n = size[order]
        ends = np.append(np.flatnonzero(np.diff(string)) + 1, len(order))
        bulk, lo = np.cumsum(n), 0
        mask = np.zeros(len(order), np.int64)
        while lo < len(order):
            goal = (bulk[lo - 1] if lo else 0) + SORT_BYTES
            hi = int(ends[min(np.searchsorted(ends, max(np.searchsorted(bulk, goal), lo + 1)), len(ends) - 1)])
            part, m = order[lo:hi], n[lo:hi]
            text = data[np.repeat(begin[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            mask[lo:hi] = window_owners(text, m, owner[part], string[lo:hi])
            lo = hi
        loses = mask != 0
        yield _answers(block[order][loses], keys[order][loses], owner[order][loses], mask[loses])

    gathered = cut.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(gather, _ddl(_CONTEXT_ROWS))
    told = written(gathered.groupBy("bucket").applyInArrow(decide, _ddl(_ANSWER_ROWS)), "told")
    fetched = cut.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(fetch, _ddl(_TEXT_ROWS))
    lost = written(fetched.groupBy("bucket").applyInArrow(sort, _ddl(_ANSWER_ROWS)), "lost")
    answers = told.unionByName(lost)

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        know, own, masks = _heard(right)
        real = masks >= 0
        know, own, masks = know[real], own[real], masks[real]
        ids, buf, off = _block_texts(left.to_batches())
        _, keys, owner, a, z = _block_contexts(ids, buf, off)
        # The smallest owner of each context: here, or as heard.
        order = np.argsort(keys)
        new = _heads(keys[order])
        least = np.empty(len(keys), np.int64)
        if len(keys):
            least[order] = np.repeat(np.minimum.reduceat(owner[order], new), np.diff(np.append(new, len(keys))))
        lost = np.zeros(len(keys), np.int64)
        if len(know):
            s = np.argsort(know)
            place = np.minimum(np.searchsorted(know[s], keys), len(know) - 1)
            hit = know[s][place] == keys
            least[hit] = np.minimum(least[hit], own[s][place[hit]])
            lost[hit] = masks[s][place[hit]]
        change = np.zeros(len(buf) + 1, np.int64)
        full = np.flatnonzero(least < owner)
        np.add.at(change, a[full], 1)
        np.add.at(change, z[full], -1)
        rest = np.flatnonzero((lost != 0) & (least == owner))
        for o in range(REACH + 1):
            some = a[rest[(lost[rest] >> o) & 1 > 0]] + o
            np.add.at(change, some, 1)
            np.add.at(change, some + WIDTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        firsts = off[:-1][off[:-1] < len(buf)]
        head[firsts] = gone[firsts]
        sums, heads = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(head))
        stay = buf[~gone]
        left_at = off - sums[off]
        kept = [stay[x:y].tobytes() for x, y in zip(left_at[:-1], left_at[1:])]
        cols = [pa.array(ids, mask=ids == _NULL_ID), pa.array(np.diff(off)), pa.array(np.diff(sums[off])), pa.array(np.diff(heads[off])), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.Table.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_text, names + ["kept"] * keep_text)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return cut.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, schema)


def _heard(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in answers[c].to_pylist())]) for c, t in (("keys", np.uint64), ("owners", np.int64), ("masks", np.int32)))


def _in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trimmed(table(spark, sf_dir, "documents"))
