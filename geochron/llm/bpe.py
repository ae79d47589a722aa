"""BPE encoding and decoding by batched numpy merge rounds.

The texts of a batch are cut into pre-tokens (by numpy too, on their code points) and
told apart by a 64-bit hash; the distinct ones not met before are merged together: their symbols stand in one flat array, each round finds the rank of
every adjacent pair by binary search over the sorted pair keys, takes the lowest rank
of each word and merges that pair wherever it stands in the word (left to right), until
no word has a known pair.  Ids equal those of the tokenizers library for byte-level BPE files
without normaliser, prefix space, dropout and post-processor.

Defined cases: null text counts as empty and gives no ids; the strings of added tokens
are found in texts first and become their one id, as the library does by default;
truncation and padding aren't used; rows are independent, so ties and repeated rows need
no rule; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .textbytes import prefix_hash, span_hash

_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Distinct pre-tokens kept between batches; beyond that the memory is started anew.
CACHE_WORDS = 1_000_000
#: Bytes of a pre-token up to which it is merged in rounds with the others.
LONG = 8192
_NO_RANK = np.int64(1) << 60


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes every byte as a printable character: itself, or, for the others in order, 256 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_LETTER, _NUMBER, _BLANK = 1, 2, 3


@functools.cache
def _kinds() -> np.ndarray:
    """Of every code point: letter, number, white space, or 0."""
    kind = np.zeros(0x110000, dtype=np.uint8)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every = "".join(map(chr, points))
    for value, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            kind[[points[i] for i in range(*m.span())]] = value
    return kind


def _check(spec: dict) -> None:
    """Raises on files that ask for more than what is done here, instead of giving other ids than the library."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = {
        "model": model.get("type", "BPE") != "BPE" or bool(model.get("dropout")) or bool(model.get("byte_fallback")) or bool(model.get("ignore_merges")) or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix")),
        "normalizer": spec.get("normalizer") is not None,
        "pre_tokenizer": before.get("type") != "ByteLevel" or bool(before.get("add_prefix_space")) or not before.get("use_regex", True),
        "decoder": (spec.get("decoder") or {}).get("type") != "ByteLevel",
        "added_tokens": any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") and spec.get("normalizer") for t in spec["added_tokens"]),
    }
    if any(odd.values()):
        raise ValueError(f"not done for byte-level BPE files of this kind: {[k for k, v in odd.items() if v]}")


class BPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        vocab, alphabet = spec["model"]["vocab"], _byte_alphabet()
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.added = {}
        for t in spec["added_tokens"]:
            self.added[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        self.added_bytes = {s.encode(): i for s, i in self.added.items()}
        self.added_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.first = np.array([vocab[c] for c, b in sorted(alphabet.items(), key=lambda x: x[1])], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right, whole = (np.array([vocab[x] for x in col], dtype=np.int64) for col in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order.astype(np.int64), whole
        # The decimal form of every id with a comma, and the bytes it stands for, each in one flat array.
        self.text = _Flat([b"%d," % i for i in range(self.size)])
        self.token = _Flat(self.bytes_of)
        self.table: dict[int, int] | None = None
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.ids = _Growing(np.int32)
        self.begins = _Growing(np.int64)
        self.counts = _Growing(np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NO_RANK)

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's begin (one more than words).  data: the words' bytes back to back.

        A round costs the length of the words in it, and a long word may need as many rounds as it has kinds of pairs: those over LONG bytes go by a queue.
        """
        long = np.flatnonzero(sizes > LONG)
        if not len(long):
            return self._merge_rounds(data, sizes)
        start = np.cumsum(sizes) - sizes
        rest = np.flatnonzero(sizes <= LONG)
        ids, at = self._merge_rounds(data[spread(start[rest], sizes[rest])], sizes[rest])
        parts: list[np.ndarray] = [None] * len(sizes)  # type: ignore[list-item]
        for i, lo, hi in zip(rest.tolist(), at[:-1].tolist(), at[1:].tolist()):
            parts[i] = ids[lo:hi]
        for i in long.tolist():
            parts[i] = self._merge_long(data[start[i] : start[i] + sizes[i]])
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))

    def _merge_long(self, data: np.ndarray) -> np.ndarray:
        """Of one word: pairs from a queue, lowest rank first and then leftmost."""
        symbol = self.first[data].tolist()
        n = len(symbol)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks = self._ranks(self.first[data[:-1]], self.first[data[1:]])
        known = np.flatnonzero(ranks < _NO_RANK)
        queue = list(zip(ranks[known].tolist(), known.tolist(), self.first[data[:-1]][known].tolist(), self.first[data[1:]][known].tolist()))
        heapq.heapify(queue)
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), self.rank_of.tolist()))
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one of them has been merged with another since
            symbol[i], symbol[j], after[i] = int(self.made[rank]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (r := self.table.get(symbol[x] * self.size + symbol[after[x]])) is not None:
                    heapq.heappush(queue, (r, x, symbol[x], symbol[after[x]]))
        return np.array([s for s in symbol if s >= 0], np.int64)

    def _merge_rounds(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = self.first[data]
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_symbol, done_word = [], []
        rank = np.full(len(symbol), _NO_RANK)
        rank[:-1] = np.where(word[:-1] == word[1:], self._ranks(symbol[:-1], symbol[1:]), _NO_RANK)
        while len(symbol):
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(word))))
            live = low < _NO_RANK
            if not live.all():
                done_symbol.append(symbol[~live])
                done_word.append(word[~live])
                symbol, word, rank, low = symbol[live], word[live], rank[live], low[live]
                if not len(symbol):
                    break
            # In a run of adjacent hits (a pair of equal symbols) only every other one merges, from the left.
            where = np.flatnonzero(rank == low)
            fresh = np.flatnonzero(np.append(True, np.diff(where) > 1))
            place = np.arange(len(where)) - np.repeat(fresh, np.diff(np.append(fresh, len(where))))
            where = where[place % 2 == 0]
            symbol[where] = self.made[rank[where]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[where + 1] = False
            now = where - np.arange(len(where))
            symbol, word, rank = symbol[stay], word[stay], rank[stay]
            # Only the pairs on both sides of a merged symbol have changed.
            look = np.concatenate([now, now[now > 0] - 1])
            rank[look] = _NO_RANK
            look = look[look + 1 < len(symbol)]
            look = look[word[look] == word[look + 1]]
            rank[look] = self._ranks(symbol[look], symbol[look + 1])
        if not done_symbol:
            return np.zeros(0, np.int64), np.zeros(len(sizes) + 1, np.int64)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.append(0, np.cumsum(np.bincount(word, minlength=len(sizes))))

    def starts_of(self, point: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where pre-tokens start among the code points of segments that begin at ``at``; a segment in ``whole`` is one token.

        The pattern takes contractions first, then a run of letters, of numbers or of other characters with the one space before
        it, then white space but for its last character if something follows, then white space.
        """
        kind = _kinds()[point]
        start = np.zeros(len(point) + 1, dtype=bool)
        start[1:-1] = kind[1:] != kind[:-1]
        first = np.zeros(len(point) + 1, dtype=bool)
        first[at] = True
        start |= first
        after_space = np.flatnonzero((kind[1:] != _BLANK) & (kind[:-1] == _BLANK) & ~first[1:-1]) + 1
        start[after_space - 1] = True
        start[after_space[point[after_space - 1] == 32]] = False
        quote = np.flatnonzero((point == 39) & start[:-1])
        if len(quote):
            end = np.append(at, len(point))[np.searchsorted(at, quote, "right")]
            a = np.where(quote + 1 < end, point[np.minimum(quote + 1, len(point) - 1)], 0)
            b = np.where(quote + 2 < end, point[np.minimum(quote + 2, len(point) - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            start[quote[one | two] + 1] = False
            start[quote[one] + 2] = True
            start[quote[two] + 3] = True
        for i in whole:
            start[at[i] + 1 : at[i + 1] if i + 1 < len(at) else len(point)] = False
        return np.flatnonzero(start[:-1])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin (one more than texts)."""
        segments, owner, whole = texts, np.arange(len(texts)), []
        if self.added_pattern is not None and any(self.added_pattern.search(t) for t in texts):
            segments, owner = [], []
            for i, t in enumerate(texts):
                last = 0
                for m in self.added_pattern.finditer(t):
                    whole.append(len(segments) + 1)
                    segments += [t[last : m.start()], m[0]]
                    owner += [i, i]
                    last = m.end()
                segments.append(t[last:])
                owner.append(i)
        joined = "".join(segments)
        point = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        if not len(point):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        full = np.flatnonzero(sizes)
        at = (np.cumsum(sizes) - sizes)[full]
        start = self.starts_of(point, at, np.searchsorted(full, np.array([w for w in whole], dtype=np.int64)).tolist())
        text_of = np.asarray(owner)[full][np.searchsorted(at, start, "right") - 1]
        data = np.frombuffer(joined.encode(), dtype=np.uint8)
        if len(data) == len(point):
            lo = start
        else:
            width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
            lo = (np.cumsum(width) - width)[start]
        hi = np.append(lo[1:], len(data))
        key, some, inverse = np.unique(span_hash(prefix_hash(data), lo, hi), return_index=True, return_inverse=True)
        index = self.known.find(key)
        new = np.flatnonzero(index < 0)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.forget()
            new = np.arange(len(key))
        if len(new):
            index[new] = self._learn(key[new], data, lo[some[new]], hi[some[new]], bool(whole))
        index = index[inverse]
        n = self.counts.all()[index].astype(np.int64)
        ids = self.ids.all()[spread(self.begins.all()[index], n)].astype(np.int64)
        per_text = np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64)
        return ids, np.append(0, np.cumsum(per_text))

    def _learn(self, keys: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, special: bool) -> np.ndarray:
        """Keeps the ids of pre-tokens under their hashes, which ascend; their numbers."""
        number, added = np.full(len(keys), -1, np.int64), []
        if special:
            longest = max(map(len, self.added))
            for i in np.flatnonzero(hi - lo <= 4 * longest).tolist():
                word = data[lo[i] : hi[i]].tobytes()
                if word in self.added_bytes:
                    number[i] = self.counts.size + len(added)
                    added.append(self.added_bytes[word])
        self._keep(np.array(added, dtype=np.int64), np.arange(len(added) + 1))
        rest = np.flatnonzero(number < 0)
        number[rest] = self.counts.size + np.arange(len(rest))
        sizes = (hi - lo)[rest]
        self._keep(*self.merge(data[spread(lo[rest], sizes)], sizes))
        self.known.add(keys, number)
        return number

    def _keep(self, ids: np.ndarray, at: np.ndarray) -> None:
        self.begins.add(at[:-1] + self.ids.size)
        self.counts.add(np.diff(at))
        self.ids.add(ids)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return self.token.join(ids)[0].tobytes().decode("utf-8", errors="replace")


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... n[0] of them, then the same for start[1] and so on."""
    end = np.cumsum(n)
    return np.repeat(start - (end - n), n) + np.arange(end[-1] if len(end) else 0)


class _Flat:
    """Byte strings by number, back to back."""

    def __init__(self, parts: list[bytes]):
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of these numbers back to back, and where each begins (one more than numbers)."""
        n = self.lengths[numbers]
        return self.bytes[spread(self.starts[numbers], n)], np.append(0, np.cumsum(n))


class _Numbers:
    """Numbers of hashes, found by binary search.  New ones go to a small level, which joins the large one once it is an eighth of it."""

    def __init__(self):
        self.large = self.small = (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    def __len__(self) -> int:
        return len(self.large[0]) + len(self.small[0])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        for known, number in (self.large, self.small):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = number[at[hit]]
        return out

    def add(self, keys: np.ndarray, number: np.ndarray) -> None:
        """Ascending keys that aren't there yet."""
        self.small = _inserted(self.small, (keys, number))
        if 8 * len(self.small[0]) > len(self.large[0]):
            self.large = _inserted(self.large, self.small)
            self.small = (self.small[0][:0].copy(), self.small[1][:0].copy())


def _inserted(into: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(into[0], rows[0])
    return np.insert(into[0], at, rows[0]), np.insert(into[1], at, rows[1])


class _Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(max(len(self.data) // 2, len(more)), self.data.dtype)])
        self.data[self.size : self.size + len(more)] = more
        self.size += len(more)

    def all(self) -> np.ndarray:
        return self.data[: self.size]


_loaded: dict[str, BPE] = {}


def _rows(batches: Iterator[pa.RecordBatch], spec: str, path: str | None, more: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    if spec not in _loaded:
        _loaded[spec] = BPE(path or _path_of(spec))
    bpe = _loaded[spec]
    for batch in batches:
        for lo in range(0, len(batch), 200):
            part = batch.slice(lo, 200)
            ids, at = bpe.encode_batch([t or "" for t in part["text"].to_pylist()])
            shown, shown_at = bpe.text.join(ids)
            back, back_at = bpe.token.join(ids)
            n, ids_sha, text_sha = np.diff(at), [], []
            for i in range(len(part)):
                a, b = at[i], at[i + 1]
                ids_sha.append(hashlib.sha256(shown[shown_at[a] : max(shown_at[a], shown_at[b] - 1)].tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(back[back_at[a] : back_at[b]].tobytes().decode("utf-8", errors="replace").encode()).hexdigest())
            cols = [part["doc_id"], pa.array(n), pa.array(ids_sha), pa.array(text_sha), *[part[c] for c in more]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *more])


def _path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, name: str = "byte_bpe_50k.json", path: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, and its columns named in more.  name: of a public tokenizer; path: of another file, on every machine."""
    rows = docs.select("doc_id", "text", *more)
    schema = ", ".join([_SCHEMA, *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in more]])
    return rows.mapInArrow(lambda batches: _rows(batches, path or name, path, more), schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
