"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the distinct words of a text and their first bytes.  Besides the
usual ridge it pays for every labelled text that names a group: the text is read again with
each identity term swapped for another, and the squared change of the score is penalised.
Short neutral mentions of every term are swapped in the same way, so a term that the
labelled texts hold only in toxic company can't raise the score of a neutral mention.

Fitting reads at most ``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` other labelled texts, chosen by
hash, and keeps at most ``MAX_FEATURES`` features; scores are of whole texts.

Defined cases: null text counts as empty; an empty text, or one without known features,
scores the model's intercept; rows that repeat a doc_id train once, by the text that
sorts first; rows without a label, or with a null one, don't train; without rows of both labels
every score is the share of toxic labels (0 without any); only features of at least ``LEAST_ROWS`` texts whose rates differ by ``LEAST_Z`` standard errors count, so
with very few labelled rows the score is that share too; repeated rows and ties are
scored alike; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold_of, table
from .textbytes import LETTER, LOWER, pieces, prefix_hash, runs, span_hash, text_buffer

TRAIN_TOXIC, TRAIN_CLEAN, MAX_FEATURES = 3000, 6000, 2000
LEAST_ROWS, LEAST_Z = 6, 6.0
#: Terms that name a group of people; within a group of terms one can stand for another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)
NEUTRAL = ("{} people live here", "my neighbour is {}", "a group of {} met today")
_PREFIXES = (4, 5, 6)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (runs of letters) and of their first 4, 5 and 6 bytes, and each row's offsets."""
    low = LOWER[buf]
    start, end, at = runs(LETTER[low], off)
    sums = prefix_hash(low)
    cols = [span_hash(sums, start, end)] + [span_hash(sums, start, np.minimum(end, start + n)) ^ np.uint64(0x5851F42D4C957F2D * n % (1 << 64)) for n in _PREFIXES]
    return np.stack(cols, axis=1).ravel() if len(start) else np.zeros(0, np.uint64), at * len(cols)


def distinct_features(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    found, at = features(buf, off)
    return [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:])]


def swapped(text: str) -> str | None:
    """The text with every identity term replaced by the next of its group; None if it has none."""
    following = {t: g[(i + 1) % len(g)] for g in IDENTITY_TERMS for i, t in enumerate(g)}
    pattern = _term_pattern()
    out = pattern.sub(lambda m: following[m[0].lower()], text)
    return None if out == text else out


def _term_pattern():
    terms = sorted({t for g in IDENTITY_TERMS for t in g}, key=len, reverse=True)
    return regex.compile(r"(?<!\p{L})(?:" + "|".join(terms) + r")(?!\p{L})", regex.IGNORECASE)


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    intercept: float
    seen: np.ndarray  # by the first 20 bits of a hash: may it be a key?

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        found, at = features(buf, off)
        row_of = np.repeat(np.arange(len(off) - 1), np.diff(at))
        hit = np.flatnonzero(self.seen[found >> np.uint64(44)]) if len(self.keys) else np.zeros(0, np.int64)
        place = np.searchsorted(self.keys, found[hit])
        ok = place < len(self.keys)
        ok[ok] = self.keys[place[ok]] == found[hit[ok]]
        pairs = np.unique(row_of[hit[ok]] * max(1, len(self.keys)) + place[ok])  # a feature counts once a text
        z = self.intercept + np.bincount(pairs // max(1, len(self.keys)), weights=self.weights[pairs % max(1, len(self.keys))] if len(pairs) else None, minlength=len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _model(keys: np.ndarray, weights: np.ndarray, intercept: float) -> Model:
    seen = np.zeros(1 << 20, dtype=bool)
    seen[keys >> np.uint64(44)] = True
    return Model(keys, weights, intercept, seen)


def _rows(texts: list[str]) -> list[np.ndarray]:
    buf, off = text_buffer(pa.array(texts, pa.large_string()))
    return [r for _, _, b, o in pieces(buf, off, 1 << 18) for r in distinct_features(b, o)]


def _dense(rows: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(keys)), np.float32)
    for i, r in enumerate(rows):
        if len(keys) and len(r):
            at = np.minimum(np.searchsorted(keys, r), len(keys) - 1)
            x[i, at[keys[at] == r]] = 1
    return x


def _changes(pairs: list[tuple[str, str]], keys: np.ndarray, block: int = 256) -> np.ndarray:
    """The distinct changes of the features from a text to its swapped twin, taken block by block, so that few dense rows are held at once."""
    found = np.zeros((0, len(keys)), np.float32)
    for i in range(0, len(pairs), block):
        some = pairs[i : i + block]
        change = _dense(_rows([b for _, b in some]), keys)
        np.subtract(_dense(_rows([a for a, _ in some]), keys), change, out=change)
        found = np.unique(np.vstack([found, change[change.any(1)]]), axis=0)  # an unchanged row costs nothing
    return found


def fit(texts: list[str], labels: list[int], toxic_share: float, ridge: float = 0.5, counterfactual: float = 4.0, steps: int = 120) -> Model:
    """toxic_share: of all labelled rows, which the sample need not have."""
    y = np.array(labels, dtype=np.float64)
    empty = np.zeros(0, np.uint64)
    if not len(y) or y.min() == y.max():
        p = min(max(toxic_share, 1e-9), 1 - 1e-9)
        return _model(empty, np.zeros(0), float(np.log(p / (1 - p))))
    rows = _rows(texts)
    (some, n_some), (others, n_others) = (np.unique(np.concatenate([r for r, t in zip(rows, y) if t == side]), return_counts=True) for side in (1, 0))
    keys = np.union1d(some, others)
    pos, neg = np.zeros(len(keys)), np.zeros(len(keys))
    pos[np.searchsorted(keys, some)], neg[np.searchsorted(keys, others)] = n_some, n_others
    # Features whose rates among toxic and other texts differ most, in standard errors.
    p, q = pos / y.sum(), neg / (1 - y).sum()
    both = (pos + neg) / len(y)
    z = (p - q) / np.sqrt(both * (1 - both) * (1 / y.sum() + 1 / (1 - y).sum()) + 1e-12)
    good = np.flatnonzero((pos + neg >= LEAST_ROWS) & (np.abs(z) > LEAST_Z))
    good = good[np.argsort(-np.abs(z[good]), kind="stable")[:MAX_FEATURES]]
    pairs = [(t, s) for t in texts if (s := swapped(t)) is not None]
    pairs += [(n.format(a), n.format(b)) for n in NEUTRAL for g in IDENTITY_TERMS for a, b in zip(g, g[1:] + g[:1])]
    keys = np.sort(keys[good])
    del some, n_some, others, n_others, pos, neg, both, p, q, z, good
    x = _dense(rows, keys)
    del rows
    change = _changes(pairs, keys)
    # Weights make up for the sample's share of toxic texts, which isn't the table's.
    share = min(max(toxic_share, 1e-6), 1 - 1e-6)
    case = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, b = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    scale = 1 / (0.25 * x.sum(0) + ridge + counterfactual * 2 * (change**2).sum(0) * max(1, np.abs(change).sum(1).max(initial=1)))
    speed, vw, vb = 0.9, np.zeros_like(w), 0.0
    for _ in range(steps):  # gradient steps with momentum, each weight at a pace of its own
        err = (case * (1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30))) - y)).astype(np.float32)
        vw = speed * vw - scale * (x.T @ err + ridge * w + 2 * counterfactual * (change.T @ (change @ w.astype(np.float32))))
        vb = speed * vb - err.sum() / (0.25 * len(y)) * 0.1
        w, b = w + 0.25 * vw, b + vb
    return _model(keys, w, float(b))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int], float]:
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(fold_of("doc_id", 5) != 0)
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    if not total:
        return [], [], 0.0
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    bound = F.when(F.col("toxic") == 1, min(1.0, TRAIN_TOXIC / max(1, n.get(1, 0)))).otherwise(min(1.0, TRAIN_CLEAN / max(1, n.get(0, 0))))
    drawn = marks.where(draw < bound)
    # Limits make the expected size a sure one: this side is at most TRAIN_TOXIC + TRAIN_CLEAN ids, so texts needn't be shuffled to meet it.
    picks = [drawn.where(c).orderBy(draw, "doc_id").limit(n) for c, n in ((F.col("toxic") == 1, TRAIN_TOXIC), (F.col("toxic") != 1, TRAIN_CLEAN))]
    few = F.broadcast(picks[0].unionAll(picks[1]))
    rows = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toArrow()
    return [t or "" for t in rows["text"].to_pylist()], rows["toxic"].to_pylist(), n.get(1, 0) / total


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of each document, from its text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch["text"])
            score = np.concatenate([held.value.score(b, o) for _, _, b, o in pieces(buf, off, 1 << 18)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(*training_rows(docs, table(spark, sf_dir, "labels")))
    return scored(docs, model).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
