"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary classifier over hashed
byte n-grams (1 to 3 bytes of the lower-cased text; naive Bayes weights, calibrated
by logistic regression) tells which languages' side a text is on.  Decoding weighs each
bit's logistic loss by how well that bit did in training, takes the nearest codeword and
flags a text as ambiguous when the second nearest is almost as near.

Training reads at most ``TRAIN_DOCS`` texts, about equally many of each language, chosen
by a hash of the id and text; the statistics of all other parts cover every row.

Defined cases: null text, and text without a letter, is ``und`` with score 0, not
ambiguous; with one language to learn every other text is that language with score 1;
with none, ``und``; repeated rows and ties are scored alike (equal losses: the language
that sorts first); an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .shared import fold_of, free_names, table
from .textbytes import LOWER, pieces, row_sums, text_buffer

#: Most texts that the classifiers are fitted on; whole ones.
TRAIN_DOCS = 6000
#: Bits of an n-gram's hash: a classifier has 2 ** TRAIN_BITS weights.
TRAIN_BITS = 17
#: A text is ambiguous if its best language has less than this share.
CLEAR = 0.5
UNKNOWN = "und"


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1: all splits of the languages for up to 5, else pseudo-random balanced ones of 10 * log2(k) bits, the most distant of several draws."""
    if k <= 5:
        cols = [[1 if j == 0 or not (c >> (j - 1)) & 1 else -1 for j in range(k)] for c in range(1, 1 << (k - 1))]
        return np.array(cols, dtype=np.int8).reshape(-1, k).T
    rng, bits, best, far = np.random.default_rng(7), int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(50):
        m = np.array([rng.permutation(np.arange(k) % 2) * 2 - 1 for _ in range(bits)], dtype=np.int8).T
        # Codes of +1 and -1: the product of two is bits - 2 * distance.
        near = max(int((m[lo : lo + 512].astype(np.float32) @ m.T.astype(np.float32) - 2 * bits * np.eye(min(512, k - lo), k, lo)).max()) for lo in range(0, k, 512))
        if (bits - near) // 2 > far:
            best, far = m, (bits - near) // 2
    return best


def ngram_features(buf: np.ndarray, off: np.ndarray, bits: int = TRAIN_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of bytes, row by row (none crosses rows), and their offsets."""
    b = LOWER[buf].astype(np.uint32)
    n = np.diff(off)
    mask = np.uint32((1 << bits) - 1)
    grams = [b]
    if len(b) > 1:
        two = b[:-1] << np.uint32(8) | b[1:]
        grams.append(np.append(two, 0).astype(np.uint32) + np.uint32(256))
    if len(b) > 2:
        three = ((two[:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - bits)
        grams.append(np.append(three, [0, 0]).astype(np.uint32))
    out, ends = [], np.zeros(len(n), dtype=np.int64)
    keep = np.empty((len(b), len(grams)), dtype=np.uint32)
    for j, g in enumerate(grams):
        keep[:, j] = g & mask
    valid = np.ones(keep.shape, dtype=bool)
    for j in range(1, len(grams)):
        for back in range(1, j + 1):
            at = off[1:] - back
            valid[at[(at >= off[:-1])], j] = False
    out = keep[valid]
    ends = row_sums(valid.sum(axis=1), off)
    return out, np.append(0, np.cumsum(ends))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-grams x bits
    scale: np.ndarray
    shift: np.ndarray
    trust: np.ndarray  # of each bit

    def decide(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its share, from the rows' mean weights."""
        if len(self.languages) == 1:
            return np.zeros(len(means), int), np.ones(len(means))
        margin = np.clip(means * self.scale + self.shift, -30, 30)
        loss = (np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.trust).sum(-1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        pick = loss.argmin(1)
        return pick, share[np.arange(len(pick)), pick]


def _means(weights: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    return row_sums(weights[grams], at) / np.maximum(np.diff(at), 1)[:, None]


def fit(texts: list[str], langs: list[str]) -> Model | None:
    languages = sorted(set(langs))
    if not languages:
        return None
    code = codewords(len(languages))
    bits, size = code.shape[1], 1 << TRAIN_BITS
    if not bits:
        return Model(languages, code, np.zeros((size, 0), np.float32), np.zeros(0), np.zeros(0), np.zeros(0))
    label = np.searchsorted(languages, langs)
    counts = np.zeros((len(languages), size))
    buf, off = text_buffer(pa.array(texts))
    for lo, hi, b, o in pieces(buf, off, 1 << 18):
        grams, at = ngram_features(b, o)
        who = np.repeat(label[lo:hi], np.diff(at))
        for k in np.unique(who):
            counts[k] += np.bincount(grams[who == k], minlength=size)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    weights = np.empty((size, bits), np.float32)
    for j in range(bits):
        a, z = share[code[:, j] > 0].mean(0), share[code[:, j] < 0].mean(0)
        weights[:, j] = np.log((a + 1e-6) / (z + 1e-6))
    means = np.vstack([_means(weights, *ngram_features(b, o)) for _, _, b, o in pieces(buf, off, 1 << 18)])
    scale, shift, trust = np.ones(bits), np.zeros(bits), np.ones(bits)
    for j in range(bits):
        x, y = means[:, j], (code[label, j] > 0).astype(float)
        a, c = 1.0, 0.0
        for _ in range(50):  # Newton steps; the ridge keeps the slope finite where a bit separates the texts
            p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum() + 1e-3 * c])
            h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, c = a - float(np.clip(step[0], -20, 20)), c - float(np.clip(step[1], -20, 20))
        scale[j], shift[j] = a, c
        trust[j] = max(0.05, 2 * float(((a * x + c > 0) == (y > 0.5)).mean()) - 1)
    return Model(languages, code, weights, scale, shift, trust / trust.mean())


def training_rows(docs: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], list[str]]:
    """At most ``most`` texts, as evenly dealt among the languages as they allow, chosen by hash."""
    fit_rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in fit_rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], []
    each = most / len(sizes)
    share = F.create_map([F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, each / n))])
    # The same text gets the same draw, so draws are by text and id.
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = fit_rows.where(draw < share[F.col("lang")]).select("text", "lang", draw.alias("draw"))
    rows = drawn.toArrow()  # about ``most``: each language's share is that of its rows
    rows = rows.take(np.argsort(np.asarray(rows["draw"]), kind="stable")[:most])
    return rows["text"].to_pylist(), rows["lang"].to_pylist()


def labelled(docs: DataFrame, model: Model | None, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs with the language of each text, its score and whether it is ambiguous, from its text alone, in columns called ``names``."""
    (known,) = free_names(docs, "_has_letter")
    rows = docs.withColumn(known, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return docs.select("*", *[F.lit(v).alias(n) for v, n in zip((UNKNOWN, 0.0, False), names)])
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** TRAIN_BITS rows by bits, whatever the input
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType()), StructField(names[2], BooleanType())])
    text_at, own = docs.columns.index("text"), list(range(len(docs.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        languages = np.array(model.languages, dtype=object)
        for batch in batches:
            buf, off = text_buffer(batch.column(text_at))
            pick, score = np.zeros(len(batch), int), np.zeros(len(batch))
            for lo, hi, b, o in pieces(buf, off, 1 << 18):
                pick[lo:hi], score[lo:hi] = model.decide(_means(model.weights, *ngram_features(b, o)))
            letter = np.asarray(batch.column(len(own)).to_pylist(), dtype=bool)
            found = [pa.array(np.where(letter, languages[pick], UNKNOWN), pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(letter & (score < CLEAR))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), *found], [*docs_columns, *names])

    docs_columns = docs.columns
    return rows.mapInArrow(run, schema)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each document."""
    return labelled(docs.select("doc_id", "text"), model).drop("text")


def known_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents whose language is known and clear, in the same pass as they are read: no id decides for another row."""
    names = tuple(free_names(docs, "_lang_pred", "_score", "_ambiguous"))
    kept = labelled(docs, model, names).where((F.col(names[0]) != UNKNOWN) & ~F.col(names[2]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def learned(docs: DataFrame) -> Model | None:
    return fit(*training_rows(docs.where(fold_of("doc_id", 4) != 2)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predicted(docs, learned(docs))
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
