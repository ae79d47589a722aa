"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's documents are cut into blocks.  Block k of a source of weight w is released
at floor(k / w) and due at ceil((k + 1) / w); one block takes one slot, and the earliest
deadline among the released blocks goes first.  As the weights sum to 1, every block then
meets its window, so at any slot a source has had its share to within less than one block.

Weights are exact fractions.  Given weights are taken as the decimal numbers they are written as, and their common
denominator is the length of a frame, after which the schedule repeats; if that is above ``MAX_FRAME`` they raise instead of being rounded.
Without weights the targets are whole slots of a frame of FRAME, at least one a source, as near to size ** TEMPER as that allows.
The schedule is worked out once for a frame, by a fold over its slots, and joined to the blocks by their place
in the frame (a table of a frame's rows, whatever the data's size).

When a source runs out its later slots stay empty; the others keep their proportions.
No document is dropped: ``position`` orders all of them, and ``in_mix`` tells whether the
slot comes before the first source ran out, that is, where all target weights hold.

A source's documents are taken in the order of a hash of their id and text, so no run of ids, outlying id or null id
fills a window: each is numbered within a part of its source, and parts are equal spans of the hash.

Defined cases: a null source is a source of its own, called ''; null or empty texts
are documents like any other; documents with equal hashes stand in the order of doc_id (nulls first), and rows that repeat id and text are alike;
weights given for absent sources are left out and the rest scaled to sum to 1; a source that
isn't among given weights, or whose weight isn't positive, raises, as do more than ``MAX_SOURCES`` sources; an empty table gives no rows; further
columns are kept by ``mixed``, whose own columns get more underscores where the table has their names.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import free_names, table

FRAME, MAX_FRAME, MAX_SOURCES, BLOCK_DOCS, TEMPER = 1000, 50_000, 10_000, 16, 0.5
#: Documents that are numbered in one window, about.
PART_ROWS = 100_000
#: Slots whose picks are gathered in one array before they are put to the others.
_RUN = 256
_COLUMNS = {"_source": "string", "_block": "long", "_release": "long", "_deadline": "long", "_slot": "long", "_position": "long", "_in_mix": "boolean"}


def frame_slots(sizes: dict[str, int], weights: dict[str, float | str | Fraction] | None = None, frame: int = FRAME, temper: float = TEMPER) -> dict[str, int]:
    """Slots of a frame for each source: exactly in proportion to given weights, else near to size ** temper."""
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"{len(sizes)} sources: more than {MAX_SOURCES}")
    if weights is not None:
        exact = {s: Fraction(str(weights.get(s, 0))) for s in sizes}
        if bad := sorted(s for s, w in exact.items() if not w > 0):
            raise ValueError(f"sources without a positive weight: {bad}")
        whole = lcm(*(w.denominator for w in exact.values()))
        slots = {s: int(w * whole) for s, w in exact.items()}
        shared = gcd(*slots.values())
        slots = {s: n // shared for s, n in slots.items()}
        if sum(slots.values()) > MAX_FRAME:
            raise ValueError(f"the weights' common denominator is {sum(slots.values())}, above {MAX_FRAME}: give them with fewer digits")
        return slots
    frame = max(frame, 2 * len(sizes))
    want = {s: float(n) ** temper for s, n in sizes.items()}
    total = sum(want[s] for s in sorted(want))
    slots = {s: max(1, int(w / total * frame)) for s, w in want.items()}
    by_rest = sorted(want, key=lambda s: (-(want[s] / total * frame % 1), s))
    i = 0
    while sum(slots.values()) < frame:
        slots[by_rest[i % len(by_rest)]] += 1
        i += 1
    while sum(slots.values()) > frame:
        most = max(slots, key=lambda s: (slots[s], s))
        slots[most] -= 1
    return slots


def schedule(spark: SparkSession, slots: dict[str, int]) -> DataFrame:
    """source, j, slot: where the j-th block of a frame stands.  Earliest deadline first, by a fold over the slots; ties to the source that sorts first."""
    names, frame = sorted(slots), sum(slots.values())
    shares = F.array(*[F.lit(slots[s]).cast("long") for s in names])
    size = F.lit(frame).cast("long")
    zero = F.array_repeat(F.lit(0).cast("long"), len(names))

    def step(state: Column, slot: Column) -> Column:
        due = F.zip_with(
            shares,
            state["done"],
            # A block of a source: due at ceil((k + 1) * frame / n), if floor(k * frame / n) has come.
            lambda n, k: F.when((k < n) & (F.call_function("div", k * size, n) <= slot), F.call_function("div", (k + 1) * size + n - 1, n)),
        )
        pick = F.array_position(due, F.array_min(due)).cast("int") - 1
        done = F.transform(state["done"], lambda k, i: k + F.when(i == pick, 1).otherwise(0))
        return F.struct(done.alias("done"), F.concat(state["order"], F.array(pick)).alias("order"))

    def run(state: Column, first: Column) -> Column:
        # An array is copied whenever it grows, so picks are gathered run by run.
        start = F.struct(state["done"].alias("done"), F.array().cast("array<int>").alias("order"))
        some = F.aggregate(F.sequence(first, F.least(first + _RUN, size) - 1), start, step)
        return F.struct(some["done"].alias("done"), F.concat(state["order"], F.array(some["order"])).alias("order"))

    runs = F.sequence(F.lit(0).cast("long"), F.lit(frame - 1).cast("long"), F.lit(_RUN).cast("long"))
    order = F.aggregate(runs, F.struct(zero.alias("done"), F.array().cast("array<array<int>>").alias("order")), run, lambda s: F.flatten(s["order"]))
    rows = spark.range(1).select(F.posexplode(order).alias("slot", "pick"))
    named = rows.select(F.col("slot").cast("long"), F.element_at(F.array(*[F.lit(s) for s in names]), F.col("pick") + 1).alias("source"))
    return named.withColumn("j", F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1)


def place_key() -> Column:
    """What orders the documents of a source."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def own_columns(docs: DataFrame) -> dict[str, str]:
    """What mixed() calls its columns beside those of docs."""
    return dict(zip(_COLUMNS, free_names(docs, *_COLUMNS)))


def mixed(docs: DataFrame, weights: dict[str, float | str | Fraction] | None = None, block_docs: int = BLOCK_DOCS, frame: int = FRAME, key: Column | None = None) -> DataFrame:
    """docs with _source, _block, _release, _deadline, _slot, _position and _in_mix.  key: place_key(), if it is worked out already."""
    spark = docs.sparkSession
    names = list(own_columns(docs).values())
    src, k_key, k_part, k_n, k_offset, k_place, k_nth, k_per, k_j, k_frame, k_at = free_names(docs, "_src", "_key", "_part", "_n", "_offset", "_place", "_nth", "_per", "_j", "_frame", "_at")
    rows = docs.withColumns({src: F.coalesce(F.col("source").cast("string"), F.lit("")), k_key: place_key() if key is None else key})
    sizes = {r[0]: r[1] for r in rows.groupBy(src).agg(F.count(F.lit(1))).limit(MAX_SOURCES + 1).collect()}
    if not sizes:
        return docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(names, _COLUMNS.values())])
    slots = frame_slots(sizes, weights, frame)
    size = sum(slots.values())
    # A document's number within its source: its place in a part of the source, after all documents of earlier parts.
    # Parts are spans of the key's first hexadecimal digits.
    digits = 2
    while 16**digits * PART_ROWS < sum(sizes.values()):
        digits += 1
    rows = rows.withColumn(k_part, F.substring(k_key, 1, digits))
    before = Window.partitionBy(src).orderBy(k_part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(src, k_part).agg(F.count(F.lit(1)).alias(k_n)).withColumn(k_offset, F.coalesce(F.sum(k_n).over(before), F.lit(0))).drop(k_n)
    place = F.row_number().over(Window.partitionBy(src, k_part).orderBy(k_key, "doc_id"))
    numbered = rows.withColumn(k_place, place).join(offsets, [src, k_part]).withColumn(k_nth, F.col(k_place) - 1 + F.col(k_offset))
    per_frame = F.create_map([F.lit(x) for s, n in sorted(slots.items()) for x in (s, n)])[F.col(src)].cast("long")
    block, per = F.call_function("div", F.col(k_nth), F.lit(block_docs)), F.col(k_per)
    numbered = numbered.withColumn(names[1], block).withColumn(k_per, per_frame)
    number = F.col(names[1])
    numbered = numbered.withColumn(k_j, F.pmod(number, per)).withColumn(k_frame, F.call_function("div", number, per))
    # The schedule has MAX_FRAME rows at most.
    placed = numbered.join(F.broadcast(schedule(spark, slots).toDF(k_at, src, k_j)), [src, k_j])
    slot = F.col(k_frame) * size + F.col(k_at)
    # The first slot that no block fills: where the source that runs out first would go on.
    horizon = min(n // block_docs // slots[s] * size + (n // block_docs % slots[s]) * size // slots[s] for s, n in sizes.items())
    values = [
        F.col(src), number,
        F.call_function("div", number * size, per), F.call_function("div", (number + 1) * size + per - 1, per),
        slot, slot * block_docs + F.pmod(k_nth, F.lit(block_docs)), slot < horizon,
    ]
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], *[x.alias(c) for x, c in zip(values, names)])


def interleaved(docs: DataFrame, weights: dict[str, float | str | Fraction] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The documents themselves, in the order of the mix: written out, file after file gives the target weights."""
    position = own_columns(docs)["_position"]
    return mixed(docs, weights, block_docs).orderBy(position).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", place_key().alias("key"))
    rows = mixed(docs, key=F.col("key"))
    return rows.select("doc_id", F.col("_source").alias("source"), F.col("_block").alias("block"), F.col("_release").alias("release"), F.col("_deadline").alias("deadline"), F.col("_slot").alias("slot"), F.col("_position").alias("position"), F.col("_in_mix").alias("in_mix"))


OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents
), n AS (SELECT source, count(*) AS n FROM d GROUP BY source),
f AS (SELECT greatest({FRAME}, 2 * count(*)) AS frame, sum(sqrt(n)) AS total FROM n),
w AS (SELECT source, n, frame, sqrt(n) / total * frame AS want, greatest(1, CAST(floor(sqrt(n) / total * frame) AS BIGINT)) AS low FROM n, f),
r AS (SELECT *, row_number() OVER (ORDER BY -(want - floor(want)), source) AS by_rest, frame - sum(low) OVER () AS spare, count(*) OVER () AS sources FROM w),
s AS (SELECT source, n, CAST(frame AS BIGINT) AS frame, CAST(low + spare // sources + CASE WHEN by_rest <= spare % sources THEN 1 ELSE 0 END AS BIGINT) AS share FROM r),
l AS (SELECT list(source ORDER BY source) AS names, list(share ORDER BY source) AS shares, any_value(frame) AS frame FROM s),
e AS (
  SELECT CAST(0 AS BIGINT) AS slot, list_transform(shares, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS INTEGER) AS pick FROM l
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda k, i: k + CASE WHEN i = p THEN 1 ELSE 0 END), CAST(p AS INTEGER) FROM (
    SELECT slot, done, list_position(due, list_min(due)) AS p FROM (
      SELECT slot, done, frame, list_transform(done, lambda k, i: CASE WHEN k < shares[i] AND k * frame // shares[i] <= slot THEN ((k + 1) * frame + shares[i] - 1) // shares[i] END) AS due
      FROM e, l WHERE slot < frame) q) p
), a AS (SELECT names[pick] AS source, slot - 1 AS place, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS j FROM e, l WHERE pick IS NOT NULL),
b AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST) - 1 AS nth FROM d),
c AS (SELECT b.*, nth // {BLOCK_DOCS} AS block, share, frame FROM b JOIN s USING (source)),
h AS (SELECT min((n // {BLOCK_DOCS}) // share * frame + ((n // {BLOCK_DOCS}) % share) * frame // share) AS horizon FROM s)
SELECT doc_id, c.source, block, block * frame // share AS release, ((block + 1) * frame + share - 1) // share AS deadline,
  block // share * frame + place AS slot, (block // share * frame + place) * {BLOCK_DOCS} + nth % {BLOCK_DOCS} AS position, block // share * frame + place < horizon AS in_mix
FROM c JOIN a ON a.source = c.source AND a.j = block % share, h
"""
