"""Named indices as an append-only log.

log: seq BIGINT, index STRING, op STRING, uri, shape.  Ops: assert, retract, clear and flush (uri and shape null) and
bulkload (one row a loaded pair, all with the seq of the load).  The contents of the indices are a fold of the log
that is part of every query's plan, so a query sees one state and nothing needs flushing before it.

Asserts and retracts wait in a queue that a flush empties into the index; it holds ops of one kind, as an op of the other kind flushes
what is there first.  A bulkload replaces what is in the index and leaves the queue as it is; a clear drops both.
So what was asserted before a load outlives it only if it was still waiting: if no flush and no retract stands between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import Options
from ..types import SHAPE_T, is_shape

#: Indices with control rows (clear, flush, bulkload) up to which their positions are broadcast; beyond that they are joined.
CONTROL_ROWS = 10_000
_NEVER = -(2**62)


def _last(op: str, where: Column | None = None) -> Column:
    hit = F.col("op") == op
    return F.coalesce(F.max(F.when(hit if where is None else hit & where, F.col("seq"))), F.lit(_NEVER))


def _beside(rows: DataFrame, few: DataFrame, base: list[str], n: int) -> DataFrame:
    """rows with the columns of few, a row an index at most (n in all); indices without one keep nulls."""
    few = F.broadcast(few) if n <= CONTROL_ROWS else few
    return rows.join(few, base, "left")


def fold(log: DataFrame, key: list[str] | None = None) -> DataFrame:
    """What is in the indices, each pair once; a waiting queue counts as flushed."""
    key = key or ["index", "uri", "shape"]
    own = "index" in log.columns
    rows = log if own else log.withColumn("index", F.lit(""))
    key = [k for k in key if k in rows.columns]
    control = rows.where(F.col("op").isin("clear", "bulkload")).groupBy("index").agg(_last("clear").alias("_clear"), _last("bulkload").alias("_load"))
    state = control.agg(F.count(F.lit(1)), F.count(F.when(F.col("_load") > F.col("_clear"), 1))).first()
    if state[0]:
        rows = _beside(rows, control, ["index"], state[0])
        rows = rows.where(F.col("_clear").isNull() | (F.col("seq") > F.col("_clear")))
    rows = rows.where(~F.col("op").isin("clear"))
    if state[1]:
        early = F.col("seq") < F.col("_load")
        marks = rows.where(early).groupBy("index").agg(_last("flush").alias("_flush"), _last("assert").alias("_assert"), _last("retract").alias("_retract"))
        rows = _beside(rows, marks, ["index"], state[0])
        other = F.when(F.col("op") == "assert", F.col("_retract")).otherwise(F.col("_assert"))
        waits = (F.col("seq") > F.col("_flush")) & (F.col("seq") > other)
        last_load = F.col("seq") == F.col("_load")
        rows = rows.where(F.col("_load").isNull() | F.when(F.col("op") == "bulkload", last_load).otherwise(~early | waits))
    rows = rows.where(F.col("op") != "flush")
    # The queue is applied after a load that came later than it.
    order = F.when(F.col("op") == "bulkload", F.lit(_NEVER)).otherwise(F.col("seq"))
    final = rows.groupBy(*key).agg(F.max_by("op", F.struct(order, F.col("seq"))).alias("op"))
    return final.where(F.col("op").isin("assert", "bulkload")).drop("op", *([] if own else ["index"]))


def indexed(log: DataFrame, index: str | None = None, options: Options | None = None) -> DataFrame:
    """One index; empty if nobody has used the name."""
    return fold(log.where(F.col("index") == (index or (options or Options()).default_index))).drop("index")


def uri_shapes(log: DataFrame, uri: object = None, index: str | None = None) -> DataFrame:
    """uri and shape of an index, of all features or of one."""
    rows = indexed(log, index)
    return rows if uri is None else rows.where(F.col("uri") == F.lit(uri))


def ops(rows: DataFrame, op: str, seq: int, index: str | None = None, options: Options | None = None) -> DataFrame:
    """Log rows that apply op to all (uri, shape) rows at once; what isn't a shape can't be indexed and is left out."""
    index = index or (options or Options()).default_index
    fit = rows.where(is_shape(F.col("shape"))) if rows.schema["shape"].dataType.simpleString() == SHAPE_T.replace(" ", "") else rows
    return fit.select(F.lit(seq).cast("long").alias("seq"), F.lit(index).alias("index"), F.lit(op).alias("op"), "uri", "shape")


def index_all(triples: DataFrame, seq: int, index: str | None = None, more: tuple = ()) -> DataFrame:
    """Log rows that load an index with all shapes that the triples' sources tell."""
    from ..sources.triples import candidates

    return ops(candidates(triples, more), "bulkload", seq, index)


def mark(op: str, seq: int, like: DataFrame, index: str | None = None) -> DataFrame:
    """A clear or flush row, with the columns of a log."""
    if op not in ("clear", "flush"):
        raise ValueError(op)
    row = like.sparkSession.range(1).select(F.lit(seq).cast("long").alias("seq"), F.lit(index or Options().default_index).alias("index"), F.lit(op).alias("op"))
    return row.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema if f.name not in ("seq", "index", "op")])
