"""Queries of an interval table: uri, t_begin, t_end (epoch seconds, null where open).  A null query bound is open.

Time indices are kept as a log like that of shapes (see mutations), with t_begin and t_end in the shape's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import Options
from ..sources import triples as sources
from ..storage import written
from . import mutations

#: Distinct times of an as-of join that one window task goes through.
PART_ROWS = 100_000


# The log


def ops(rows: DataFrame, op: str, seq: int, index: str | None = None) -> DataFrame:
    """Log rows that apply op (assert, retract or bulkload) to all rows at once.  A point in time is t_begin alone, or with an equal t_end."""
    end = F.coalesce("t_end", "t_begin") if "t_end" in rows.columns else F.col("t_begin")
    return rows.select(F.lit(seq).cast("long").alias("seq"), F.lit(index or Options().default_index).alias("index"), F.lit(op).alias("op"), "uri", F.col("t_begin").cast("double").alias("t_begin"), end.cast("double").alias("t_end"))


def index_all(triples: DataFrame, seq: int, index: str | None = None) -> DataFrame:
    """Log rows that load an index with all times that the triples tell."""
    return ops(sources.uri_time(triples), "bulkload", seq, index)


def fold(log: DataFrame) -> DataFrame:
    """index, uri, t_begin, t_end of what is in the indices."""
    return mutations.fold(log, ["index", "uri", "t_begin", "t_end"])


def epochs(log: DataFrame) -> DataFrame:
    """index and epoch: the begin of the first interval that was put into each index since it was cleared."""
    puts = log.where(F.col("op").isin("assert", "bulkload", "clear"))
    cleared = puts.groupBy("index").agg(F.coalesce(F.max(F.when(F.col("op") == "clear", F.col("seq"))), F.lit(-(2**62))).alias("_clear"))
    live = puts.join(cleared, "index").where((F.col("seq") > F.col("_clear")) & (F.col("op") != "clear"))
    return live.groupBy("index").agg(F.min_by("t_begin", F.struct("seq", "t_begin")).alias("epoch"))


# Queries


def rounded(intervals: DataFrame, epoch: float = 0.0) -> DataFrame:
    """Bounds as the index keys them: whole seconds since epoch."""
    return intervals.withColumn("t_begin", F.round(F.col("t_begin") - epoch)).withColumn("t_end", F.round(F.col("t_end") - epoch))


def time_intersects(intervals: DataFrame, begin: float, end: float, mode: str = "compat") -> DataFrame:
    """Distinct uris.  compat: begin or end in the query's range, which misses intervals that enclose it; full: any overlap."""
    if mode not in ("compat", "full"):
        raise ValueError(mode)
    hit = (F.col("t_begin").between(begin, end) | F.col("t_end").between(begin, end)) if mode == "compat" else (F.col("t_begin") <= end) & (F.col("t_end") >= begin)
    return intervals.where(hit).select("uri").distinct()


def time_contains(intervals: DataFrame, begin: float | None = None, end: float | None = None) -> DataFrame:
    """Intervals within the query's; with an open side, those before its end (latest end first) or after its begin (earliest first); all if both are open."""
    if begin is None and end is None:
        return intervals.select("uri").distinct()
    if begin is None:
        return time_prev_end(intervals, end)
    if end is None:
        return time_next_begin(intervals, begin)
    return intervals.where((F.col("t_begin") >= begin) & (F.col("t_end") <= end)).select("uri").distinct()


def time_prev_end(intervals: DataFrame, t: float, k: int | None = None) -> DataFrame:
    rows = intervals.where(F.col("t_end") <= t).orderBy(F.col("t_end").desc(), "uri")
    return rows if k is None else rows.limit(k)


def time_next_begin(intervals: DataFrame, t: float, k: int | None = None) -> DataFrame:
    rows = intervals.where(F.col("t_begin") >= t).orderBy(F.col("t_begin"), "uri")
    return rows if k is None else rows.limit(k)


def _last_at_or_before(queries: DataFrame, ends: DataFrame) -> DataFrame:
    """id, uri, t: for each query (id, t) the row of ends (uri, t) with the largest t not above it, ties to the smallest uri.

    Times are made distinct first, on both sides, so a time that a third of all rows share is one row.  The distinct times are cut into ranges
    of about equal numbers of rows and written; each range is one window, given the last end of the ranges before it.
    """
    known = ends.where("t is not null").groupBy("t").agg(F.min("uri").alias("uri")).select("t", F.struct("t", "uri").alias("e"))
    asked = queries.where("t is not null").select(F.col("t").cast("double")).distinct().select("t", F.lit(None).cast(known.schema["e"].dataType).alias("e"))
    times = known.unionByName(asked).groupBy("t").agg(F.max("e").alias("e"))
    n = sum(d.agg(F.approx_count_distinct("t")).first()[0] for d in (ends, queries))
    parts = max(1, n // PART_ROWS)
    # Which rows share a range depends on a sample, so it is written once and read twice.
    dealt = written(times.repartitionByRange(parts, "t").withColumn("part", F.spark_partition_id()), "asof")
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part").agg(F.max("e").alias("m")).select("part", F.max("m").over(up_to).alias("before"))
    last = F.max("e").over(Window.partitionBy("part").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = dealt.withColumn("last", last).join(before, "part").select(F.col("t").alias("_at"), F.coalesce("last", "before").alias("found")).where("found is not null")
    rows = queries.select("id", F.col("t").cast("double").alias("_t")).join(found, F.col("_t") == F.col("_at"))
    return rows.select("id", F.col("found.uri").alias("uri"), F.col("found.t").alias("t"))


def previous_end_join(queries: DataFrame, intervals: DataFrame) -> DataFrame:
    """For each query (id, t) the interval that ended last at or before t: id, uri, t_end."""
    return _last_at_or_before(queries, intervals.select("uri", F.col("t_end").alias("t"))).withColumnRenamed("t", "t_end")


def next_begin_join(queries: DataFrame, intervals: DataFrame) -> DataFrame:
    """For each query (id, t) the interval that begins first at or after t: id, uri, t_begin."""
    turned = _last_at_or_before(queries.select("id", (-F.col("t")).alias("t")), intervals.select("uri", (-F.col("t_begin")).alias("t")))
    return turned.select("id", "uri", (-F.col("t")).alias("t_begin"))


def size(intervals: DataFrame) -> DataFrame:
    return intervals.agg(F.count(F.lit(1)).alias("size"))
