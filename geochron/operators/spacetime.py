"""Features in space and time: uri, t_begin, t_end, shape.

An index is the features with a row for each bucket of time they touch.  The size of its buckets is a column of the index itself,
stored with it, so a query can't be asked with another one.  Features whose time has an open side are in no bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeops
from ..functions.measures import KM_PER_DEGREE
from ..options import Options
from ..sources import triples as sources
from ..storage import remove
from .query import Query, boxed, degrees_to, meets_box, met


def bucket(t: Column, size: float | Column) -> Column:
    return F.floor(t / size) * size


def buckets(begin: Column, end: Column, size: float) -> Column:
    """Every bucket that the interval touches."""
    return F.transform(F.sequence(F.floor(begin / size), F.floor(end / size)), lambda i: i * F.lit(float(size)))


def buckets_stepping(begin: Column, end: Column, size: float) -> Column:
    """Buckets of begin, begin + size, ... while below end + size: may hold one past the end."""
    n = F.ceil((end + size - begin) / size) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(0))), lambda i: bucket(begin + i * size, size))


def bucketed(features: DataFrame, size: float | None = None, options: Options | None = None) -> DataFrame:
    """The index of features: bucket and bucket_size with every row."""
    size = float(size or (options or Options()).bucket_size)
    rows = boxed(features).where("t_begin <= t_end").withColumn("bucket_size", F.lit(size))
    return rows.withColumn("bucket", F.explode(buckets(F.col("t_begin"), F.col("t_end"), size)))


def store(features: DataFrame, path: str, size: float | None = None, options: Options | None = None) -> None:
    """The index as files, a folder a bucket below one of the size; what was at the path is replaced."""
    rows = bucketed(features, size, options)
    # Bucket and place together, so that one busy bucket isn't one task; a bucket then has a few files.
    dealt = rows.repartition("bucket", F.floor("minx"), F.floor("miny")).sortWithinPartitions("bucket", "minx", "miny")
    dealt.write.mode("overwrite").partitionBy("bucket_size", "bucket").parquet(path)


def index_all(triples: DataFrame, size: float | None = None, more: tuple[sources.Source, ...] = ()) -> DataFrame:
    """The index of everything that the triples place in space and time."""
    return bucketed(sources.spacetime_candidates(triples, more), size)


def clear(spark: SparkSession, path: str) -> None:
    """Drops all buckets of a stored index."""
    remove(spark, path)


def indices(index: DataFrame) -> DataFrame:
    """bucket, bucket_size and n, the features, of each bucket there is."""
    return index.groupBy("bucket", "bucket_size").agg(F.count(F.lit(1)).alias("n"))


def in_interval(index: DataFrame, begin: float, end: float) -> DataFrame:
    """Rows of buckets that the interval touches: on stored indices, a choice of folders."""
    return index.where((F.col("bucket") <= F.lit(float(end))) & (F.col("bucket") + F.col("bucket_size") >= F.lit(float(begin))))


def _narrowed(index: DataFrame, begin: float, end: float) -> DataFrame:
    """Rows whose own time overlaps the query's.  The buckets prune, and a feature counts only in its first bucket that the query touches, so none comes out twice."""
    rows = boxed(index)
    if "bucket" in rows.columns:
        size = F.col("bucket_size")
        first = bucket(F.greatest(F.col("t_begin"), F.lit(float(begin))), size)
        rows = in_interval(rows, begin, end).where(F.col("bucket") == first).drop("bucket", "bucket_size")
    return rows.where(timeops.overlaps(timeops.Interval.of("t_begin", "t_end"), timeops.Interval.of(begin, end)))


def spacetime_intersects(index: DataFrame, q: Query, begin: float, end: float) -> DataFrame:
    """Features whose shape intersects the query's and whose own time overlaps it.  index: an index, or features without buckets."""
    rows = _narrowed(index, begin, end).where(meets_box(q))
    return rows.where(met(rows, q))


def spacetime_within_range(index: DataFrame, q: Query, begin: float, end: float, range_km: float, range_seconds: float) -> DataFrame:
    """Features at most so far away whose time overlaps the query's widened by range_seconds, with distance_km, nearest first."""
    rows = _narrowed(index, begin - range_seconds, end + range_seconds).where(meets_box(q, range_km / KM_PER_DEGREE * (1 + 1e-12)))
    rows = rows.withColumn("distance_km", degrees_to(rows, q) * KM_PER_DEGREE)
    return rows.where(F.col("distance_km") <= range_km).orderBy("distance_km", "uri")
