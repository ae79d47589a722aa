"""Geometry and time views derived from the tables.  Each is the same SQL text in Spark and in a plain SQL engine, but for reading epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types

_D = "cast({} as double)".format
GEO_POINTS = f"""select c_custkey as uri, {_D(50.0)}+((c_custkey*7919)%10007)/{_D(2500.0)} as x,
       {_D(2.0)}+((c_custkey*104729)%10009)/{_D(2500.0)} as y from customer"""
GEO_BOXES = f"""select p_partkey as uri, bx as minx, by_ as miny, bx+(1+p_partkey%7)/{_D(16.0)} as maxx, by_+(1+p_partkey%5)/{_D(16.0)} as maxy
from (select p_partkey, {_D(50.0)}+((p_partkey*6007)%251)/{_D(64.0)} as bx, {_D(2.0)}+((p_partkey*5003)%241)/{_D(64.0)} as by_ from part) t"""
#: Spark's and the other engine's way to read a timestamp's epoch seconds.
SPARK, OTHER = {"orders": "unix_seconds(cast(o_orderdate as timestamp))", "events": f"unix_micros(cast(ts as timestamp))/{_D(1e6)}"}, {"orders": "epoch(o_orderdate)", "events": f"epoch_us(ts)/{_D(1e6)}"}


def times(engine: dict) -> str:
    return f"select o_orderkey as uri, cast({engine['orders']} as double) as t_begin, cast({engine['orders']} + 86400*(o_orderkey%30) as double) as t_end from orders"


def spacetime(engine: dict) -> str:
    return f"""select event_id as uri, {engine['events']} as t_begin, {_D(50.0)}+((event_id*7919)%10007)/{_D(2500.0)} as x,
       {_D(2.0)}+((user_id*104729)%10009)/{_D(2500.0)} as y from events"""


MUTATIONS = f"""select event_id as seq, case when event_type in ('error','signup') then 'retract' else 'assert' end as op, user_id as uri,
       {_D(50.0)}+(event_id%4)/{_D(4.0)} as x, {_D(2.0)}+(event_id%3)/{_D(4.0)} as y from events"""
LINKS = "select c_custkey as src, c_custkey*2+1 as dst from customer where c_custkey*2+1 < (select count(*) from customer)"
CENTRES = f"select n_nationkey as uri, {_D(50.0)}+n_nationkey%5 as cx, {_D(2.0)}+floor(n_nationkey/5) as cy from nation"

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "events")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f" {t}" in text}
    for t in used:
        text = text.replace(f"from {t}", "from {" + t + "}")
    return spark.sql(text, **used)


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uri, x, y, and the flat box."""
    return _sql(spark, sf_dir, GEO_POINTS).select("uri", "x", "y", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))


def point_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_points(spark, sf_dir).select("uri", types.point(F.col("x"), F.col("y")).alias("shape"), *("minx", "miny", "maxx", "maxy"))


def geo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, GEO_BOXES)


def box_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_boxes(spark, sf_dir).select("uri", types.box(*map(F.col, ("minx", "miny", "maxx", "maxy"))).alias("shape"), "minx", "miny", "maxx", "maxy")


def diamonds(spark: SparkSession, sf_dir: str, half: float = 0.71875) -> DataFrame:
    x, y = F.col("cx"), F.col("cy")
    corners = [(x - half, y), (x, y + half), (x + half, y), (x, y - half), (x - half, y)]
    return types.with_mbr(_sql(spark, sf_dir, CENTRES).select("uri", types.polygon(corners).alias("shape")))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, times(SPARK))


def spacetime_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, spacetime(SPARK))
    return rows.select("uri", "t_begin", F.col("t_begin").alias("t_end"), types.point(F.col("x"), F.col("y")).alias("shape"), F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))


def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, MUTATIONS)


def link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LINKS.replace("(select count(*) from customer)", str(spark.read.parquet(f"{sf_dir}/customer.parquet").count())))


def lasting(engine: dict) -> str:
    """Features in space that last up to three days, so that they are in several buckets."""
    return f"select uri, t_begin, t_begin + 43200*(uri%7) as t_end, x, y from ({spacetime(engine)}) s"


def lasting_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, lasting(SPARK))
    return rows.select("uri", "t_begin", "t_end", types.point(F.col("x"), F.col("y")).alias("shape"), F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))


def polygon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as polygons."""
    rows = geo_boxes(spark, sf_dir)
    return rows.select("uri", types.make("polygon", F.array(types.box_ring(*map(F.col, ("minx", "miny", "maxx", "maxy"))))).alias("shape"), "minx", "miny", "maxx", "maxy")
