"""Shapes and times found in triples.

triples: s, p, o (STRING), o_type, o_lang (STRING, null if plain), graph (STRING).  Every source gives
(uri, shape, source); which of them are read, and in what order, is a registry to which users add their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.timeops import parse_timestamp
from ..storage import written
from ..types import SHAPE_T, make, point, xyz

# The vocabularies' names.
WGS84 = "http://www.w3.org/2003/01/geo/wgs84_pos#"
FREEBASE = "http://rdf.freebase.com/ns/"
DBPEDIA = "http://dbpedia.org/property/"
FOAF_BASED_NEAR = "http://xmlns.com/foaf/0.1/based_near"
SEM = "http://semanticweb.cs.vu.nl/2009/11/sem/"
OWL_TIME = "http://www.w3.org/2006/time#"
SUB_PROPERTY = "http://www.w3.org/2000/01/rdf-schema#subPropertyOf"
DBPEDIA_COORDINATES, DBPEDIA_BELOW = DBPEDIA + "coordinateProperty", DBPEDIA + "co_percent_e3_percent_b6rdinatenProperty"
LINKS = ("http://www.w3.org/2002/07/owl#sameAs", "http://www.w3.org/2004/02/skos/core#exactMatch", "http://www.w3.org/2004/02/skos/core#closeMatch")

Source = Callable[[DataFrame], DataFrame]


def _shapes(df: DataFrame) -> DataFrame:
    return df.select(F.col("s").alias("uri"), F.col("shape").cast(SHAPE_T).alias("shape"), F.col("graph").alias("source")).where("shape is not null")


def wgs84(triples: DataFrame) -> DataFrame:
    """lat and long of a subject in one graph make a point, with alt of the same graph one of three dimensions.

    A subject that has an alt in any graph has no point of two dimensions.  One aggregation instead of joins; a subject with several values gives every combination.
    """
    def pick(name: str):
        return F.collect_set(F.when(F.col("p") == WGS84 + name, F.col("o").try_cast("double"))).alias(name)

    rows = triples.where(F.col("p").isin(*(WGS84 + n for n in ("lat", "long", "alt")))).groupBy("s", "graph").agg(pick("lat"), pick("long"), pick("alt"))
    high = F.max(F.size("alt") > 0).over(Window.partitionBy("s"))
    rows = rows.withColumn("high", high).withColumn("lat", F.explode("lat")).withColumn("long", F.explode("long")).withColumn("alt", F.explode_outer("alt"))
    flat = make("point", F.array(F.array(xyz(F.col("lat"), F.col("long"), F.col("alt")))), F.when(F.col("alt").isNull(), 2).otherwise(3))
    return _shapes(rows.where("not high or alt is not null").withColumn("shape", flat))


def wgs84_value(triples: DataFrame, name: str) -> DataFrame:
    """uri, value, source of one of lat, long and alt."""
    if name not in ("lat", "long", "alt"):
        raise ValueError(name)
    rows = triples.where(F.col("p") == WGS84 + name)
    return rows.select(F.col("s").alias("uri"), F.col("o").try_cast("double").alias("value"), F.col("graph").alias("source")).where("value is not null")


def georss_simple(triples: DataFrame) -> DataFrame:
    rows = triples.where(F.col("p").isin(*(codecs.GEORSS + n for n in ("point", "line", "linearring", "polygon", "box", "circle"))))
    return _shapes(rows.withColumn("shape", codecs.georss_shape(F.col("p"), F.col("o"))))


def georss_gml(triples: DataFrame) -> DataFrame:
    rows = triples.where(F.col("p").isin(codecs.GEORSS + "where", FOAF_BASED_NEAR))
    return _shapes(rows.withColumn("shape", codecs.gml_shape(F.col("o"))))


def georss(triples: DataFrame) -> DataFrame:
    return georss_simple(triples).unionByName(georss_gml(triples))


def freebase(triples: DataFrame) -> DataFrame:
    """A subject's geolocation node, and the latitude and longitude of that node; only typed literals count."""
    hop = triples.where(F.col("p") == FREEBASE + "location.location.geolocation").select("s", F.col("o").alias("node"), "graph")
    value = lambda name: triples.where((F.col("p") == FREEBASE + f"location.geocode.{name}") & F.col("o_type").isNotNull()).select(F.col("s").alias("node"), F.col("o").try_cast("double").alias(name)).where(f"{name} is not null")
    rows = hop.join(value("latitude"), "node").join(value("longitude"), "node")
    return _shapes(rows.withColumn("shape", point(F.col("latitude"), F.col("longitude"))))


def sub_properties(triples: DataFrame, top: str, known: tuple[str, ...] = (), most: int = 32) -> DataFrame:
    """p: the property itself, those known to be below it, and those that triples put below any of these, level by level.

    Properties are the vocabulary's, not the data's, so levels are few; more than ``most`` of them raise.
    """
    below = triples.where(F.col("p") == SUB_PROPERTY).select(F.col("s").alias("p"), F.col("o").alias("up")).distinct()
    found = triples.sparkSession.createDataFrame([(p,) for p in (top, *known)], "p string")
    if below.isEmpty():
        return found
    below, found = written(below, "properties"), written(found, "properties")
    for _ in range(most):
        more = written(found.union(below.join(found.withColumnRenamed("p", "up"), "up", "left_semi").select("p")).distinct(), "properties")
        if more.count() == found.count():
            return found
        found = more
    raise ValueError(f"more than {most} levels of properties below {top}")


def dbpedia(triples: DataFrame) -> DataFrame:
    """Dutch literals of degrees, minutes and seconds, of the coordinate property and those below it."""
    pattern = r"^(\d+)_(\d+)_(\d+)_([NSZ])_(\d+)_(\d+)_(\d+)_([EOW])_type:"
    rows = triples.where((F.col("o_lang") == "nl") & F.col("o").rlike(pattern))
    rows = rows.join(sub_properties(triples, DBPEDIA_COORDINATES, (DBPEDIA_BELOW,)), "p", "left_semi")
    part = lambda i: F.regexp_extract("o", pattern, i)
    angle = lambda i: part(i).cast("double") + part(i + 1).cast("double") / 60 + part(i + 2).cast("double") / 3600
    lat = F.when(part(4) == "N", 1.0).otherwise(-1.0) * angle(1)
    long = F.when(part(8) == "W", -1.0).otherwise(1.0) * angle(5)
    return _shapes(rows.withColumn("shape", point(lat, long)))


def wkt_literals(predicate: str) -> Source:
    """A source of the user's own: literals of a predicate, read as WKT."""
    return lambda triples: _shapes(triples.where(F.col("p") == predicate).withColumn("shape", F.explode(codecs.wkt_shapes(F.col("o")))))


DEFAULT_SOURCES: tuple[Source, ...] = (georss, wgs84, freebase, dbpedia)


def candidates(triples: DataFrame, more: tuple[Source, ...] = ()) -> DataFrame:
    """(uri, shape, source) of all sources, as a bag."""
    return reduce(DataFrame.unionByName, [s(triples) for s in (*DEFAULT_SOURCES, *more)])


def uri_shape(index: DataFrame, found: DataFrame) -> DataFrame:
    """What the index holds, and for identifiers it doesn't know what the triples say.  index: uri, shape, ...; found: candidates()."""
    rest = found.join(index.select("uri").distinct(), "uri", "left_anti")
    return index.select("uri", "shape", F.lit(None).cast("string").alias("source")).unionByName(rest)


def shapes_of_graph(index: DataFrame, found: DataFrame, graph: str) -> DataFrame:
    """graph, uri, shape: what uri_shape gives of one source."""
    return uri_shape(index, found).where(F.col("source") == graph).select(F.col("source").alias("graph"), "uri", "shape")


def time_candidates(triples: DataFrame) -> DataFrame:
    """uri, begin, end (literals, null if open), source.  A subject with several begins or ends in a graph gives every combination."""
    rows = triples.where(F.col("p").isin(SEM + "hasBeginTimeStamp", SEM + "hasEndTimeStamp"))
    side = lambda name: F.collect_set(F.when(F.col("p") == SEM + name, F.col("o"))).alias(name)
    pairs = rows.groupBy("s", "graph").agg(side("hasBeginTimeStamp"), side("hasEndTimeStamp"))
    pairs = pairs.withColumn("begin", F.explode_outer("hasBeginTimeStamp")).withColumn("end", F.explode_outer("hasEndTimeStamp"))
    points = triples.where(F.col("p").isin(SEM + "hasTimeStamp", OWL_TIME + "inXSDDateTime"))
    every = pairs.select("s", "begin", "end", "graph").union(points.select("s", F.col("o").alias("begin"), F.col("o").alias("end"), "graph"))
    return every.select(F.col("s").alias("uri"), "begin", "end", F.col("graph").alias("source"))


def uri_time(triples: DataFrame, offset: float = 0.0) -> DataFrame:
    """uri, t_begin, t_end, source.  Half-open and unreadable times are left out."""
    rows = time_candidates(triples).select("uri", parse_timestamp(F.col("begin"), offset).alias("t_begin"), parse_timestamp(F.col("end"), offset).alias("t_end"), "source")
    return rows.where("t_begin is not null and t_end is not null")


def spacetime_candidates(triples: DataFrame, more: tuple[Source, ...] = ()) -> DataFrame:
    """uri, t_begin, t_end, shape."""
    return uri_time(triples).drop("source").join(candidates(triples, more).drop("source"), "uri")
