"""One query for each operator over the derived views, with SQL that another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types
from ..functions import codecs, kernel, measures, timeops
from ..operators import closure, mutations, spacetime, spatial_join, timeindex
from ..operators import query as q
from ..options import Options
from ..sources import kml_files, triples
from ..storage import new_path, written
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_P = f"({v.GEO_POINTS}) p"
_B = f"({v.GEO_BOXES}) b"
_T = f"({v.times(v.OTHER)}) t"
_S = f"({v.spacetime(v.OTHER)}) s"
_KM = "cast(111.195083724 as double)"


def _d(x: float) -> str:
    return f"cast({x!r} as double)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _round(c: str):
    return F.round(c, 6).alias(c)


# Sources of one shape's query


@query(f"select uri, round(sqrt((x-52)*(x-52)+(y-4)*(y-4)), 6) as distance from {_P} order by sqrt((x-52)*(x-52)+(y-4)*(y-4)), uri limit 10")
def nearest_k(spark, sf):
    return q.nearest(v.point_features(spark, sf), q.Query.point(52.0, 4.0), 10).select("uri", _round("distance"))


@query(f"select uri, round(sqrt((x-52)*(x-52)+(y-4)*(y-4)), 6) as distance from {_P}")
def nearest_all(spark, sf):
    return q.nearest(v.point_features(spark, sf), q.Query.point(52.0, 4.0)).select("uri", _round("distance"))


@query(f"select uri, round(sqrt((x-52)*(x-52)+(y-4)*(y-4))*{_KM}, 6) as distance_km from {_P} where sqrt((x-52)*(x-52)+(y-4)*(y-4))*{_KM} <= 200 order by sqrt((x-52)*(x-52)+(y-4)*(y-4)), uri limit 10")
def nearest_bounded(spark, sf):
    return q.nearest_bounded(v.point_features(spark, sf), q.Query.point(52.0, 4.0), 200.0, k=10).select("uri", _round("distance_km"))


@query(f"select uri, round(sqrt((x-52)*(x-52)+(y-4)*(y-4))*{_KM}, 6) as distance_km from {_P} where uri = 7 and sqrt((x-52)*(x-52)+(y-4)*(y-4))*{_KM} < 1000")
def nearest_bounded_uri(spark, sf):
    return q.nearest_bounded(v.point_features(spark, sf), q.Query.point(52.0, 4.0), 1000.0, uri=7).select("uri", _round("distance_km"))


@query(f"select uri, round(sqrt((x-52)*(x-52)+(y-4)*(y-4))*{_KM}, 6) as distance_km from {_P} where sqrt((x-52)*(x-52)+(y-4)*(y-4))*{_KM} <= 100")
def within_range(spark, sf):
    return q.within_range(v.point_features(spark, sf), q.Query.point(52.0, 4.0), 100.0).select("uri", _round("distance_km"))


@query(f"select uri from {_P} where x > 51 and x < {_d(51.5)} and y > 3 and y < {_d(3.5)}")
def contains_box(spark, sf):
    return q.contains(v.point_features(spark, sf), q.Query.box(51.0, 3.0, 51.5, 3.5)).select("uri")


@query(f"select uri from {_B} where minx >= 51 and maxx <= 52 and miny >= 3 and maxy <= 4")
def contains_box_boxes(spark, sf):
    return q.contains(v.box_features(spark, sf), q.Query.box(51.0, 3.0, 52.0, 4.0)).select("uri")


@query(f"select uri from {_B} where minx <= 52 and maxx >= 51 and miny <= 4 and maxy >= 3")
def intersects_box(spark, sf):
    return q.intersects(v.box_features(spark, sf), q.Query.box(52.0, 4.0, 51.0, 3.0)).select("uri")


@query(f"select uri from {_P} where abs(x-52)+abs(y-4) < {_d(0.71875)}")
def contains_polygon(spark, sf):
    h = 0.71875
    return q.contains(v.point_features(spark, sf), q.Query.polygon([(52 - h, 4.0), (52.0, 4 + h), (52 + h, 4.0), (52.0, 4 - h), (52 - h, 4.0)])).select("uri")


@query(f"select uri from {_P} where x > 51 and x < 53 and y > 3 and y < 5 and not (x >= {_d(51.5)} and x <= {_d(52.5)} and y >= {_d(3.5)} and y <= {_d(4.5)})")
def contains_polygon_hole(spark, sf):
    ring = lambda a, b, c, d: [(a, b), (a, d), (c, d), (c, b), (a, b)]
    return q.contains(v.point_features(spark, sf), q.Query.polygon(ring(51.0, 3.0, 53.0, 5.0), ring(51.5, 3.5, 52.5, 4.5))).select("uri")


# The segment from (50.5, 2.5) to (53.5, 5.5) meets a box iff the box's corners aren't all on one side of x - y = 48 and its ranges overlap.
@query(f"select uri from {_B} where minx <= {_d(53.5)} and maxx >= {_d(50.5)} and miny <= {_d(5.5)} and maxy >= {_d(2.5)} and minx - maxy <= 48 and maxx - miny >= 48")
def intersects_segment_box(spark, sf):
    return q.intersects(v.box_features(spark, sf), q.Query.linestring([(50.5, 2.5), (53.5, 5.5)])).select("uri")


@query(f"select uri from {_P} where sqrt((x-52)*(x-52)+(y-4)*(y-4)) <= {_d(0.5)}")
def intersects_circle(spark, sf):
    return q.intersects(v.point_features(spark, sf), q.Query.circle(52.0, 4.0, 0.5)).select("uri")


@query(f"with b as (select * from {_B}) select a.uri from b a where exists (select 1 from b where b.uri = 1 and a.minx <= b.maxx and a.maxx >= b.minx and a.miny <= b.maxy and a.maxy >= b.miny)")
def uri_query_intersects(spark, sf):
    return q.intersects(v.box_features(spark, sf), 1).select("uri")


# Joins


@query(f"with b as (select * from {_B}) select l.uri as l_uri, r.uri as r_uri from b l join b r on l.minx <= r.maxx and l.maxx >= r.minx and l.miny <= r.maxy and l.maxy >= r.miny where l.uri < r.uri")
def box_box_join(spark, sf):
    b = v.geo_boxes(spark, sf)
    return spatial_join.box_join(b, b, lambda: F.col("l_uri") < F.col("r_uri")).select("l_uri", "r_uri")


@query(f"select b.uri as l_uri, p.uri as r_uri from {_B} join {_P} on p.x > b.minx and p.x < b.maxx and p.y > b.miny and p.y < b.maxy")
def point_box_join(spark, sf):
    inside = lambda: (F.col("r_x") > F.col("l_minx")) & (F.col("r_x") < F.col("l_maxx")) & (F.col("r_y") > F.col("l_miny")) & (F.col("r_y") < F.col("l_maxy"))
    return spatial_join.box_join(v.geo_boxes(spark, sf), v.geo_points(spark, sf), inside).select("l_uri", "r_uri")


@query(f"select c.uri as l_uri, p.uri as r_uri from ({v.CENTRES}) c join {_P} on abs(p.x-c.cx)+abs(p.y-c.cy) < {_d(0.71875)}")
def point_polygon_join(spark, sf):
    return spatial_join.contains_join(v.diamonds(spark, sf), v.point_features(spark, sf)).select("l_uri", "r_uri")


@query(f"""with c as ({v.CENTRES}) select l.uri as l_uri, r.uri as r_uri from c l join c r on l.uri < r.uri and abs(l.cx-r.cx)+abs(l.cy-r.cy) <= {_d(1.4375)}""")
def polygon_polygon_join(spark, sf):
    d = v.diamonds(spark, sf)
    return spatial_join.intersects_join(d, d).where("l_uri < r_uri").select("l_uri", "r_uri")


@query(f"with p as (select * from {_P}) select l.uri as l_uri, r.uri as r_uri from p l join p r on l.uri < r.uri and sqrt((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)) <= {_d(0.03125)}")
def distance_join(spark, sf):
    p = v.point_features(spark, sf)
    return spatial_join.distance_join(p, p, 0.03125).where("l_uri < r_uri").select("l_uri", "r_uri")


@query(
    f"""with p as (select * from {_P}), s as (select s_suppkey as uri, {_d(50.0)}+((s_suppkey*6101)%10007)/{_d(2500.0)} as x, {_d(2.0)}+((s_suppkey*5501)%10009)/{_d(2500.0)} as y from supplier),
r as (select s.uri as q_uri, p.uri as p_uri, sqrt((s.x-p.x)*(s.x-p.x)+(s.y-p.y)*(s.y-p.y)) as d from s cross join p),
n as (select *, cast(row_number() over (partition by q_uri order by d, p_uri) as integer) as rank from r) select q_uri, rank, p_uri, round(d, 6) as distance from n where rank <= 3"""
)
def knn_join(spark, sf):
    s = spark.sql("select s_suppkey as uri, cast(50.0 as double)+((s_suppkey*6101)%10007)/cast(2500.0 as double) as x, cast(2.0 as double)+((s_suppkey*5501)%10009)/cast(2500.0 as double) as y from {s}", s=spark.read.parquet(f"{sf}/supplier.parquet"))
    return spatial_join.knn_join(s, v.geo_points(spark, sf), 3, 0.125).select("q_uri", "rank", "p_uri", _round("distance"))


@query(f"with t as (select * from {_T}) select l.uri as l_uri, r.uri as r_uri from t l join t r on l.uri < r.uri and l.t_begin <= r.t_end and l.t_end >= r.t_begin")
def interval_join(spark, sf):
    t = v.intervals(spark, sf)
    return spatial_join.interval_join(t, t, 30 * 86400.0).where("l_uri < r_uri").select("l_uri", "r_uri")


def _strictly_inside():
    return (F.col("l_x") > F.col("r_minx")) & (F.col("l_x") < F.col("r_maxx")) & (F.col("l_y") > F.col("r_miny")) & (F.col("l_y") < F.col("r_maxy"))


@query(f"select uri from {_P} where exists (select 1 from {_B} where p.x > b.minx and p.x < b.maxx and p.y > b.miny and p.y < b.maxy)")
def semi_has_neighbor(spark, sf):
    return spatial_join.neighbours(v.geo_points(spark, sf), v.geo_boxes(spark, sf), _strictly_inside).select("uri")


@query(f"select uri from {_P} where not exists (select 1 from {_B} where p.x > b.minx and p.x < b.maxx and p.y > b.miny and p.y < b.maxy)")
def anti_no_neighbor(spark, sf):
    return spatial_join.neighbours(v.geo_points(spark, sf), v.geo_boxes(spark, sf), _strictly_inside, anti=True).select("uri")


@query(f"select p.uri as uri, n.n_name as name from {_P} join customer c on c.c_custkey = p.uri left join nation n on n.n_nationkey = c.c_nationkey and n.n_nationkey < 10")
def outer_default(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("uri"), F.col("c_nationkey").alias("k"))
    n = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey < 10").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return v.geo_points(spark, sf).join(c, "uri").join(n, "k", "left").select("uri", "name")


@query(f"""with i as (select * from {_T} where t_end is not null), a as (select event_id as id, {v.OTHER['events']} - 800000000 as t from events),
e as (select t_end, min(uri) as uri from i group by t_end) select a.id, e.uri, e.t_end from a asof join e on a.t >= e.t_end""")
def asof_previous_end(spark, sf):
    a = spark.sql("select event_id as id, unix_micros(cast(ts as timestamp))/cast(1e6 as double) - 800000000 as t from {e}", e=spark.read.parquet(f"{sf}/events.parquet"))
    return timeindex.previous_end_join(a, v.intervals(spark, sf))


# Measures


@query(f"select uri, round(sqrt((x-52)*(x-52)+(y-4)*(y-4))*{_KM}, 6) as km from {_P}")
def distance_pythagorean(spark, sf):
    return v.point_features(spark, sf).select("uri", F.round(measures.shape_pythagorean(types.point(52.0, 4.0), F.col("shape")), 6).alias("km"))


_H = "sin(radians(x-52)/2)*sin(radians(x-52)/2)+cos(radians(52))*cos(radians(x))*sin(radians(y-4)/2)*sin(radians(y-4)/2)"


@query(f"select uri, round(2*atan2(sqrt({_H}), sqrt(1-({_H})))*6371, 6) as km from {_P}")
def distance_greatcircle_km(spark, sf):
    return v.point_features(spark, sf).select("uri", F.round(measures.shape_greatcircle(types.point(52.0, 4.0), F.col("shape"), "km"), 6).alias("km"))


@query(f"select uri, round(2*atan2(sqrt({_H}), sqrt(1-({_H})))*{_d(3440.06)}, 6) as nm from {_P}")
def distance_greatcircle_nm(spark, sf):
    return v.point_features(spark, sf).select("uri", F.round(measures.shape_greatcircle(types.point(52.0, 4.0), F.col("shape")), 6).alias("nm"))


@query(f"select uri, round(degrees(atan2(sin(radians(y-4))*cos(radians(x)), cos(radians(52))*sin(radians(x))-sin(radians(52))*cos(radians(x))*cos(radians(y-4)))), 6) as bearing from {_P}")
def bearing(spark, sf):
    return v.point_features(spark, sf).select("uri", F.round(measures.shape_bearing(types.point(52.0, 4.0), F.col("shape")), 6).alias("bearing"))


_GY = "greatest(miny-4, 4-maxy, 0)"


@query(f"select uri, round(sqrt(greatest(minx-52, 52-maxx, 0)*greatest(minx-52, 52-maxx, 0)+{_GY}*{_GY})*{_KM}, 6) as km from {_B}")
def shape_distance(spark, sf):
    return v.box_features(spark, sf).select("uri", F.round(measures.shape_distance(types.point(52.0, 4.0), F.col("shape")), 6).alias("km"))


@query(f"select uri, round(sqrt(greatest(minx-52, 52-maxx, 0)*greatest(minx-52, 52-maxx, 0)+{_GY}*{_GY}), 6) as degrees from {_B}")
def kernel_distance(spark, sf):
    return v.box_features(spark, sf).select("uri", F.round(kernel.distance(types.point(52.0, 4.0), F.col("shape")), 6).alias("degrees"))


# Two boxes touch if their closed ranges meet but their open ones don't.
@query(f"select uri from {_B} where minx <= 52 and maxx >= 51 and miny <= 4 and maxy >= 3 and not (minx < 52 and maxx > 51 and miny < 4 and maxy > 3)")
def touches_box(spark, sf):
    return v.box_features(spark, sf).where(kernel.touches(types.box(51.0, 3.0, 52.0, 4.0), F.col("shape"), ("box",), ("box",))).select("uri")


@query(f"select uri, cast(2 as integer) as dim, uri % 5 <> 0 as ok from {_P} where uri % 5 <> 0 union all select uri, null, false from {_P} where uri % 5 = 0")
def shape_dim(spark, sf):
    shape = types.point(F.col("x"), F.when(F.col("uri") % 5 != 0, F.col("y")))
    return v.geo_points(spark, sf).select("uri", types.dimensionality(shape).alias("dim"), types.is_shape(shape).alias("ok"))


@query(f"select uri, cx-{_d(0.71875)} as minx, cy-{_d(0.71875)} as miny, cx+{_d(0.71875)} as maxx, cy+{_d(0.71875)} as maxy, cx as centre_x, cy as centre_y from ({v.CENTRES}) c")
def mbr(spark, sf):
    c = types.centre(F.col("shape"))
    return v.diamonds(spark, sf).select("uri", "minx", "miny", "maxx", "maxy", c["x"].alias("centre_x"), c["y"].alias("centre_y"))


@query(f"select uri, 5 as points, minx + maxx as sum_x from {_B}")
def box_polygon(spark, sf):
    ring = F.col("shape")["rings"][0]
    return v.box_features(spark, sf).select("uri", F.size(ring).alias("points"), (ring[0]["x"] + ring[2]["x"]).alias("sum_x"))


@query(f"select cast(floor(minx) as bigint) as cx, cast(floor(miny) as bigint) as cy, min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy, count(*) as n from {_B} group by 1, 2")
def partition_mbrs(spark, sf):
    return q.partition_mbrs(v.geo_boxes(spark, sf))


# Codecs.  Numbers are read from and written as text of multiples of 1/64, which both engines show alike.


@query(f"select uri, minx as x, miny as y, 'point' as kind from {_B}")
def wkt_parse(spark, sf):
    text = F.format_string("POINT(%s %s)", F.col("minx").cast("string"), F.col("miny").cast("string"))
    s = codecs.wkt_shape(text)
    return v.geo_boxes(spark, sf).select("uri", s["rings"][0][0]["x"].alias("x"), s["rings"][0][0]["y"].alias("y"), s["kind"].alias("kind"))


@query(f"select uri, i as part, case when i = 0 then minx else maxx end as x from {_B} cross join (values (0), (1)) t(i)")
def wkt_parse_collection(spark, sf):
    text = F.format_string("GEOMETRYCOLLECTION(POINT(%s 1), LINESTRING(%s 2, 3 4))", F.col("minx").cast("string"), F.col("maxx").cast("string"))
    return v.geo_boxes(spark, sf).select("uri", F.posexplode(codecs.wkt_shapes(text)).alias("part", "s")).select("uri", "part", F.col("s")["rings"][0][0]["x"].alias("x"))


def _text(e: str) -> str:
    return f"case when {e} = floor({e}) then cast(cast({e} as bigint) as varchar) else cast({e} as varchar) end"


@query(f"select uri, 'POINT(' || {_text('minx')} || ' ' || {_text('miny')} || ')' as wkt from {_B}")
def wkt_format(spark, sf):
    return v.geo_boxes(spark, sf).select("uri", codecs.shape_wkt(types.point(F.col("minx"), F.col("miny"))).alias("wkt"))


@query(f"select uri, '<gml:Point><gml:pos>' || {_text('minx')} || ' ' || {_text('miny')} || '</gml:pos></gml:Point>' as gml from {_B}")
def gml_format(spark, sf):
    return v.geo_boxes(spark, sf).select("uri", codecs.shape_gml(types.point(F.col("minx"), F.col("miny"))).alias("gml"))


@query(f"select uri, minx, miny, maxx, maxy from {_B}")
def gml_parse(spark, sf):
    back = codecs.gml_shape(codecs.shape_gml(F.col("shape")))
    return v.box_features(spark, sf).select("uri", back.alias("shape")).select("uri", *[c.alias(k) for k, c in types.mbr(F.col("shape")).items()])


@query(f"select uri, '<Point><coordinates>' || {_text('miny')} || ',' || {_text('minx')} || '</coordinates></Point>' as kml from {_B}")
def kml_format(spark, sf):
    return v.geo_boxes(spark, sf).select("uri", codecs.shape_kml(types.point(F.col("minx"), F.col("miny"))).alias("kml"))


@query(f"select uri, minx, miny, maxx, maxy from {_B}")
def kml_parse(spark, sf):
    back = codecs.kml_shape(codecs.shape_kml(F.col("shape")))
    return v.box_features(spark, sf).select("uri", back.alias("shape")).select("uri", *[c.alias(k) for k, c in types.mbr(F.col("shape")).items()])


@query(f"select uri, '<Placemark><Point id=\"' || uri || '\"><coordinates>' || {_text('miny')} || ',' || {_text('minx')} || '</coordinates></Point></Placemark>' as value from {_B}")
def kml_placemarks(spark, sf):
    rows = v.geo_boxes(spark, sf).select("uri", types.point(F.col("minx"), F.col("miny")).alias("shape"))
    return kml_files.placemarks(rows)


@query(f"select uri as s, 'http://www.georss.org/georss/point' as p, {_text('minx')} || ' ' || {_text('miny')} as o from {_B}")
def georss_triples(spark, sf):
    return kml_files.georss_triples(v.geo_boxes(spark, sf).select("uri", types.point(F.col("minx"), F.col("miny")).alias("shape")))


def _triples(rows: DataFrame, **pairs) -> DataFrame:
    """A triple a row and predicate: subject uri, objects given as columns; typed, in one graph."""
    items = [F.struct(F.lit(p).alias("p"), o.cast("string").alias("o")) for p, o in pairs.items()]
    x = F.explode(F.array(*items))
    return rows.select(F.col("uri").cast("string").alias("s"), x.alias("x")).select("s", "x.p", "x.o", F.lit("double").alias("o_type"), F.lit(None).cast("string").alias("o_lang"), F.lit("g").alias("graph"))


@query(f"select cast(uri as varchar) as uri, minx as x, miny as y from {_B}")
def wgs84_pivot(spark, sf):
    t = _triples(v.geo_boxes(spark, sf), **{triples.WGS84 + "lat": F.col("minx"), triples.WGS84 + "long": F.col("miny")})
    p = F.col("shape")["rings"][0][0]
    return triples.wgs84(t).select("uri", p["x"].alias("x"), p["y"].alias("y"))


@query(f"select cast(uri as varchar) as uri, minx, miny, maxx, maxy from {_B}")
def georss_candidates(spark, sf):
    corners = F.concat_ws("  ", *[F.col(c).cast("string") for c in ("minx", "miny", "maxx", "maxy")])
    t = _triples(v.geo_boxes(spark, sf), **{codecs.GEORSS + "box": corners})
    return triples.georss(t).select("uri", *[c.alias(k) for k, c in types.mbr(F.col("shape")).items()])


@query(f"select cast(uri as varchar) as uri, minx as x, miny as y from {_B}")
def freebase_candidates(spark, sf):
    b = v.geo_boxes(spark, sf)
    hop = _triples(b, **{triples.FREEBASE + "location.location.geolocation": F.concat(F.lit("_:"), "uri")})
    node = _triples(b.withColumn("uri", F.concat(F.lit("_:"), "uri")), **{triples.FREEBASE + "location.geocode.latitude": F.col("minx"), triples.FREEBASE + "location.geocode.longitude": F.col("miny")})
    p = F.col("shape")["rings"][0][0]
    return triples.freebase(hop.union(node)).select("uri", p["x"].alias("x"), p["y"].alias("y"))


@query(f"select cast(uri as varchar) as uri, 1 + (uri % 60) / {_d(60.0)} + 30 / {_d(3600.0)} as x, -(4 + (uri % 60) / {_d(60.0)} + 0 / {_d(3600.0)}) as y from {_B}")
def dbpedia_candidates(spark, sf):
    minutes = (F.col("uri") % 60).cast("string")
    text = F.concat(F.lit("1_"), minutes, F.lit("_30_N_4_"), minutes, F.lit("_0_W_type:city"))
    t = _triples(v.geo_boxes(spark, sf), **{triples.DBPEDIA + "coordinateProperty": text}).withColumn("o_lang", F.lit("nl"))
    p = F.col("shape")["rings"][0][0]
    return triples.dbpedia(t).select("uri", p["x"].alias("x"), p["y"].alias("y"))


@query(f"select cast(uri as varchar) as uri, t_begin, t_end from {_T} where uri % 3 <> 0")
def uri_time(spark, sf):
    rows = v.intervals(spark, sf).withColumn("t_end", F.when(F.col("uri") % 3 != 0, F.col("t_end")))
    t = _triples(rows, **{triples.SEM + "hasBeginTimeStamp": timeops.format_timestamp(F.col("t_begin")), triples.SEM + "hasEndTimeStamp": timeops.format_timestamp(F.col("t_end"))}).where("o is not null")
    return triples.uri_time(t).select("uri", "t_begin", "t_end")


@query(f"select uri, minx as x from {_B} where uri % 2 = 0 union all select uri, maxx as x from {_B} where uri % 2 = 1")
def index_shadows_triples(spark, sf):
    b = v.geo_boxes(spark, sf)
    index = b.where("uri % 2 = 0").select("uri", types.point(F.col("minx"), F.col("miny")).alias("shape"))
    found = b.select("uri", types.point(F.col("maxx"), F.col("maxy")).alias("shape"), F.lit("g").alias("source"))
    return triples.uri_shape(index, found).select("uri", F.col("shape")["rings"][0][0]["x"].alias("x"))


# Mutations


@query(f"select uri, x, y from (select *, row_number() over (partition by uri, x, y order by seq desc) as n from ({v.MUTATIONS}) m) t where n = 1 and op = 'assert'")
def mutation_fold(spark, sf):
    return mutations.fold(v.mutation_log(spark, sf).withColumn("index", F.lit("i")), ["index", "uri", "x", "y"]).select("uri", "x", "y")


# Before the load, what waits is what came after the flush and after the last op of the other kind.
@query(f"""with m as ({v.MUTATIONS}), k as (select max(seq) // 2 as mid from m),
w as (select max(case when op = 'assert' then seq else -1 end) as a, max(case when op = 'retract' then seq else -1 end) as r from m, k where seq < mid),
live as (select m.* from m, k, w where seq >= mid or (seq > mid - 40 and seq > case when op = 'assert' then r else a end)
union all select -1, 'assert', uri, cast(60 as double), cast(9 as double) from m group by uri)
select uri, x, y from (select *, row_number() over (partition by uri, x, y order by seq desc) as n from live) t where n = 1 and op = 'assert'""")
def bulkload_replace(spark, sf):
    m = v.mutation_log(spark, sf).withColumn("index", F.lit("i"))
    mid = int(m.agg(F.max("seq")).first()[0]) // 2
    load = m.select("uri").distinct().select(F.lit(mid).cast("long").alias("seq"), F.lit("bulkload").alias("op"), "uri", F.lit(60.0).alias("x"), F.lit(9.0).alias("y"), F.lit("i").alias("index"))
    old = load.withColumn("seq", F.lit(mid - 60).cast("long")).withColumn("x", F.lit(70.0))
    log = m.unionByName(load).unionByName(old).unionByName(mutations.mark("flush", mid - 40, m, "i"))
    return mutations.fold(log, ["index", "uri", "x", "y"]).select("uri", "x", "y")


@query(f"""with m as ({v.MUTATIONS}), c as (select max(seq) // 2 as mid from m), r as (select uri, x, y, op, row_number() over (partition by uri, x, y order by seq desc) as n from m, c where seq > mid)
select uri, x, y from r where n = 1 and op = 'assert'""")
def clear_index(spark, sf):
    m = v.mutation_log(spark, sf).withColumn("index", F.lit("i"))
    mid = int(m.agg(F.max("seq")).first()[0]) // 2
    return mutations.fold(m.unionByName(mutations.mark("clear", mid, m, "i")), ["index", "uri", "x", "y"]).select("uri", "x", "y")


# Time


@query(f"select distinct uri from {_T} where t_begin between 899500000 and 899900000 or t_end between 899500000 and 899900000")
def time_intersects_compat(spark, sf):
    return timeindex.time_intersects(v.intervals(spark, sf), 899500000.0, 899900000.0)


@query(f"select distinct uri from {_T} where t_begin <= 900000000 and t_end >= 899000000")
def time_intersects_full(spark, sf):
    return timeindex.time_intersects(v.intervals(spark, sf), 899000000.0, 900000000.0, "full")


@query(f"select distinct uri from {_T} where t_begin >= 890000000 and t_end <= 900000000")
def time_contains(spark, sf):
    return timeindex.time_contains(v.intervals(spark, sf), 890000000.0, 900000000.0)


@query(f"select distinct uri from {_T}")
def time_contains_open(spark, sf):
    return timeindex.time_contains(v.intervals(spark, sf))


@query(f"select uri, t_end from {_T} where t_end <= 900000000 order by t_end desc, uri limit 20")
def time_prev_end(spark, sf):
    return timeindex.time_prev_end(v.intervals(spark, sf), 900000000.0, 20).select("uri", "t_end")


@query(f"select uri, t_begin from {_T} where t_begin >= 900000000 order by t_begin, uri limit 20")
def time_next_begin(spark, sf):
    return timeindex.time_next_begin(v.intervals(spark, sf), 900000000.0, 20).select("uri", "t_begin")


@query(f"select count(*) as size from {_T}")
def time_index_size(spark, sf):
    return timeindex.size(v.intervals(spark, sf))


@query(f"select uri, round(t_begin - {_d(1000.25)}) as t_begin, round(t_end - {_d(1000.25)}) as t_end from {_T}")
def time_index_rounded(spark, sf):
    return timeindex.rounded(v.intervals(spark, sf), 1000.25).select("uri", "t_begin", "t_end")


_QB, _QE = 899000000, 900000000
_RELATIONS = {
    "time_before": (timeops.before, f"t_end < {_QB}"),
    "time_after": (timeops.after, f"t_begin > {_QE}"),
    "time_meets": (timeops.meets, f"t_end = {_QB}"),
    "time_overlaps": (timeops.overlaps, f"t_begin <= {_QE} and t_end >= {_QB}"),
    "time_overlaps_inverse": (timeops.overlaps_inverse, f"t_begin <= {_QE} and t_end >= {_QB}"),
    "time_during": (timeops.during, f"t_begin <= {_QB} and t_end >= {_QE}"),
    "time_during_inverse": (timeops.during_inverse, f"t_begin >= {_QB} and t_end <= {_QE}"),
    "time_starts": (timeops.starts, f"t_begin = {_QB} and t_end <= {_QE}"),
    "time_starts_inverse": (timeops.starts_inverse, f"t_begin = {_QB} and t_end >= {_QE}"),
    "time_finishes": (timeops.finishes, f"t_end = {_QE} and t_begin >= {_QB}"),
    "time_finishes_inverse": (timeops.finishes_inverse, f"t_end = {_QE} and t_begin <= {_QB}"),
    "time_meets_inverse": (timeops.meets_inverse, f"t_begin = {_QE}"),
    "time_equal": (timeops.equal, f"t_begin = {_QB} and t_end = {_QE}"),
    "allen_during": (timeops.allen_during, f"t_begin > {_QB} and t_end < {_QE}"),
    "allen_overlaps": (timeops.allen_overlaps, f"t_begin < {_QB} and t_end > {_QB} and t_end < {_QE}"),
}


def _relation(name: str, relation, where: str) -> None:
    # The bounds are those of an order, so that relations of equal bounds have rows: whole days near the constants.
    b, e = 898992000, 899942400
    where = where.replace(str(_QB), str(b)).replace(str(_QE), str(e))

    def run(spark, sf):
        return v.intervals(spark, sf).where(relation(timeops.Interval.of("t_begin", "t_end"), timeops.Interval.of(float(b), float(e)))).select("uri")

    run.__name__ = name
    query(f"select uri from {_T} where {where}")(run)


for _name, (_f, _w) in _RELATIONS.items():
    _relation(_name, _f, _w)


@query(f"select uri, t_begin-60 as eb, t_end+60 as ee, t_begin-30 as bb, t_end+30 as ae, t_end-t_begin as d, t_begin-5 as db, t_end+5 as da from {_T}")
def time_expand(spark, sf):
    t = timeops.Interval.of("t_begin", "t_end")
    x = timeops.expand(t, 60.0)
    narrow = timeops.expand_before(t, 30.0).begin.alias("bb"), timeops.expand_after(t, 30.0).end.alias("ae")
    return v.intervals(spark, sf).select("uri", x.begin.alias("eb"), x.end.alias("ee"), *narrow, timeops.duration(t).alias("d"), timeops.duration_before(t, 5.0).begin.alias("db"), timeops.duration_after(t, 5.0).begin.alias("da"))


@query(f"select uri, case when t_end < {_QB} then {_QE}-t_begin else -(t_end-{_QB}) end as d from {_T}")
def time_duration_signed(spark, sf):
    return v.intervals(spark, sf).select("uri", timeops.signed_duration(timeops.Interval.of("t_begin", "t_end"), timeops.Interval.of(float(_QB), float(_QE))).alias("d"))


@query(f"select uri, case when t_end < {_QB} then {_QB}-t_end else -(t_begin-{_QE}) end as d from {_T}")
def time_between_signed(spark, sf):
    return v.intervals(spark, sf).select("uri", timeops.signed_between(timeops.Interval.of("t_begin", "t_end"), timeops.Interval.of(float(_QB), float(_QE))).alias("d"))


@query(f"select uri, strftime(make_timestamp(cast(t_begin as bigint)*1000000), '%Y-%m-%dT%H:%M:%SZ') as text, t_begin as back from {_T}")
def timestamp_text(spark, sf):
    text = timeops.format_timestamp(F.col("t_begin"))
    return v.intervals(spark, sf).select("uri", text.alias("text"), timeops.parse_timestamp(text).alias("back"))


@query(f"select uri, cast(year(z)-1970 as integer) as years, cast(month(z)-1 as integer) as months, cast(day(z)-1 as integer) as days from (select uri, make_timestamp(cast(t_begin as bigint)*1000000) as z from {_T}) t")
def timestamp_duration(spark, sf):
    d = timeops.timestamp_duration(F.col("t_begin"))
    return v.intervals(spark, sf).select("uri", d["years"].alias("years"), d["months"].alias("months"), d["days"].alias("days"))


@query(f"select uri, cast(1 as integer) as years, cast(2 as integer) as months, cast(uri % 7 as integer) as days, cast(3 as integer) as hours, cast(4 as integer) as minutes, uri % 60 + {_d(0.5)} as seconds, 'P1Y2M' || (uri % 7) || 'DT3H4M' || (uri % 60) || '.5S' as back from {_T}")
def duration_text(spark, sf):
    text = F.concat(F.lit("P1Y2M"), (F.col("uri") % 7).cast("string"), F.lit("DT3H4M"), (F.col("uri") % 60).cast("string"), F.lit(".5S"))
    rows = v.intervals(spark, sf).select("uri", timeops.parse_duration(text).alias("d"))
    return rows.select("uri", "d.*", timeops.format_duration(F.col("d")).alias("back"))


# Space and time


@query(f"select uri, unnest(range(cast(floor(t_begin/864000) as bigint), cast(floor(t_end/864000) as bigint)+1)) * {_d(864000.0)} as bucket from {_T}")
def buckets(spark, sf):
    return v.intervals(spark, sf).select("uri", F.explode(spacetime.buckets(F.col("t_begin"), F.col("t_end"), 864000.0)).alias("bucket"))


@query(f"select uri from {_S} where t_begin between 1704500000 and 1704600000 and x >= 51 and x <= 53 and y >= 3 and y <= 5")
def spacetime_intersects(spark, sf):
    table = spacetime.bucketed(v.spacetime_features(spark, sf), 86400.0)
    return spacetime.spacetime_intersects(table, q.Query.box(51.0, 3.0, 53.0, 5.0), 1704500000.0, 1704600000.0).select("uri")


@query(f"select uri, round(sqrt((x-52)*(x-52)+(y-4)*(y-4))*{_KM}, 6) as distance_km from {_S} where t_begin between 1704500000-3600 and 1704600000+3600 and sqrt((x-52)*(x-52)+(y-4)*(y-4))*{_KM} <= 100")
def spacetime_within_range(spark, sf):
    table = spacetime.bucketed(v.spacetime_features(spark, sf), 86400.0)
    return spacetime.spacetime_within_range(table, q.Query.point(52.0, 4.0), 1704500000.0, 1704600000.0, 100.0, 3600.0).select("uri", _round("distance_km"))


@query(f"with recursive l as ({v.LINKS}), r(node, depth) as (select cast(0 as bigint), 0 union all select l.dst, r.depth+1 from r join l on l.src = r.node) select node, min(depth) as depth from r group by node")
def reachable(spark, sf):
    return closure.reachable(v.link_table(spark, sf), spark.range(1).select(F.col("id").alias("node")))


# Set operations of the host language


@query(f"with p as (select * from {_P}) select uri from p where x < 52 intersect select uri from p where y < 4")
def intersect_uris(spark, sf):
    p = v.geo_points(spark, sf)
    return p.where("x < 52").select("uri").intersect(p.where("y < 4").select("uri"))


@query(f"with p as (select * from {_P}) select uri from p where x < 52 union all select uri from p where y < 4")
def union_all_uris(spark, sf):
    p = v.geo_points(spark, sf)
    return p.where("x < 52").select("uri").unionByName(p.where("y < 4").select("uri"))


@query(f"with p as (select * from {_P}) select uri from p where x < 52 except select uri from p where y < 4")
def except_uris(spark, sf):
    p = v.geo_points(spark, sf)
    return p.where("x < 52").select("uri").exceptAll(p.where("y < 4").select("uri"))


@query(f"select cast(floor(x) as bigint) as cell, count(*) as n, list(uri order by uri)[1] as first from {_P} group by 1")
def collect_per_cell(spark, sf):
    return v.geo_points(spark, sf).groupBy(F.floor("x").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.array_min(F.collect_list("uri")).alias("first"))


# Polygons with holes

_RINGS = ([(50.0, 2.0), (50.0, 6.0), (54.0, 6.0), (54.0, 2.0), (50.0, 2.0)], [(51.0, 3.0), (51.0, 4.0), (52.0, 4.0), (52.0, 3.0), (51.0, 3.0)])
# The boxes, and one that is the hole itself.
_BH = f"(select uri, minx, miny, maxx, maxy from {_B} union all select cast(-1 as bigint), {_d(51.0)}, {_d(3.0)}, {_d(52.0)}, {_d(4.0)}) b"


def _with_hole(spark, sf):
    hole = spark.range(1).select(F.lit(-1).cast("long").alias("uri"), types.make("polygon", F.array(types.box_ring(51.0, 3.0, 52.0, 4.0))).alias("shape"))
    return v.polygon_features(spark, sf).unionByName(types.with_mbr(hole))


@query(f"select uri from {_BH} where minx >= 50 and maxx <= 54 and miny >= 2 and maxy <= 6 and not (minx < 52 and maxx > 51 and miny < 4 and maxy > 3)")
def contains_polygon_around_hole(spark, sf):
    return q.contains(_with_hole(spark, sf), q.Query.polygon(*_RINGS)).select("uri")


@query(f"select uri from {_BH} where minx >= 51 and maxx <= 52 and miny >= 3 and maxy <= 4 and (minx = 51 or maxx = 52 or miny = 3 or maxy = 4)")
def touches_polygon_in_hole(spark, sf):
    return _with_hole(spark, sf).where(kernel.touches(q.Query.polygon(*_RINGS).shape, F.col("shape"), ("polygon",))).select("uri")


@query(f"select uri from {_BH} where not (minx > 51 and maxx < 52 and miny > 3 and maxy < 4)")
def intersects_polygon_hole(spark, sf):
    return q.intersects(_with_hole(spark, sf), q.Query.polygon(*_RINGS)).select("uri")


# A feature's identifier in the place of a shape


@query(f"with b as (select * from {_B}) select a.uri from b a join b o on o.uri = 3 and a.minx >= o.minx and a.maxx <= o.maxx and a.miny >= o.miny and a.maxy <= o.maxy")
def uri_query_contains(spark, sf):
    return q.contains(v.box_features(spark, sf), 3).select("uri")


@query(f"with p as (select * from {_P}) select a.uri, round(sqrt((a.x-o.x)*(a.x-o.x)+(a.y-o.y)*(a.y-o.y)), 6) as distance from p a join p o on o.uri = 5 order by sqrt((a.x-o.x)*(a.x-o.x)+(a.y-o.y)*(a.y-o.y)), a.uri limit 10")
def uri_query_nearest(spark, sf):
    return q.nearest(v.point_features(spark, sf), 5, 10).select("uri", _round("distance"))


@query(f"with p as (select * from {_P}) select a.uri, round(sqrt((a.x-o.x)*(a.x-o.x)+(a.y-o.y)*(a.y-o.y))*{_KM}, 6) as distance_km from p a join p o on o.uri = 5 where sqrt((a.x-o.x)*(a.x-o.x)+(a.y-o.y)*(a.y-o.y))*{_KM} <= 50")
def uri_query_within_range(spark, sf):
    return q.within_range(v.point_features(spark, sf), 5, 50.0).select("uri", _round("distance_km"))


@query(f"with p as (select * from {_P}) select round(sqrt((a.x-o.x)*(a.x-o.x)+(a.y-o.y)*(a.y-o.y))*{_KM}, 6) as distance_km from p a join p o on a.uri = 9 and o.uri = 5")
def uri_distance(spark, sf):
    return q.distance_km(v.point_features(spark, sf), 9, 5).select(_round("distance_km"))


@query(f"select uri, round(2*atan2(sqrt({_H}), sqrt(1-({_H})))*6371, 6) as distance from {_P} order by 2*atan2(sqrt({_H}), sqrt(1-({_H})))*6371, uri limit 10")
def nearest_by_options(spark, sf):
    chosen = Options().set(distance_function="haversine")
    return q.nearest(v.point_features(spark, sf), q.Query.point(52.0, 4.0), 10, options=chosen).select("uri", _round("distance"))


# Stored indices


@query(f"select uri from {_P} where x > 51 and x < {_d(51.5)} and y > 3 and y < {_d(3.5)}")
def stored_contains_box(spark, sf):
    path = new_path(spark, "features")
    q.store(v.point_features(spark, sf), path, options=Options().set(cell_size=0.5, target_rows_per_file=100_000))
    return q.contains(spark.read.parquet(path), q.Query.box(51.0, 3.0, 51.5, 3.5)).select("uri")


_L = f"({v.lasting(v.OTHER)}) s"


@query(f"select uri from {_L} where t_begin <= 1704600000 and t_end >= 1704500000 and x >= 51 and x <= 53 and y >= 3 and y <= 5")
def spacetime_stored_intersects(spark, sf):
    path = new_path(spark, "spacetime")
    spacetime.store(v.lasting_features(spark, sf), path, 864000.0)
    return spacetime.spacetime_intersects(spark.read.parquet(path), q.Query.box(51.0, 3.0, 53.0, 5.0), 1704500000.0, 1704600000.0).select("uri")


@query(f"select uri, round(sqrt((x-52)*(x-52)+(y-4)*(y-4))*{_KM}, 6) as distance_km from {_L} where t_begin <= 1704600000+3600 and t_end >= 1704500000-3600 and sqrt((x-52)*(x-52)+(y-4)*(y-4))*{_KM} <= 100")
def spacetime_lasting_within_range(spark, sf):
    index = spacetime.bucketed(v.lasting_features(spark, sf), 43200.0)
    return spacetime.spacetime_within_range(index, q.Query.point(52.0, 4.0), 1704500000.0, 1704600000.0, 100.0, 3600.0).select("uri", _round("distance_km"))


@query(f"select bucket, {_d(86400.0)} as bucket_size, count(*) as n from (select unnest(range(cast(floor(t_begin/86400) as bigint), cast(floor(t_end/86400) as bigint)+1)) * {_d(86400.0)} as bucket from {_L}) b group by 1")
def spacetime_indices(spark, sf):
    return spacetime.indices(spacetime.bucketed(v.lasting_features(spark, sf)))


@query(f"select uri, unnest(list_transform(range(0, greatest(cast(ceil((t_end+864000-t_begin)/864000) as bigint), 1)), lambda i: floor((t_begin+i*864000)/864000)*{_d(864000.0)})) as bucket from {_T}")
def buckets_stepping(spark, sf):
    return v.intervals(spark, sf).select("uri", F.explode(spacetime.buckets_stepping(F.col("t_begin"), F.col("t_end"), 864000.0)).alias("bucket")).withColumn("bucket", F.col("bucket").cast("double"))


# As-of joins


def _asks(spark, sf):
    return spark.sql("select event_id as id, unix_micros(cast(ts as timestamp))/cast(1e6 as double) - 800000000 as t from {e}", e=spark.read.parquet(f"{sf}/events.parquet"))


@query(f"""with i as (select 'http://example.org/' || uri as uri, t_end from {_T}), a as (select event_id as id, {v.OTHER['events']} - 800000000 as t from events),
e as (select t_end, min(uri) as uri from i group by t_end) select a.id, e.uri, e.t_end from a asof join e on a.t >= e.t_end""")
def asof_previous_end_of_names(spark, sf):
    named = v.intervals(spark, sf).withColumn("uri", F.concat(F.lit("http://example.org/"), F.col("uri").cast("string")))
    return timeindex.previous_end_join(_asks(spark, sf), named)


@query(f"""with i as (select * from {_T}), a as (select event_id as id, {v.OTHER['events']} - 850000000 as t from events),
e as (select t_begin, min(uri) as uri from i group by t_begin) select a.id, e.uri, e.t_begin from a asof join e on a.t <= e.t_begin""")
def asof_next_begin(spark, sf):
    return timeindex.next_begin_join(_asks(spark, sf).withColumn("t", F.col("t") - 50000000), v.intervals(spark, sf))


# The log of a time index


def _time_log(spark, sf):
    """All intervals put in, those of every third uri taken out, and every sixth put in again."""
    t = v.intervals(spark, sf)
    puts = timeindex.ops(t, "assert", 1, "i")
    return puts.unionByName(timeindex.ops(t.where("uri % 3 = 0"), "retract", 2, "i")).unionByName(timeindex.ops(t.where("uri % 6 = 0").drop("t_end"), "assert", 3, "i"))


@query(f"select uri, t_begin, t_end from {_T} where uri % 3 <> 0 or (uri % 6 = 0 and t_end = t_begin) union all select uri, t_begin, t_begin as t_end from {_T} where uri % 6 = 0 and t_end <> t_begin")
def time_log_fold(spark, sf):
    return timeindex.fold(_time_log(spark, sf)).select("uri", "t_begin", "t_end")


@query(f"select 'i' as index, min(t_begin) as epoch from {_T} union all select 'j' as index, min(t_begin) as epoch from {_T} where uri % 3 = 0")
def time_epochs(spark, sf):
    log = _time_log(spark, sf)
    other = log.withColumn("index", F.lit("j")).where("op = 'assert' and seq = 1")
    again = timeindex.ops(v.intervals(spark, sf).where("uri % 3 = 0"), "assert", 8, "j")
    return timeindex.epochs(log.unionByName(other).unionByName(mutations.mark("clear", 7, log, "j")).unionByName(again))


@query(f"select cast(uri as varchar) as uri, t_begin, t_end from {_T}")
def time_index_all(spark, sf):
    rows = v.intervals(spark, sf)
    t = _triples(rows, **{triples.SEM + "hasBeginTimeStamp": timeops.format_timestamp(F.col("t_begin")), triples.SEM + "hasEndTimeStamp": timeops.format_timestamp(F.col("t_end"))})
    stale = timeindex.ops(rows.select(F.lit("old").alias("uri"), "t_begin", "t_end").limit(1), "bulkload", 1)
    return timeindex.fold(stale.unionByName(timeindex.index_all(t, 2))).select("uri", "t_begin", "t_end")


# Sources: one feature of each kind


def _xy(spark, sf):
    return v.geo_boxes(spark, sf).select("uri", F.col("minx").alias("x"), F.col("miny").alias("y"), "maxx", "maxy")


def _place(rows: DataFrame, *more: str) -> DataFrame:
    p = F.col("shape")["rings"][0][0]
    return rows.select("uri", p["x"].alias("x"), p["y"].alias("y"), *more)


@query(f"select cast(uri as varchar) as uri, minx as x, miny as y, case when uri % 2 = 0 then maxx end as z from {_B} where uri % 4 <> 1")
def wgs84_altitudes(spark, sf):
    rows = _xy(spark, sf)
    flat = _triples(rows, **{triples.WGS84 + "lat": F.col("x"), triples.WGS84 + "long": F.col("y")})
    high = _triples(rows, **{triples.WGS84 + "alt": F.col("maxx")})
    # Even ones have their altitude in the same graph; of the odd ones, every other has it in another, and no point then.
    other = high.where("cast(s as bigint) % 4 = 1").withColumn("graph", F.lit("other"))
    found = triples.wgs84(flat.unionByName(high.where("cast(s as bigint) % 2 = 0")).unionByName(other))
    return found.select("uri", *[F.col("shape")["rings"][0][0][c].alias(c) for c in "xyz"])


@query(f"select cast(uri as varchar) as uri, minx as value, 'g' as source from {_B}")
def wgs84_latitudes(spark, sf):
    t = _triples(_xy(spark, sf), **{triples.WGS84 + "lat": F.col("x"), triples.WGS84 + "long": F.col("y")})
    return triples.wgs84_value(t, "lat")


@query(f"""select cast(uri as varchar) as uri, case cast(uri % 4 as integer) when 0 then 'point' when 1 then 'linestring' when 2 then 'polygon' else 'circle' end as kind,
cast(case cast(uri % 4 as integer) when 1 then 2 when 2 then 5 else 1 end as integer) as points, case when uri % 4 = 3 then {_d(0.5)} end as radius from {_B}""")
def georss_kinds(spark, sf):
    a, b, c, d = (F.col(n).cast("string") for n in ("x", "y", "maxx", "maxy"))
    text = {"point": [a, b], "line": [a, b, c, d], "polygon": [a, b, a, d, c, d, c, b, a, b], "circle": [a, b, F.lit("0.5")]}
    rows = [_triples(_xy(spark, sf).where(F.col("uri") % 4 == i), **{codecs.GEORSS + name: F.concat_ws(" ", *parts)}) for i, (name, parts) in enumerate(text.items())]
    shape = F.col("shape")
    return triples.georss(rows[0].union(rows[1]).union(rows[2]).union(rows[3])).select("uri", shape["kind"].alias("kind"), F.size(shape["rings"][0]).alias("points"), shape["radius"].alias("radius"))


@query(f"select cast(uri as varchar) as uri, minx as x, miny as y from {_B}")
def georss_gml_candidates(spark, sf):
    rows = _xy(spark, sf)
    t = _triples(rows, **{codecs.GEORSS + "where": codecs.shape_gml(types.point(F.col("x"), F.col("y")))})
    return _place(triples.georss_gml(t))


@query(f"select cast(uri as varchar) as uri, minx as x, miny as y from {_B}")
def wkt_literal_candidates(spark, sf):
    t = _triples(_xy(spark, sf), **{"http://example.org/wkt": codecs.shape_wkt(types.point(F.col("x"), F.col("y")))})
    return _place(triples.wkt_literals("http://example.org/wkt")(t))


def _mixed_triples(spark, sf):
    """WGS84, GeoRSS and WKT triples of every third feature each, the GeoRSS ones in a graph of their own."""
    rows = _xy(spark, sf)
    wgs = _triples(rows.where("uri % 3 = 0"), **{triples.WGS84 + "lat": F.col("x"), triples.WGS84 + "long": F.col("y")})
    geo = _triples(rows.where("uri % 3 = 1"), **{codecs.GEORSS + "point": F.concat_ws(" ", "x", "y")}).withColumn("graph", F.lit("h"))
    return wgs.unionByName(geo).unionByName(_triples(rows.where("uri % 3 = 2"), **{"http://example.org/wkt": codecs.shape_wkt(types.point(F.col("x"), F.col("y")))}))


_WKT = (triples.wkt_literals("http://example.org/wkt"),)


@query(f"select cast(uri as varchar) as uri, minx as x, miny as y, case when uri % 3 = 1 then 'h' else 'g' end as source from {_B}")
def all_candidates(spark, sf):
    return _place(triples.candidates(_mixed_triples(spark, sf), _WKT), "source")


@query(f"select 'h' as graph, cast(uri as varchar) as uri, minx as x from {_B} where uri % 3 = 1 and uri % 2 = 1")
def shapes_of_graph(spark, sf):
    index = _xy(spark, sf).where("uri % 2 = 0").select(F.col("uri").cast("string").alias("uri"), types.point(F.col("maxx"), F.col("maxy")).alias("shape"))
    rows = triples.shapes_of_graph(index, triples.candidates(_mixed_triples(spark, sf), _WKT), "h")
    return rows.select("graph", "uri", F.col("shape")["rings"][0][0]["x"].alias("x"))


@query(f"select cast(uri as varchar) as uri, t_begin, t_begin as t_end from {_T}")
def uri_time_points(spark, sf):
    rows, stamp = v.intervals(spark, sf), timeops.format_timestamp(F.col("t_begin"))
    t = _triples(rows.where("uri % 2 = 0"), **{triples.SEM + "hasTimeStamp": stamp}).unionByName(_triples(rows.where("uri % 2 = 1"), **{triples.OWL_TIME + "inXSDDateTime": stamp}))
    return triples.uri_time(t).select("uri", "t_begin", "t_end")


def _placed_in_time(spark, sf):
    rows = v.lasting_features(spark, sf).select("uri", F.floor("t_begin").cast("double").alias("b"), F.col("minx").alias("x"), F.col("miny").alias("y"))
    return _triples(rows, **{triples.SEM + "hasTimeStamp": timeops.format_timestamp(F.col("b")), triples.WGS84 + "lat": F.col("x"), triples.WGS84 + "long": F.col("y")})


@query(f"select cast(uri as varchar) as uri, floor(t_begin) as t_begin, floor(t_begin) as t_end, round(x, 6) as x from {_S}")
def spacetime_candidates(spark, sf):
    return triples.spacetime_candidates(_placed_in_time(spark, sf)).select("uri", "t_begin", "t_end", F.round(F.col("shape")["rings"][0][0]["x"], 6).alias("x"))


@query(f"select cast(uri as varchar) as uri, floor(floor(t_begin)/86400)*{_d(86400.0)} as bucket from {_S}")
def spacetime_index_all(spark, sf):
    return spacetime.index_all(_placed_in_time(spark, sf)).select("uri", "bucket")


# Loading, crawling and the index as a whole


def _linked(spark, sf):
    """A graph a nation with its customers' points; the graph of nation n links to those of 2n + 1 and 2n + 2."""
    rows = _xy(spark, sf)
    graph = F.concat(F.lit("http://example.org/g"), (F.col("uri") % 25).cast("string"))
    own = _triples(rows, **{triples.WGS84 + "lat": F.col("x"), triples.WGS84 + "long": F.col("y")}).drop("graph").withColumn("graph", F.concat(F.lit("http://example.org/g"), (F.col("s").cast("long") % 25).cast("string")))
    n = spark.range(25)
    link = n.select(F.concat(F.lit("n"), "id").alias("s"), F.lit(triples.LINKS[0]).alias("p"), F.explode(F.array(*[F.concat(F.lit("http://example.org/g"), (2 * F.col("id") + i).cast("string")) for i in (1, 2)])).alias("o"))
    link = link.select("s", "p", "o", F.lit(None).cast("string").alias("o_type"), F.lit(None).cast("string").alias("o_lang"), F.concat(F.lit("http://example.org/g"), F.substring("s", 2, 9)).alias("graph"))
    return own.unionByName(link)


def _start(spark, n: int):
    return spark.range(1).select(F.lit(f"http://example.org/g{n}").alias("node"))


# From 2 the links lead to 5, 6, 11 to 14 and 23, 24 (and to numbers without a graph).
_FROM_2 = "(2, 5, 6, 11, 12, 13, 14, 23, 24)"


@query(f"select cast(uri as varchar) as uri, minx as x from {_B} where uri % 25 = 4")
def load_source(spark, sf):
    return mutations.indexed(written(closure.load(_linked(spark, sf), "http://example.org/g4", 1), "log")).select("uri", F.col("shape")["rings"][0][0]["x"].alias("x"))


@query(f"select cast(uri as varchar) as uri from {_B} where uri % 25 in {_FROM_2}")
def crawl_source(spark, sf):
    return mutations.indexed(written(closure.crawl(_linked(spark, sf), _start(spark, 2), 1), "log")).select("uri")


@query(f"select cast(uri as varchar) as uri from {_B} where uri % 25 not in {_FROM_2} and uri % 25 <> 4")
def uncrawl_source(spark, sf):
    t = written(_linked(spark, sf), "triples")
    log = mutations.index_all(t, 1).unionByName(closure.uncrawl(t, _start(spark, 2), 2)).unionByName(closure.unload(t, "http://example.org/g4", 3))
    return mutations.indexed(written(log, "log")).select("uri")


@query(f"select cast(uri as varchar) as uri, minx as x from {_B} where uri = 8")
def index_uri_shape(spark, sf):
    return mutations.uri_shapes(written(mutations.index_all(_mixed_triples(spark, sf), 1, more=_WKT), "log"), "8").select("uri", F.col("shape")["rings"][0][0]["x"].alias("x"))


# KML files and other texts


@query(f"select 'a' || uri as uri, minx as x, 'n&' || uri as name from {_B} union all select 'b' || uri as uri, maxx as x, 'n&' || uri as name from {_B}")
def kml_file_shapes(spark, sf):
    geometry = lambda p, x, y: F.format_string(f'<Point id="{p}%s"><coordinates>%s,%s</coordinates></Point>', F.col("uri").cast("string"), F.col(y).cast("string"), F.col(x).cast("string"))
    mark = F.concat(F.lit("<Placemark><name>n&amp;"), F.col("uri").cast("string"), F.lit("</name><MultiGeometry>"), geometry("a", "x", "y"), geometry("b", "maxx", "maxy"), F.lit("</MultiGeometry></Placemark>"))
    path = new_path(spark, "kml")
    _xy(spark, sf).select(mark.alias("value")).write.text(path)
    return kml_files.read_kml(spark, path).select("uri", F.col("shape")["rings"][0][0]["x"].alias("x"), "name")


@query(f"select uri, 'k' || uri as id, 'relative' as mode from {_B}")
def kml_uri(spark, sf):
    text = F.format_string('<Placemark id="no"><Point id="k%s" altitudeMode="relative"><coordinates>%s,%s</coordinates></Point></Placemark>', F.col("uri").cast("string"), F.col("y").cast("string"), F.col("x").cast("string"))
    return _xy(spark, sf).select("uri", codecs.kml_uri(text).alias("id"), F.get(codecs.kml_geometries(text), F.lit(0))["attributes"]["altitudeMode"].alias("mode"))


@query(f"select cast(uri as varchar) as uri, minx as x, 'linestring' as kind from {_B}")
def kml_save(spark, sf):
    path = new_path(spark, "kml")
    rows = _xy(spark, sf).select(F.col("uri").cast("string").alias("uri"), types.linestring([(F.col("x"), F.col("y")), (F.col("maxx"), F.col("maxy"))]).alias("shape"))
    kml_files.write_kml(rows, path, "<all>")
    return kml_files.read_kml(spark, path).select("uri", F.col("shape")["rings"][0][0]["x"].alias("x"), F.col("shape")["kind"].alias("kind"))


def _labelled(spark, sf):
    rows = _xy(spark, sf)
    geo = _triples(rows, **{codecs.GEORSS + "point": F.concat_ws(" ", "x", "y")}).withColumn("graph", F.when(F.col("s").cast("long") % 2 == 0, "g").otherwise("h"))
    label = lambda g: _triples(rows, **{kml_files.KML_NAME: F.concat(F.lit(g), F.col("uri").cast("string"))}).withColumn("graph", F.lit(g))
    return geo.unionByName(label("g")).unionByName(label("h"))


@query(f"select cast(uri as varchar) as uri, 'g' || uri as name from {_B} where uri % 2 = 0")
def georss_to_kml_of_graph(spark, sf):
    path = new_path(spark, "kml")
    kml_files.georss_to_kml(_labelled(spark, sf), path, "g")
    return kml_files.read_kml(spark, path).select("uri", "name")


@query(
    f"select 'u' || uri as s, 'http://www.georss.org/georss/point' as p, {_text('minx')} || ' ' || {_text('miny')} as o from {_B} "
    f"union all select 'u' || uri as s, 'http://www.opengis.net/kml/2.2#name' as p, 'name ' || uri as o from {_B}"
)
def kml_to_georss(spark, sf):
    path = new_path(spark, "kml")
    rows = _xy(spark, sf).select(F.concat(F.lit("u"), F.col("uri").cast("string")).alias("uri"), types.point(F.col("x"), F.col("y")).alias("shape"), F.concat(F.lit("name "), F.col("uri").cast("string")).alias("name"))
    kml_files.write_kml(rows, path)
    return kml_files.kml_to_georss(spark, path)


@query(f"select uri, 'MULTIPOINT((' || {_text('minx')} || ' ' || {_text('miny')} || '),(' || {_text('maxx')} || ' ' || {_text('maxy')} || '))' as wkt, 'GEOMETRYCOLLECTION(POINT(' || {_text('minx')} || ' ' || {_text('miny')} || '),LINESTRING(0 0,1 1))' as both, 'GEOMETRYCOLLECTION EMPTY' as none from {_B}")
def wkt_format_many(spark, sf):
    a, b = types.point(F.col("x"), F.col("y")), types.point(F.col("maxx"), F.col("maxy"))
    line = types.linestring([(0, 0), (1, 1)])
    return _xy(spark, sf).select("uri", codecs.shapes_wkt(F.array(a, b)).alias("wkt"), codecs.shapes_wkt(F.array(a, line)).alias("both"), codecs.shapes_wkt(F.slice(F.array(a), 1, 0)).alias("none"))


@query(f"select uri, {_text('minx')} || ' ' || {_text('miny')} as first, cast(5 as integer) as points from {_B}")
def gml_polygon_round_trip(spark, sf):
    back = codecs.gml_shape(codecs.shape_gml(F.col("shape")))
    ring = F.col("back")["rings"][0]
    return v.polygon_features(spark, sf).select("uri", back.alias("back")).select("uri", F.concat_ws(" ", codecs.number_text(ring[0]["x"]), codecs.number_text(ring[0]["y"])).alias("first"), F.size(ring).alias("points"))
