"""Predicates, codecs, indices and sources on small inputs worked out by hand."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from geochron import types as t
from geochron.functions import codecs, kernel, measures, timeops
from geochron.operators import closure, mutations, spacetime, spatial_join, timeindex
from geochron.operators import query as q
from geochron.options import Options
from geochron.sources import kml_files, triples

SQUARE = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
HOLE = [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# Four test shapes of a shipping chart and three points near them.
MAAS_4 = [(52.083246342296, 3.75388786172814), (52.3710752345553, 3.01216768774432), (52.417759041374, 3.05833759278454), (52.4389087756074, 3.07117653902477), (52.0969134612883, 3.85006149283663), (52.083246342296, 3.75388786172814)]
DEEP = [(52.4610938001105, 3.72421958400519), (52.4682606911878, 3.8105592296185), (52.4502600143591, 3.81455950235611), (52.4425931074853, 3.72988663041965), (52.4610938001105, 3.72421958400519)]
ANCHORAGE = [(52.1507488159673, 3.82856003700519), (52.1455819253443, 3.8692296307081), (52.0969134612883, 3.85006149283663), (52.0904132463942, 3.80455819320114), (52.1507488159673, 3.82856003700519)]
POINTS = {"P1": (52.4389, 3.07118), "P2": (52.3983, 3.13086), "P3": (52.3254, 3.06849)}


def test_chart_contains_and_order(spark):
    rows = spark.createDataFrame([(k, *v) for k, v in POINTS.items()], "uri string, x double, y double")
    features = rows.select("uri", t.point(F.col("x"), F.col("y")).alias("shape"))
    inside = q.contains(features, q.Query.polygon(MAAS_4))
    assert {r["uri"] for r in inside.collect()} == {"P1", "P2"}
    near = q.nearest_bounded(features, q.Query.polygon(DEEP)).collect()
    assert [(r["uri"], round(r["distance_km"], 3)) for r in near] == [("P2", 66.347), ("P1", 72.657), ("P3", 74.459)]
    assert q.nearest_bounded(features, q.Query.polygon(DEEP), 73.0).count() == 2
    # One vertex in common is enough.
    assert value(spark, kernel.intersects(t.polygon(MAAS_4), t.polygon(ANCHORAGE)))


PAIRS = [
    (("polygon", SQUARE), ("point", (2, 2)), True, True, False),
    (("polygon", SQUARE), ("point", (0, 2)), True, False, True),
    (("polygon", SQUARE, HOLE), ("point", (2, 2)), False, False, False),
    (("polygon", SQUARE, HOLE), ("point", (1, 2)), True, False, True),
    (("polygon", SQUARE), ("polygon", SQUARE), True, True, False),
    (("polygon", SQUARE), ("polygon", HOLE), True, True, False),
    (("polygon", SQUARE, HOLE), ("polygon", [(1.5, 1.5), (1.5, 2), (2, 2), (1.5, 1.5)]), False, False, False),
    (("polygon", SQUARE), ("polygon", [(4, 0), (4, 4), (6, 4), (6, 0), (4, 0)]), True, False, True),
    (("polygon", SQUARE), ("linestring", [(0, 0), (0, 4)]), True, False, True),
    (("polygon", SQUARE), ("linestring", [(0, 0), (4, 4)]), True, True, False),
    (("polygon", SQUARE), ("linestring", [(2, 2), (6, 2)]), True, False, False),
    (("linestring", [(0, 0), (4, 4)]), ("point", (2, 2)), True, True, False),
    (("linestring", [(0, 0), (4, 4)]), ("point", (4, 4)), True, False, True),
    (("point", (1, 1)), ("point", (1, 1)), True, True, False),
    (("polygon", SQUARE, HOLE), ("polygon", HOLE), True, False, True),
    (("polygon", SQUARE, HOLE), ("polygon", SQUARE, HOLE), True, True, False),
    (("polygon", SQUARE, [(1, 2), (2, 3), (3, 2), (2, 1), (1, 2)]), ("polygon", HOLE), True, False, False),
    (("polygon", SQUARE, HOLE), ("polygon", [(0, 0), (0, 1), (4, 1), (4, 0), (0, 0)]), True, True, False),
    (("polygon", SQUARE), ("linestring", [(0, 0), (0, 0), (4, 4)]), True, True, False),
    (("linestring", [(0, 0), (2, 2), (4, 4)]), ("linestring", [(0, 4), (2, 2), (4, 0)]), True, False, False),
    (("linestring", [(0, 0), (2, 2)]), ("linestring", [(2, 2), (4, 0)]), True, False, True),
    (("linestring", [(0, 0), (4, 0)]), ("linestring", [(1, 0), (9, 0)]), True, False, False),
    (("polygon", SQUARE), ("circle", (2, 2), 2), True, True, False),
    (("polygon", SQUARE), ("circle", (2, 2), 3), True, False, False),
    (("box", SQUARE), ("polygon", HOLE), True, True, False),
    (("circle", (0, 0), 2), ("point", (0, 2)), True, True, False),
    (("circle", (0, 0), 1), ("point", (0, 2)), False, False, False),
]


def test_predicates(spark):
    """Of each pair: do they intersect, does the first contain the second, do they touch (None: not defined for circles)."""

    def row(s):
        kind, *args = s
        rings = [[args[0]]] if kind in ("point", "circle") else args
        return (kind, 2, [[(float(x), float(y), None) for x, y in r] for r in rings], float(args[1]) if kind == "circle" else None)

    df = spark.createDataFrame([(i, row(a), row(b)) for i, (a, b, *_) in enumerate(PAIRS)], f"i int, a {t.SHAPE_T}, b {t.SHAPE_T}").repartition(2).cache()
    a, b = F.col("a"), F.col("b")
    got = df.select("i", kernel.intersects(a, b).alias("ab"), kernel.intersects(b, a).alias("ba"), kernel.contains(a, b).alias("hold"), kernel.touches(a, b).alias("touch"), kernel.distance(a, b).alias("d")).collect()
    assert len(got) == len(PAIRS)
    for r in got:
        x, y, meet, hold, touch = PAIRS[r["i"]]
        assert (r["ab"], r["ba"], r["hold"], r["d"] == 0) == (meet, meet, hold, meet), (x, y)
        if x[0] != "circle":
            assert r["touch"] is touch, (x, y)


def test_measures(spark):
    a, b = (52.3325, 4.8673), (52.2761, 4.97904)
    km = value(spark, measures.shape_greatcircle(t.point(*a), t.point(*b), "km"))
    nm = value(spark, measures.shape_greatcircle(t.point(*a), t.point(*b)))
    assert round(km, 6) == 9.851467 and round(nm, 6) == 5.319359
    assert round(value(spark, measures.shape_bearing(t.point(*a), t.point(*b))), 6) == 129.494151
    assert value(spark, measures.shape_pythagorean(t.point(*a), t.polygon(SQUARE))) is None
    with pytest.raises(ValueError):
        measures.greatcircle(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), "miles")


def test_shapes(spark):
    assert value(spark, t.is_shape(t.polygon(SQUARE))) and not value(spark, t.is_shape(t.polygon(SQUARE[:-1])))
    assert value(spark, t.dimensionality(t.point(1, 2, 3))) == 3
    assert value(spark, t.dimensionality(t.point(1, F.lit(None).cast("double")))) is None


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("POINT(1 2)", ["point"]),
        ("POINT Z (1 2 3)", ["point"]),
        ("LINESTRING(1 2,3 4)", ["linestring"]),
        ("POLYGON((0 0,0 4,4 4,0 0),(1 1,1 2,2 2,1 1))", ["polygon"]),
        ("MULTIPOINT((1 2),(3 4))", ["point", "point"]),
        ("MULTILINESTRING((1 2,3 4),(5 6,7 8))", ["linestring", "linestring"]),
        ("MULTIPOLYGON(((0 0,0 4,4 4,0 0)),((9 9,9 8,8 8,9 9)))", ["polygon", "polygon"]),
        ("GEOMETRYCOLLECTION(POINT(1 2),POLYGON((0 0,0 4,4 4,0 0)))", ["point", "polygon"]),
        ("POINT EMPTY", []),
        ("GEOMETRYCOLLECTION EMPTY", []),
        ("POINT(a 2)", None),
        ("LINESTRING(1 2,3", None),
        ("BOX(1 2,3 4)", None),
    ],
)
def test_wkt(spark, text, kinds):
    got = value(spark, codecs.wkt_shapes(F.lit(text)))
    assert (None if got is None else [s["kind"] for s in got]) == kinds
    if kinds and len(kinds) == 1:
        assert value(spark, codecs.shape_wkt(codecs.wkt_shape(F.lit(text)))) == text


def test_gml_kml_georss(spark):
    p = t.point(52.3325, 4.8673)
    assert value(spark, codecs.shape_gml(p)) == "<gml:Point><gml:pos>52.3325 4.8673</gml:pos></gml:Point>"
    assert value(spark, codecs.shape_kml(p)) == "<Point><coordinates>4.8673,52.3325</coordinates></Point>"
    for shape in (t.polygon(SQUARE, HOLE), t.linestring([(1, 2), (3, 4)]), t.point(1, 2)):
        rings = value(spark, shape["rings"])
        for there, back in ((codecs.shape_gml, codecs.gml_shape), (codecs.shape_kml, codecs.kml_shape)):
            assert value(spark, back(there(shape)))["rings"] == rings
    low = value(spark, codecs.gml_shape(F.lit("<gml:Envelope><gml:lowerCorner>1 2</gml:lowerCorner><gml:upperCorner>3 4</gml:upperCorner></gml:Envelope>")))
    assert {(r["x"], r["y"]) for r in low["rings"][0]} == {(1, 2), (1, 4), (3, 4), (3, 2)}
    geo = lambda name, text: value(spark, codecs.georss_shape(F.lit(codecs.GEORSS + name), F.lit(text)))
    assert geo("circle", "1 2 3")["radius"] == 3 and geo("box", " 1 2\t3 4 \n")["kind"] == "box"
    assert geo("point", "1 2 3") is None and geo("polygon", "0 0 0 1 1")  is None
    assert value(spark, codecs.kml_shapes(F.lit("<MultiGeometry><Point><coordinates>1,2,0</coordinates></Point><LinearRing><coordinates>0,0 0,1 1,1 0,0</coordinates></LinearRing></MultiGeometry>")))[0]["rings"][0][0]["x"] == 2


def test_times(spark):
    parse = lambda s: value(spark, timeops.parse_timestamp(F.lit(s)))
    assert parse("1970-01-02") == parse("86400") == parse('<TIMEX2 VAL="1970-01-02T00:00:00Z">x</TIMEX2>') == 86400
    assert parse("no time") is None
    assert value(spark, timeops.format_timestamp(F.lit(86400.5))) == "1970-01-02T00:00:00Z"
    d = timeops.parse_duration(F.lit("P1Y2M3DT4H5M6S"))
    assert value(spark, timeops.format_duration(d)) == "P1Y2M3DT4H5M6S"
    i = timeops.Interval.of
    for f, a, b, want in (
        (timeops.during, (0, 9), (2, 3), True), (timeops.during, (2, 3), (0, 9), False), (timeops.allen_during, (2, 3), (0, 9), True),
        (timeops.meets, (0, 2), (2, 3), True), (timeops.meets_inverse, (2, 3), (0, 2), True), (timeops.overlaps, (0, 2), (2, 3), True),
        (timeops.before, (0, 1), (2, 3), True), (timeops.after, (0, 1), (2, 3), False), (timeops.starts, (0, 1), (0, 3), True), (timeops.finishes, (1, 3), (0, 3), True),
    ):
        assert value(spark, f(i(*a), i(*b))) is want


def test_time_index(spark):
    rows = spark.createDataFrame([(1, 0.0, 10.0), (2, 4.0, 5.0), (3, 20.0, 30.0)], "uri long, t_begin double, t_end double")
    ids = lambda df: [r["uri"] for r in df.collect()]
    assert sorted(ids(timeindex.time_intersects(rows, 6, 7))) == [] and sorted(ids(timeindex.time_intersects(rows, 6, 7, "full"))) == [1]
    assert ids(timeindex.time_contains(rows, None, 15)) == [1, 2] and ids(timeindex.time_contains(rows, 3, None)) == [2, 3]


def test_mutations(spark):
    log = spark.createDataFrame(
        [(1, "i", "assert", "a", 1), (2, "i", "assert", "a", 1), (3, "i", "assert", "b", 2), (4, "i", "retract", "a", 1), (5, "i", "assert", "q", 7), (6, "i", "bulkload", "c", 3), (7, "j", "assert", "a", 1), (8, "j", "clear", None, None), (9, "i", "assert", "c", 3)],
        "seq long, index string, op string, uri string, shape int",
    )
    got = {(r["index"], r["uri"]) for r in mutations.fold(log).collect()}
    # b went into the index when a was taken back, and the load replaced it; q still waited.
    assert got == {("i", "q"), ("i", "c")}
    assert mutations.indexed(log, "nobody").count() == 0
    flushed = log.unionByName(mutations.mark("flush", 5, log, "i").withColumn("seq", F.lit(5).cast("long")))
    late = flushed.where("op <> 'assert' or seq <> 9").withColumn("seq", F.when((F.col("op") == "flush") | (F.col("op") == "bulkload"), F.col("seq") + 10).otherwise(F.col("seq")))
    assert {(r["index"], r["uri"]) for r in mutations.fold(late).collect()} == {("i", "c")}
    plain = spark.createDataFrame([(1, "assert", "a", 1), (2, "retract", "a", 1), (3, "assert", "b", 1)], "seq long, op string, uri string, shape int")
    assert [tuple(r) for r in mutations.fold(plain).collect()] == [("b", 1)]


def test_bucket_size_is_the_index_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0, 2_000_000.0, 1.0, 1.0), (2, 900_000.0, 900_000.0, 1.0, 1.0), (3, None, 5.0, 1.0, 1.0)], "uri long, t_begin double, t_end double, x double, y double")
    features = rows.select("uri", "t_begin", "t_end", t.point(F.col("x"), F.col("y")).alias("shape"))
    box = q.Query.box(0, 0, 2, 2)
    for size in (864_000.0, 86_400.0, 1000.0):
        spacetime.store(features, str(tmp_path / f"s{size}"), size)
        index = spark.read.parquet(str(tmp_path / f"s{size}"))
        got = spacetime.spacetime_intersects(index, box, 890_000.0, 910_000.0)
        assert sorted(r["uri"] for r in got.collect()) == [1, 2]
        assert "PartitionFilters: [isnotnull(bucket" in got._jdf.queryExecution().executedPlan().toString()
    spacetime.clear(spark, str(tmp_path / "s1000.0"))
    assert not (tmp_path / "s1000.0").exists()


def test_joins_of_boxes_of_all_sizes(spark):
    import random

    draw = random.Random(5)
    boxes = []
    for i in range(150):
        side = draw.choice([0.0, 0.01, 0.3, 5.0, 80.0])
        x, y = draw.uniform(-50, 50), draw.uniform(-50, 50)
        boxes.append((i, x, y, x + side * draw.random(), y + side))
    boxes += [(900, 0.0, 0.0, 0.0, 0.0), (901, 0.0, 0.0, 0.0, 0.0), (902, None, 0.0, None, 0.0)]
    df = spark.createDataFrame(boxes, "uri long, minx double, miny double, maxx double, maxy double")
    real = boxes[:-1]
    want = sorted((a[0], b[0]) for a in real for b in real if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2])
    assert sorted((r["l_uri"], r["r_uri"]) for r in spatial_join.box_join(df, df).collect()) == want
    near = sorted((a[0], b[0]) for a in real for b in real if a[1] - 1 <= b[3] and a[3] + 1 >= b[1] and a[2] - 1 <= b[4] and a[4] + 1 >= b[2])
    assert sorted((r["l_uri"], r["r_uri"]) for r in spatial_join.box_join(df, df, margin=1.0).collect()) == near
    apart = {a for a, b in want if a != b}
    other = lambda: F.col("l_uri") != F.col("r_uri")
    assert {r["uri"] for r in spatial_join.neighbours(df, df, other).collect()} == apart
    assert {r["uri"] for r in spatial_join.neighbours(df, df, other, anti=True).collect()} == {b[0] for b in boxes} - apart


def test_far_query_and_open_intervals(spark):
    points = spark.createDataFrame([(f"p{i}", float(i), 0.0) for i in range(20)], "uri string, x double, y double")
    asks = spark.createDataFrame([("near", 3.0, 0.0), ("far", 1e6, 0.0), ("none", None, 0.0)], "uri string, x double, y double")
    got = spatial_join.knn_join(asks, points, 2, 0.5).collect()
    assert sorted((r["q_uri"], r["rank"], r["p_uri"]) for r in got) == [("far", 1, "p19"), ("far", 2, "p18"), ("near", 1, "p3"), ("near", 2, "p2")]
    assert spatial_join.knn_join(asks, points.limit(0), 2).count() == 0 and spatial_join.knn_join(asks, points, 50).count() == 40
    times = spark.createDataFrame([("a", 0.0, 10.0), ("b", None, 3.0), ("c", 8.0, None), ("d", 1e6, 1e6)], "uri string, t_begin double, t_end double")
    pairs = {(r["l_uri"], r["r_uri"]) for r in spatial_join.interval_join(times, times).collect()}
    assert {p for p in pairs if p[0] < p[1]} == {("a", "b"), ("a", "c"), ("c", "d")}


def test_features_by_their_identifiers(spark):
    """45 features: squares in a row, each of which meets the next; and what is asked of one by its identifier."""
    rows = spark.range(45).select(F.concat(F.lit("f"), "id").alias("uri"), F.col("id").cast("double").alias("x"))
    ring = F.array(*[t.xyz(F.col("x") + a, F.lit(float(b))) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))])
    features = rows.select("uri", t.make("polygon", F.array(ring)).alias("shape"))
    ids = lambda df: [r["uri"] for r in df.collect()]
    assert sorted(ids(q.intersects(features, "f7"))) == ["f6", "f7", "f8"] and ids(q.contains(features, "f7")) == ["f7"]
    assert ids(q.nearest(features, "f0", 4)) == ["f0", "f1", "f2", "f3"] and ids(q.intersects(features, "nobody")) == []
    assert q.distance_km(features, "f0", "f3").first()[0] == pytest.approx(2 * measures.KM_PER_DEGREE)
    assert q.distance_km(features, q.Query.point(0.5, 0.5), "f1").first()[0] == pytest.approx(0.5 * measures.KM_PER_DEGREE)
    assert ids(q.nearest_bounded(features, "f0", 1.5 * measures.KM_PER_DEGREE)) == ["f0", "f1", "f2"]
    own, q.LITERAL_POINTS = q.LITERAL_POINTS, 0
    try:
        assert sorted(ids(q.intersects(features, "f7"))) == ["f6", "f7", "f8"]
    finally:
        q.LITERAL_POINTS = own


def test_sources(spark):
    schema = "s string, p string, o string, o_type string, o_lang string, graph string"
    W = triples.WGS84
    data = [
        ("a", W + "lat", "1.5", None, None, "g"), ("a", W + "long", "2.5", None, None, "g"),
        ("b", W + "lat", "1", None, None, "g"), ("b", W + "long", "2", None, None, "g"), ("b", W + "alt", "3", None, None, "g"),
        ("n", triples.DBPEDIA + "coordinateProperty", "52_30_0_Z_4_15_0_O_type:city", None, "nl", "g"),
        ("w", "http://x/wkt", "POINT(3.06849 52.3254)", None, None, "g"),
        ("e", triples.SEM + "hasBeginTimeStamp", "1970-01-01", None, None, "g"), ("e", triples.SEM + "hasEndTimeStamp", "1970-01-02", None, None, "g"),
        ("h", triples.SEM + "hasBeginTimeStamp", "1970-01-01", None, None, "g"),
        ("u", triples.LINKS[0], "g2", None, None, "g"), ("v", triples.LINKS[1], "g3", None, None, "g2"),
    ]
    df = spark.createDataFrame(data, schema)
    found = {r["uri"]: r["shape"] for r in triples.candidates(df, (triples.wkt_literals("http://x/wkt"),)).collect()}
    assert found["a"]["dim"] == 2 and found["b"]["dim"] == 3 and found["b"]["rings"][0][0]["z"] == 3
    assert (found["n"]["rings"][0][0]["x"], found["n"]["rings"][0][0]["y"]) == (-52.5, 4.25)
    assert found["w"]["rings"][0][0]["x"] == 3.06849
    times = triples.uri_time(df).collect()
    assert [(r["uri"], r["t_begin"], r["t_end"]) for r in times] == [("e", 0.0, 86400.0)]
    assert {r["graph"] for r in closure.crawled(df, spark.createDataFrame([("g",)], "node string")).select("graph").distinct().collect()} == {"g", "g2"}


def test_kml_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("http://x/a", 1.0, 2.0)], "uri string, x double, y double").select("uri", t.point(F.col("x"), F.col("y")).alias("shape"))
    kml_files.write_kml(rows, str(tmp_path / "k"), "name")
    back = kml_files.read_kml(spark, str(tmp_path / "k")).collect()
    assert [(r["uri"], r["shape"]["rings"][0][0]["x"]) for r in back] == [("http://x/a", 1.0)]


def test_joins_plan_without_nested_loops(spark):
    a = spark.range(50).selectExpr("id as uri", "cast(id as double) as x", "cast(id * 7 % 11 as double) as y")
    near = spatial_join.knn_join(a, a, 3, 0.5).collect()
    import math

    pts = [(r["uri"], r["x"], r["y"]) for r in a.collect()]
    for u, x, y in pts:
        want = sorted((round(math.hypot(x - c, y - d), 9), v) for v, c, d in pts)[:3]
        assert sorted((round(r["distance"], 9), r["p_uri"]) for r in near if r["q_uri"] == u) == want
    b = a.selectExpr("uri", "x as minx", "y as miny", "x + 1 as maxx", "y + 1 as maxy")
    plan = spatial_join.box_join(b, b, cell=1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stored_index_prunes(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id as uri", "cast(id as double) as x").select("uri", t.point(F.col("x"), F.col("x")).alias("shape"))
    q.store(rows, str(tmp_path / "f"), 100.0)
    df = q.intersects(spark.read.parquet(str(tmp_path / "f")), q.Query.box(10, 10, 12, 12))
    assert sorted(r["uri"] for r in df.collect()) == [10, 11, 12]
    assert "PushedFilters: [IsNotNull(" in df._jdf.queryExecution().executedPlan().toString()


def test_options():
    assert Options().set(cell_size=2.0).cell_size == 2.0
    for bad in ({"x": 1}, {"distance_function": "x"}, {"bucket_size": 0}):
        with pytest.raises(ValueError):
            Options().set(**bad)


def test_stream(spark, tmp_path):
    from geochron.streaming.mutation_stream import append_to_log, read_log

    schema = "seq long, index string, op string, uri string, shape int"
    spark.createDataFrame([Row(seq=1, index="i", op="assert", uri="a", shape=1)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    append_to_log(stream, str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [r["uri"] for r in mutations.fold(log.drop("batch")).collect()] == ["a"]
