"""Text encodings of shapes: WKT, GML, KML and GeoRSS-Simple, all by built-in functions.

WKT, GML and GeoRSS keep the order of the axes; KML writes longitude first and is swapped here and only here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import SHAPE_T, box, circle, let, make, mbr, once, xyz

GEORSS = "http://www.georss.org/georss/"


def number_text(v: Column) -> Column:
    """Whole numbers without a fraction, others as Spark shows doubles."""
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def _numbers(text: Column, separator: str = r"\s+") -> Column:
    """The doubles of a separated list; null if any part isn't a number."""
    parts = F.filter(F.split(F.trim(text), separator, -1), lambda s: s != "")
    values = F.transform(parts, lambda s: s.try_cast("double"))
    return let(values, lambda x: F.when((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull()), x))


def _points(values: Column, dim: int | Column) -> Column:
    """Groups of dim numbers as points; null if they don't come out even."""
    dim = F.lit(dim) if isinstance(dim, int) else dim

    def grouped(x: Column) -> Column:
        n = F.size(x)
        at = F.when((n >= dim) & (n % dim == 0), F.sequence(F.lit(0), F.greatest(n - dim, F.lit(0)), dim))
        return F.transform(at, lambda i: xyz(F.get(x, i), F.get(x, i + 1), F.when(dim > 2, F.get(x, i + 2))))

    return let(values, grouped)


# WKT


def _wkt_points(text: Column) -> Column:
    """'1 2, 3 4' as points; null if one of them isn't 2 to 4 numbers."""
    rows = F.transform(F.split(text, ",", -1), lambda t: _numbers(t))
    whole = lambda x: F.forall(x, lambda r: r.isNotNull() & F.size(r).between(2, 4))
    return let(rows, lambda x: F.when(whole(x), F.transform(x, lambda r: xyz(r[0], r[1], F.get(r, F.lit(2))))))


def _all_or_none(items: Column) -> Column:
    return let(items, lambda x: F.when(F.forall(x, lambda r: r.isNotNull()), x))


def _dim(rings: Column) -> Column:
    return F.when(rings[0][0]["z"].isNotNull(), 3).otherwise(2)


def _tagged(text: Column) -> Column:
    """Shapes of one tagged text: one, or all parts of a multi-geometry; null if malformed, none if empty."""
    body = F.trim(F.regexp_replace(text, r"^\s*[A-Z]+\s*(ZM|Z|M)?", ""))
    return let(F.struct(F.regexp_extract(text, r"^\s*([A-Z]+)", 1).alias("kind"), body.alias("body")), lambda t: _parsed(t["kind"], t["body"]))


def _parsed(kind: Column, body: Column) -> Column:
    inner = lambda t: F.regexp_extract_all(t, F.lit(r"\(([^()]*)\)"), F.lit(1))
    rings_of = lambda t: _all_or_none(F.transform(inner(t), lambda r: _wkt_points(r)))
    # A polygon of several is what stands between '((' and '))'.
    areas = F.regexp_extract_all(body, F.lit(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)"), F.lit(1))
    balanced = F.length(F.regexp_replace(body, r"[^(]", "")) == F.length(F.regexp_replace(body, r"[^)]", ""))
    shape = lambda name, r: make(name, r, _dim(r)).cast(SHAPE_T)
    simple = {"POINT": "point", "LINESTRING": "linestring", "POLYGON": "polygon"}

    def flat(rings: Column) -> Column:
        one = F.size(rings) == 1
        name = F.when((kind == "POINT") & one & (F.size(rings[0]) == 1), "point").when((kind == "LINESTRING") & one, "linestring").when(kind == "POLYGON", "polygon")
        apart = F.when((kind == "MULTIPOINT") & F.forall(rings, lambda r: F.size(r) == 1), "point").when(kind == "MULTILINESTRING", "linestring")
        return F.when(name.isNotNull(), F.array(shape(name, rings))).when(apart.isNotNull(), F.transform(rings, lambda r: shape(apart, F.array(r))))

    known = kind.isin(*simple, *("MULTI" + k for k in simple))
    many = F.transform(_all_or_none(F.transform(areas, lambda p: rings_of(p))), lambda p: shape("polygon", p))
    found = F.when(kind == "MULTIPOLYGON", many).otherwise(let(rings_of(body), flat))
    return F.when(known & (body == "EMPTY"), F.array().cast(f"array<{SHAPE_T}>")).when(known & balanced & body.contains("("), found)


@once
def wkt_shapes(text: Column) -> Column:
    """The shapes of a WKT text: one, the parts of a multi-geometry or collection (none if EMPTY), or null if it isn't WKT."""
    body = F.regexp_extract(text, r"^\s*GEOMETRYCOLLECTION\s*\((.*)\)\s*$", 1)
    parts = F.regexp_extract_all(body, F.lit(r"[A-Z]{5,}(?:\s*(?:ZM|Z|M)\b)?(?:[^A-DF-Z]|E(?=[0-9+-])|EMPTY)*"), F.lit(0))
    shapes = F.flatten(_all_or_none(F.transform(parts, lambda p: _tagged(p))))
    empty = F.when(F.trim(text).rlike(r"^GEOMETRYCOLLECTION\s+EMPTY$"), F.array().cast(f"array<{SHAPE_T}>"))
    return F.when(text.rlike(r"^\s*GEOMETRYCOLLECTION"), F.coalesce(empty, F.when(F.size(parts) > 0, shapes))).otherwise(_tagged(text))


def wkt_shape(text: Column) -> Column:
    """The shape of a WKT point, linestring or polygon; null for anything else."""
    return F.when(text.rlike(r"^\s*(POINT|LINESTRING|POLYGON)\b"), let(_tagged(text), lambda s: F.when(F.size(s) == 1, s[0])))


def _join(points: Column, between: str, inside: str) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(inside, number_text(p["x"]), number_text(p["y"]), number_text(p["z"]))), between)


@once
def shape_wkt(shape: Column) -> Column:
    """Boxes are written as polygons; circles have no WKT and give null."""
    rings = F.array_join(F.transform(shape["rings"], lambda r: F.concat(F.lit("("), _join(r, ",", " "), F.lit(")"))), ",")
    first = _join(shape["rings"][0], ",", " ")
    return (
        F.when((shape["kind"] == "point") & (shape["dim"] > 2), F.concat(F.lit("POINT Z ("), first, F.lit(")")))
        .when(shape["kind"] == "point", F.concat(F.lit("POINT("), first, F.lit(")")))
        .when(shape["kind"] == "linestring", F.concat(F.lit("LINESTRING("), first, F.lit(")")))
        .when(shape["kind"].isin("polygon", "box"), F.concat(F.lit("POLYGON("), rings, F.lit(")")))
    )


_MULTI = {"point": "MULTIPOINT", "linestring": "MULTILINESTRING", "polygon": "MULTIPOLYGON"}


def shapes_wkt(shapes: Column) -> Column:
    """WKT of several shapes: a multi-geometry if all are of one kind, else a collection; EMPTY without any.  Of one shape too.

    Null if a shape has no WKT.  Tags of three dimensions stand on points only, as in ``shape_wkt``.
    """
    kind = lambda s: F.when(s["kind"] == "box", "polygon").otherwise(s["kind"])
    kinds = F.array_distinct(F.transform(shapes, kind))
    texts = _all_or_none(F.transform(shapes, shape_wkt))
    bodies = F.array_join(F.transform(texts, lambda t: F.regexp_replace(t, r"^[A-Z]+( Z )?", "")), ",")
    many = F.element_at(F.create_map(*[F.lit(x) for pair in _MULTI.items() for x in pair]), kinds[0])
    some = F.when(F.size(kinds) == 1, F.concat(many, F.lit("("), bodies, F.lit(")"))).otherwise(F.concat(F.lit("GEOMETRYCOLLECTION("), F.array_join(texts, ","), F.lit(")")))
    return F.when(F.size(shapes) == 0, "GEOMETRYCOLLECTION EMPTY").when(texts.isNotNull(), some)


# GML


def _xml_text(xml: Column, tag: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{tag}\b[^>]*>([^<]*)</(?:\w+:)?{tag}>", 1)), F.lit(""))


def _xml_all(xml: Column, pattern: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(pattern), F.lit(1))


@once
def gml_shape(gml: Column) -> Column:
    """Point/pos, LineString/posList, Polygon with exterior and interiors, and Envelope; any prefix; null for anything else.

    A posList is read in pairs, whatever srsDimension says: so does the data model that this follows.
    """
    has = lambda tag: gml.rlike(rf"<(?:\w+:)?{tag}\b")
    point = let(_numbers(_xml_text(gml, "pos")), lambda p: F.when(F.size(p).between(2, 4), make("point", F.array(F.array(xyz(p[0], p[1], F.get(p, F.lit(2))))), F.when(F.size(p) > 2, 3).otherwise(2)).cast(SHAPE_T)))
    line = let(_points(_numbers(_xml_text(gml, "posList")), 2), lambda p: F.when(p.isNotNull(), make("linestring", F.array(p)).cast(SHAPE_T)))
    ring = lambda side: _xml_all(gml, rf"(?s)<(?:\w+:)?{side}>\s*<(?:\w+:)?LinearRing[^>]*>\s*<(?:\w+:)?posList[^>]*>([^<]*)<")
    area = let(_all_or_none(F.transform(F.concat(ring("exterior"), ring("interior")), lambda t: _points(_numbers(t), 2))), lambda r: F.when(r.isNotNull(), make("polygon", r).cast(SHAPE_T)))
    ends = F.struct(_numbers(_xml_text(gml, "lowerCorner")).alias("a"), _numbers(_xml_text(gml, "upperCorner")).alias("b"))
    corners = let(ends, lambda c: F.when((F.size(c["a"]) >= 2) & (F.size(c["b"]) >= 2), box(c["a"][0], c["a"][1], c["b"][0], c["b"][1]).cast(SHAPE_T)))
    return (
        F.when(has("Polygon"), F.when(F.size(ring("exterior")) == 1, area))
        .when(has("LineString"), line)
        .when(has("Envelope"), corners)
        .when(has("Point"), point)
    )


@once
def shape_gml(shape: Column) -> Column:
    flat = lambda r: _join(r, " ", " ")
    ring = lambda r, side: F.concat(F.lit(f"<gml:{side}><gml:LinearRing><gml:posList>"), flat(r), F.lit(f"</gml:posList></gml:LinearRing></gml:{side}>"))
    holes = F.slice(shape["rings"], F.lit(2), F.greatest(F.size(shape["rings"]) - 1, F.lit(0)))
    m = mbr(shape)
    corner = lambda a, b, tag: F.concat(F.lit(f"<gml:{tag}>"), number_text(m[a]), F.lit(" "), number_text(m[b]), F.lit(f"</gml:{tag}>"))
    first = shape["rings"][0]
    return (
        F.when(shape["kind"] == "point", F.concat(F.lit("<gml:Point><gml:pos>"), flat(first), F.lit("</gml:pos></gml:Point>")))
        .when(shape["kind"] == "linestring", F.concat(F.lit("<gml:LineString><gml:posList>"), flat(first), F.lit("</gml:posList></gml:LineString>")))
        .when(shape["kind"] == "box", F.concat(F.lit("<gml:Envelope>"), corner("minx", "miny", "lowerCorner"), corner("maxx", "maxy", "upperCorner"), F.lit("</gml:Envelope>")))
        .when(shape["kind"] == "polygon", F.concat(F.lit("<gml:Polygon>"), ring(first, "exterior"), F.array_join(F.transform(holes, lambda r: ring(r, "interior")), ""), F.lit("</gml:Polygon>")))
    )


# KML


def _kml_points(text: Column) -> Column:
    """'long,lat[,alt] ...' as points; an altitude of 0 is none."""
    rows = F.transform(F.filter(F.split(F.trim(text), r"\s+", -1), lambda s: s != ""), lambda s: _numbers(s, ","))
    whole = lambda x: (F.size(x) > 0) & F.forall(x, lambda r: r.isNotNull() & F.size(r).between(2, 3))
    return let(rows, lambda x: F.when(whole(x), F.transform(x, lambda r: xyz(r[1], r[0], F.nullif(F.get(r, F.lit(2)), F.lit(0.0))))))


_COORDINATES = r"<(?:\w+:)?coordinates[^>]*>([^<]*)</"
_GEOMETRY = r"(?s)<(?:\w+:)?(Point|LineString|LinearRing|Polygon)\b.*?</(?:\w+:)?\1\s*>"
_TAG = r"^<(?:\w+:)?\w+([^>]*)>"
_GEOMETRY_T = f"struct<uri:string,shape:{SHAPE_T},attributes:map<string,string>,content:string>"


def without_comments(xml: Column) -> Column:
    return F.regexp_replace(xml, r"(?s)<!--.*?-->", "")


@once
def kml_geometries(kml: Column) -> Column:
    """The geometry elements anywhere in the text, in its order: uri (the element's id), shape, attributes of its tag, and content,
    the elements in it that don't belong to the shape.  Rings that stand alone are linestrings.  Null if one of them can't be read.
    """

    def one(t: Column) -> Column:
        tag = F.regexp_extract(t, _TAG, 1)
        kind = F.regexp_extract(t, r"^<(?:\w+:)?(\w+)", 1)
        pairs = F.regexp_extract_all(tag, F.lit(r"""[\w:]+\s*=\s*(?:"[^"]*"|'[^']*')"""), F.lit(0))
        attributes = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), xml_unescaped(F.regexp_extract(p, r"""=\s*["']([^"']*)""", 1)))))
        outer = F.regexp_extract_all(t, F.lit(rf"(?s)<(?:\w+:)?outerBoundaryIs>(?:(?!</(?:\w+:)?outerBoundaryIs>).)*?{_COORDINATES}"), F.lit(1))
        inner = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"(?s)<(?:\w+:)?innerBoundaryIs>(.*?)</(?:\w+:)?innerBoundaryIs>"), F.lit(1)), lambda u: F.regexp_extract_all(u, F.lit(_COORDINATES), F.lit(1))))
        texts = F.when(kind != "Polygon", F.regexp_extract_all(t, F.lit(_COORDINATES), F.lit(1))).when(F.size(outer) == 1, F.concat(outer, inner))
        rings = let(_all_or_none(F.transform(texts, _kml_points)), lambda r: F.when((F.size(r) > 0) & ((kind == "Polygon") | (F.size(r) == 1)) & ((kind != "Point") | (F.size(r[0]) == 1)), r))
        name = F.when(kind == "Polygon", "polygon").when(kind == "Point", "point").otherwise("linestring")
        body = F.regexp_replace(F.regexp_replace(t, r"^<[^>]*>|</[^>]*>$", ""), r"(?s)<(?:\w+:)?(coordinates|outerBoundaryIs|innerBoundaryIs)\b.*?</(?:\w+:)?\1\s*>", "")
        ident = F.coalesce(attributes["id"], attributes["ID"])
        return let(rings, lambda r: F.when(r.isNotNull(), F.struct(ident.alias("uri"), make(name, r, _dim(r)).cast(SHAPE_T).alias("shape"), attributes.alias("attributes"), F.nullif(F.trim(body), F.lit("")).alias("content")).cast(_GEOMETRY_T)))

    return _all_or_none(F.transform(F.regexp_extract_all(without_comments(kml), F.lit(_GEOMETRY), F.lit(0)), one))


def kml_shapes(kml: Column) -> Column:
    """Shapes of the geometry elements anywhere in the text."""
    return F.transform(kml_geometries(kml), lambda g: g["shape"])


def kml_shape(kml: Column) -> Column:
    """The first shape of the text; null if there is none."""
    return F.get(kml_geometries(kml), F.lit(0))["shape"]


def kml_uri(kml: Column) -> Column:
    """The id of the first geometry element; null without one."""
    return F.get(kml_geometries(kml), F.lit(0))["uri"]


def shape_kml(shape: Column, attributes: Column | None = None, content: Column | None = None) -> Column:
    """attributes: text put in the opening tag (id="..."); content: elements put after the coordinates.  Polygon shells are closed."""
    extra = F.lit("") if attributes is None else F.coalesce(F.concat(F.lit(" "), attributes), F.lit(""))
    more = F.lit("") if content is None else F.coalesce(content, F.lit(""))
    flat = lambda r: F.array_join(F.transform(r, lambda p: F.concat_ws(",", number_text(p["y"]), number_text(p["x"]), number_text(p["z"]))), " ")
    first, last = shape["rings"][0][0], F.element_at(shape["rings"][0], -1)
    shell = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), shape["rings"][0]).otherwise(F.concat(shape["rings"][0], F.array(first)))
    ring = lambda r: F.concat(F.lit("<LinearRing><coordinates>"), flat(r), F.lit("</coordinates></LinearRing>"))
    holes = F.slice(shape["rings"], F.lit(2), F.greatest(F.size(shape["rings"]) - 1, F.lit(0)))
    inner = F.array_join(F.transform(holes, lambda r: F.concat(F.lit("<innerBoundaryIs>"), ring(r), F.lit("</innerBoundaryIs>"))), "")
    tagged = lambda tag, body: F.concat(F.lit(f"<{tag}"), extra, F.lit(">"), body, more, F.lit(f"</{tag}>"))
    plain = F.concat(F.lit("<coordinates>"), flat(shape["rings"][0]), F.lit("</coordinates>"))
    return (
        F.when(shape["kind"] == "point", tagged("Point", plain))
        .when(shape["kind"] == "linestring", tagged("LineString", plain))
        .when(shape["kind"].isin("polygon", "box"), tagged("Polygon", F.concat(F.lit("<outerBoundaryIs>"), ring(shell), F.lit("</outerBoundaryIs>"), inner)))
    )


def placemark(shape_text: Column, name: Column | None = None, description: Column | None = None, attributes: Column | None = None) -> Column:
    part = lambda tag, v: F.lit("") if v is None else F.when(v.isNotNull(), F.concat(F.lit(f"<{tag}>"), xml_escaped(v), F.lit(f"</{tag}>"))).otherwise("")
    extra = F.lit("") if attributes is None else F.coalesce(F.concat(F.lit(" "), attributes), F.lit(""))
    return F.concat(F.lit("<Placemark"), extra, F.lit(">"), shape_text, part("name", name), part("description", description), F.lit("</Placemark>"))


def xml_escaped(v: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def xml_unescaped(v: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


# GeoRSS-Simple


def georss_shape(predicate: Column, text: Column) -> Column:
    """point, line (or linearring), polygon, box and circle literals; null for what doesn't parse, such as a point of three numbers."""
    local = F.substring_index(predicate, "/", -1)

    def read(x: Column) -> Column:
        n = F.size(x)
        at = lambda i: F.get(x, F.lit(i))
        kind = F.when((local == "point") & (n == 2), "point").when(local.isin("line", "linearring"), "linestring").when(local == "polygon", "polygon")
        flat = let(_points(x, 2), lambda p: F.when(kind.isNotNull() & p.isNotNull(), make(kind, F.array(p)).cast(SHAPE_T)))
        return (
            F.when((local == "box") & (n == 4), box(at(0), at(1), at(2), at(3)).cast(SHAPE_T))
            .when((local == "circle") & (n == 3), circle(at(0), at(1), at(2)).cast(SHAPE_T))
            .otherwise(flat)
        )

    return let(_numbers(text), read)


def georss_predicate(shape: Column) -> Column:
    names = {"point": "point", "linestring": "line", "polygon": "polygon", "box": "box", "circle": "circle"}
    found = F.lit(None)
    for kind, name in names.items():
        found = F.when(shape["kind"] == kind, GEORSS + name).otherwise(found)
    return found


def georss_literal(shape: Column) -> Column:
    """The shell of a polygon, the corners of a box, centre and radius of a circle."""
    m = mbr(shape)
    corners = F.concat_ws(" ", *[number_text(m[k]) for k in ("minx", "miny", "maxx", "maxy")])
    first = _join(shape["rings"][0], " ", " ")
    return F.when(shape["kind"] == "box", corners).when(shape["kind"] == "circle", F.concat_ws(" ", first, number_text(shape["radius"]))).otherwise(first)
