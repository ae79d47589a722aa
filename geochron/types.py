"""Shapes as columns.

A shape is STRUCT<kind, dim, rings ARRAY<ARRAY<STRUCT<x, y, z>>>, radius>: a point is one ring of one
point, a linestring one ring, a polygon its shell and then its holes, a box the ring of its corners,
a circle its centre and a radius.  x is latitude and y longitude unless data say otherwise; z is carried along and never
compared.  A multi-geometry is an array of shapes, true of whatever one of its parts is true of.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT_T = "struct<x:double,y:double,z:double>"
RING_T = f"array<{POINT_T}>"
SHAPE_T = f"struct<kind:string,dim:int,rings:array<{RING_T}>,radius:double>"

Number = float | int | Column


def col(v: Number | str) -> Column:
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.lit(float(v))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value as one node of the plan however often it is used: a plan of nested uses would else grow with their product."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def once(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """f, whose plan is put together once an application and then applied to other columns as it is: large ones take seconds to build."""
    kept: dict[str, object] = {}

    @wraps(f)
    def g(value: Column) -> Column:
        from pyspark.sql.functions.builtin import _create_lambda

        app = SparkContext.getOrCreate().applicationId
        if app not in kept:
            kept.clear()
            kept[app] = Column(_create_lambda(lambda v: f(v)))
        return F.get(F.call_function("transform", F.array(value), kept[app]), F.lit(0))

    return g


def xyz(x: Number, y: Number, z: Number | None = None) -> Column:
    z = F.lit(None) if z is None else col(z)
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"), z.cast("double").alias("z"))


def ring(points: Sequence[Sequence[Number]]) -> Column:
    return F.array(*[xyz(*p) for p in points])


def make(kind: str | Column, rings: Column, dim: int | Column = 2, radius: Number | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    dim = F.lit(dim) if isinstance(dim, int) else dim
    radius = F.lit(None) if radius is None else col(radius)
    return F.struct(kind.alias("kind"), dim.cast("int").alias("dim"), rings.cast(f"array<{RING_T}>").alias("rings"), radius.cast("double").alias("radius"))


def point(x: Number, y: Number, z: Number | None = None) -> Column:
    return make("point", F.array(F.array(xyz(x, y, z))), 2 if z is None else 3)


def linestring(points: Sequence[Sequence[Number]]) -> Column:
    return make("linestring", F.array(ring(points)), len(points[0]))


def polygon(shell: Sequence[Sequence[Number]], *holes: Sequence[Sequence[Number]]) -> Column:
    return make("polygon", F.array(*[ring(r) for r in (shell, *holes)]), len(shell[0]))


def box_ring(minx: Number, miny: Number, maxx: Number, maxy: Number) -> Column:
    """The five-point ring of a box given by two opposite corners, in any order."""
    a, b, c, d = map(col, (minx, miny, maxx, maxy))
    x1, x2, y1, y2 = F.least(a, c), F.greatest(a, c), F.least(b, d), F.greatest(b, d)
    return F.array(xyz(x1, y1), xyz(x1, y2), xyz(x2, y2), xyz(x2, y1), xyz(x1, y1))


def box(minx: Number, miny: Number, maxx: Number, maxy: Number) -> Column:
    return make("box", F.array(box_ring(minx, miny, maxx, maxy)))


def circle(x: Number, y: Number, radius: Number) -> Column:
    return make("circle", F.array(F.array(xyz(x, y))), 2, radius)


def points_of(shape: Column) -> Column:
    return F.flatten(shape["rings"])


def mbr(shape: Column) -> dict[str, Column]:
    """minx, miny, maxx, maxy; flat columns of these let Parquet skip row groups."""
    pts, r = points_of(shape), F.coalesce(shape["radius"], F.lit(0.0))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return {"minx": F.array_min(xs) - r, "miny": F.array_min(ys) - r, "maxx": F.array_max(xs) + r, "maxy": F.array_max(ys) + r}


def with_mbr(df, shape: str = "shape"):
    return df.withColumns(mbr(F.col(shape)))


def centre(shape: Column) -> Column:
    """Of the bounding box."""
    m = mbr(shape)
    return xyz((m["minx"] + m["maxx"]) / 2, (m["miny"] + m["maxy"]) / 2)


@once
def is_shape(shape: Column) -> Column:
    """Ground and well formed: a known kind, 1 to 3 dimensions, no null coordinate, rings of the length the kind needs, polygons closed."""
    n0 = F.size(shape["rings"][0])
    shell = shape["rings"][0]
    whole = ~F.exists(points_of(shape), lambda p: p["x"].isNull() | p["y"].isNull() | ((shape["dim"] > 2) & p["z"].isNull()))
    closed = F.forall(shape["rings"], lambda r: (F.size(r) >= 4) & (r[0]["x"] == F.element_at(r, -1)["x"]) & (r[0]["y"] == F.element_at(r, -1)["y"]))
    kind = shape["kind"]
    form = (
        F.when(kind == "point", n0 == 1)
        .when(kind == "linestring", n0 >= 2)
        .when(kind.isin("polygon", "box"), closed)
        .when(kind == "circle", (n0 == 1) & (shape["radius"] >= 0) & shell[0]["x"].isNotNull())
        .otherwise(False)
    )
    return F.coalesce(shape.isNotNull() & shape["dim"].between(1, 3) & whole & form, F.lit(False))


def dimensionality(shape: Column) -> Column:
    return F.when(is_shape(shape), shape["dim"])
