"""Containment, intersection and nearest-neighbour queries of one shape against a table of features.

features: uri, shape, and, where stored by ``store``, flat minx, miny, maxx, maxy.  Comparisons of those flat columns are separate
conjuncts that reach the Parquet scan; the exact predicate runs on what is left.  The query's kind is known when the plan is built, so
points and boxes among the features are tested by plain arithmetic on the flat columns, and only the branches for other kinds use arrays.
A table without shape but with x and y is one of points.

Wherever a Query stands, the uri of a feature can be given in its place: its shapes are looked up, and the answer is that of all of them together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernel, measures
from ..functions.measures import KM_PER_DEGREE
from ..options import Options
from ..types import SHAPE_T, point, with_mbr

#: Segments of a literal polygon up to which points are tested by unrolled arithmetic.
UNROLL = 64
#: Points of all shapes of a uri that are looked up to become literals of the plan; beyond that the shapes are joined by cells.
LITERAL_POINTS = 10_000

Points = Sequence[Sequence[float]]


@dataclass(frozen=True)
class Query:
    """A literal shape and its bounding box."""

    kind: str
    rings: tuple[tuple[tuple[float, ...], ...], ...]
    radius: float | None = None

    @staticmethod
    def _of(kind: str, *rings: Points, radius: float | None = None) -> Query:
        return Query(kind, tuple(tuple(tuple(map(float, p)) for p in r) for r in rings), radius)

    @staticmethod
    def point(x: float, y: float) -> Query:
        return Query._of("point", [(x, y)])

    @staticmethod
    def box(x1: float, y1: float, x2: float, y2: float) -> Query:
        a, b, c, d = min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)
        return Query._of("box", [(a, b), (a, d), (c, d), (c, b), (a, b)])

    @staticmethod
    def linestring(points: Points) -> Query:
        return Query._of("linestring", points)

    @staticmethod
    def polygon(shell: Points, *holes: Points) -> Query:
        return Query._of("polygon", shell, *holes)

    @staticmethod
    def circle(x: float, y: float, radius: float) -> Query:
        return Query._of("circle", [(x, y)], radius=float(radius))

    @staticmethod
    def from_row(row) -> Query:
        return Query._of(row["kind"], *[[(p["x"], p["y"]) for p in r] for r in row["rings"]], radius=row["radius"])

    def _bound(self, i: int, pick) -> float:
        sign = self.radius or 0.0
        return pick(p[i] for r in self.rings for p in r) + (-sign if pick is min else sign)

    minx = property(lambda self: self._bound(0, min))
    miny = property(lambda self: self._bound(1, min))
    maxx = property(lambda self: self._bound(0, max))
    maxy = property(lambda self: self._bound(1, max))

    @property
    def shape(self) -> Column:
        dot = lambda p: f"named_struct('x', {p[0]!r}D, 'y', {p[1]!r}D, 'z', {f'{p[2]!r}D' if len(p) > 2 else 'cast(null as double)'})"
        rings = ", ".join(f"array({', '.join(map(dot, r))})" for r in self.rings)
        radius = "null" if self.radius is None else f"{self.radius!r}D"
        return F.expr(f"cast(named_struct('kind', '{self.kind}', 'dim', {len(self.rings[0][0])}, 'rings', array({rings}), 'radius', {radius}) as {SHAPE_T})")


def boxed(features: DataFrame) -> DataFrame:
    if "minx" in features.columns:
        return features
    if "shape" not in features.columns:
        return features.withColumns({"minx": F.col("x"), "miny": F.col("y"), "maxx": F.col("x"), "maxy": F.col("y")})
    return with_mbr(features)


def meets_box(q: Query, margin: float = 0.0) -> Column:
    lo, hi = F.lit(q.minx - margin), F.lit(q.maxx + margin)
    return (F.col("minx") <= hi) & (F.col("maxx") >= lo) & (F.col("miny") <= F.lit(q.maxy + margin)) & (F.col("maxy") >= F.lit(q.miny - margin))


def in_box(q: Query) -> Column:
    return (F.col("minx") >= F.lit(q.minx)) & (F.col("maxx") <= F.lit(q.maxx)) & (F.col("miny") >= F.lit(q.miny)) & (F.col("maxy") <= F.lit(q.maxy))


def _chosen(rows: DataFrame, q: Query, known: dict[str, str], f) -> Column:
    """known[kind], SQL text, for features of that kind, and f, of the kernel, for the others."""
    if "shape" not in rows.columns:
        return F.expr(known["point"]) if "point" in known else f(q.shape, point(F.col("x"), F.col("y")), (q.kind,), ("point",))
    rest = [k for k in kernel.KINDS if k not in known]
    out = None
    for kind, text in known.items():
        test = F.col("shape.kind") == kind
        out = F.when(test, F.expr(text)) if out is None else out.when(test, F.expr(text))
    general = f(q.shape, F.col("shape"), (q.kind,), rest)
    return general if out is None else out.when(F.col("shape.kind").isin(rest), general)


def _small(q: Query) -> bool:
    return q.kind in ("polygon", "box") and sum(map(len, q.rings)) <= UNROLL


def contained(rows: DataFrame, q: Query) -> Column:
    """For boxed rows that are in q's box: q contains the feature."""
    known = {}
    if q.kind == "box":
        known = {"point": f"minx > {q.minx!r}D and minx < {q.maxx!r}D and miny > {q.miny!r}D and miny < {q.maxy!r}D", "box": "true", "polygon": "true", "circle": "true"}
    elif q.kind == "point":
        known = {"point": "true", **{k: "false" for k in kernel.KINDS[1:]}}
    elif _small(q):
        known = {"point": kernel.point_in_rings("minx", "miny", q.rings)}
    elif q.kind == "circle":
        known = {"point": f"{_planar(q)} <= {q.radius!r}D"}
    return _chosen(rows, q, known, kernel.contains)


def met(rows: DataFrame, q: Query) -> Column:
    """For boxed rows that meet q's box: they share a point with q."""
    known = {}
    if q.kind in ("box", "point"):
        known = {"point": "true", "box": "true"}
    elif _small(q):
        known = {"point": kernel.point_in_rings("minx", "miny", q.rings, closed=True)}
    elif q.kind == "circle":
        known = {"point": f"{_planar(q)} <= {q.radius!r}D", "box": f"{_planar_box(q)} <= {q.radius!r}D"}
    return _chosen(rows, q, known, kernel.intersects)


def _planar(q: Query) -> str:
    (x, y, *_), = q.rings[0]
    return f"sqrt((minx - {x!r}D) * (minx - {x!r}D) + (miny - {y!r}D) * (miny - {y!r}D))"


def _planar_box(q: Query) -> str:
    (x, y, *_), = q.rings[0]
    gap = lambda c, v: f"greatest(min{c} - {v!r}D, {v!r}D - max{c}, 0D)"
    return f"sqrt({gap('x', x)} * {gap('x', x)} + {gap('y', y)} * {gap('y', y)})"


def degrees_to(rows: DataFrame, q: Query) -> Column:
    """Planar distance of boxed rows from q."""
    known = {"point": _planar(q), "box": _planar_box(q)} if q.kind == "point" else {}
    return _chosen(rows, q, known, kernel.distance)


def shapes_of(features: DataFrame, uri: object) -> list[Query] | None:
    """The shapes of a uri as literals, if they have LITERAL_POINTS points at most; else None."""
    own = features.where(F.col("uri") == F.lit(uri))
    shape = F.col("shape") if "shape" in features.columns else point(F.col("x"), F.col("y")).cast(SHAPE_T)
    size = own.agg(F.sum(F.size(F.flatten(shape["rings"])))).first()[0] or 0
    return None if size > LITERAL_POINTS else [Query.from_row(r[0]) for r in own.select(shape.alias("s")).distinct().collect()]


def _any(features: DataFrame, q: object, near, test, join) -> DataFrame:
    """Rows that pass for q, or for some shape of the uri q."""
    rows = boxed(features)
    if isinstance(q, Query):
        return rows.where(near(q)).where(test(rows, q))
    found = shapes_of(features, q)
    if found is None:
        from . import spatial_join

        own = with_mbr(features.where(F.col("uri") == F.lit(q)).select("uri", "shape"))
        return rows.join(getattr(spatial_join, join)(own, rows).select(F.col("r_uri").alias("uri"), F.col("r_shape").alias("shape")), ["uri", "shape"], "left_semi")
    return rows.where(reduce(lambda a, b: a | b, [near(s) & test(rows, s) for s in found], F.lit(False)))


def contains(features: DataFrame, q: Query | object) -> DataFrame:
    """Features that the query shape contains.  A uri may or may not contain itself: as its shapes do."""
    return _any(features, q, in_box, contained, "contains_join")


def intersects(features: DataFrame, q: Query | object) -> DataFrame:
    """Features that share a point with the query shape; of a uri, itself included."""
    return _any(features, q, meets_box, met, "intersects_join")


def _least(rows: DataFrame, features: DataFrame, q: Query | object, f) -> Column:
    """f of the query, or the least over the shapes of a uri; null without any."""
    if isinstance(q, Query):
        return f(rows, q)
    found = shapes_of(features, q)
    if found is None:
        raise ValueError(f"the shapes of {q!r} have more than {LITERAL_POINTS} points: for these use spatial_join.distance_join")
    each = [f(rows, s) for s in found]
    return F.lit(None).cast("double") if not each else each[0] if len(each) == 1 else F.least(*each)


def nearest(features: DataFrame, q: Query | object, k: int | None = None, distance: str | None = None, options: Options | None = None) -> DataFrame:
    """Features by growing distance (in degrees, or by "haversine" in kilometres on the great circle for points), ties by uri.

    With k this is a top-k without a sort of all rows; without it rows can be pulled one by one with toLocalIterator().
    distance: as the options say if not given.
    """
    rows = boxed(features)
    if (distance or (options or Options()).distance_function) == "haversine":
        shape = F.col("shape") if "shape" in rows.columns else point(F.col("x"), F.col("y"))
        d = _least(rows, features, q, lambda _, s: measures.shape_greatcircle(s.shape, shape, "km"))
    else:
        d = _least(rows, features, q, degrees_to)
    rows = rows.withColumn("distance", d).where("distance is not null").orderBy("distance", "uri")
    return rows if k is None else rows.limit(k)


def nearest_bounded(features: DataFrame, q: Query | object, range_km: float | None = None, uri: object = None, k: int | None = None) -> DataFrame:
    """Features within range_km, nearest first, with distance_km; for a given uri the bound itself is left out; without a range all."""
    rows = boxed(features)
    if uri is not None:
        rows = rows.where(F.col("uri") == F.lit(uri))
    if range_km is not None and isinstance(q, Query):
        # Planar distance, so the box widened by the range in degrees loses nothing; a hair more covers rounding.
        rows = rows.where(meets_box(q, range_km / KM_PER_DEGREE * (1 + 1e-12)))
    rows = rows.withColumn("distance_km", _least(rows, features, q, degrees_to) * KM_PER_DEGREE)
    if range_km is not None:
        rows = rows.where(F.col("distance_km") < range_km if uri is not None else F.col("distance_km") <= range_km)
    rows = rows.where("distance_km is not null").orderBy("distance_km", "uri")
    return rows if k is None else rows.limit(k)


within_range = nearest_bounded


def distance_km(features: DataFrame, a: Query | object, b: Query | object) -> DataFrame:
    """distance_km, one row: kilometres between two shapes, or the nearest shapes of uris; null if a uri has none."""
    sides = [F.array(s.shape) if isinstance(s, Query) else None for s in (a, b)]
    wanted = [s for s in (a, b) if not isinstance(s, Query)]
    rows = features.where(F.col("uri").isin(wanted)) if wanted else features.sparkSession.range(1).select(F.lit(None).cast("string").alias("uri"), F.lit(None).cast(SHAPE_T).alias("shape"))
    of = lambda s, side: side if side is not None else F.collect_list(F.when(F.col("uri") == F.lit(s), F.col("shape")))
    own = rows.agg(F.count(F.lit(1)).alias("n"), *[of(s, side).alias(c) for s, side, c in zip((a, b), sides, "ab") if side is None])
    own = own.select(*[(side if side is not None else F.col(c)).alias(c) for side, c in zip(sides, "ab")])
    least = F.array_min(F.transform("a", lambda s: F.array_min(F.transform("b", lambda t: kernel.distance(s, t)))))
    return own.select((least * KM_PER_DEGREE).alias("distance_km"))


def store(features: DataFrame, path: str, cell: float | None = None, rows_per_file: int | None = None, options: Options | None = None) -> None:
    """Features as Parquet files that are clustered by cell, so that box conjuncts skip files and row groups.  What isn't given is as the options say."""
    options = options or Options()
    cell, rows_per_file = cell or options.cell_size or 1.0, rows_per_file or options.target_rows_per_file
    rows = boxed(features).withColumn("_cx", F.floor(F.col("minx") / cell)).withColumn("_cy", F.floor(F.col("miny") / cell))
    clustered = rows.repartitionByRange("_cx", "_cy").sortWithinPartitions("_cx", "_cy", "minx", "miny").drop("_cx", "_cy")
    clustered.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def partition_mbrs(features: DataFrame, cell: float = 1.0) -> DataFrame:
    """What a tree dump would show: the bounding box and number of the features of each cell."""
    rows = boxed(features)
    return rows.groupBy(F.floor(F.col("minx") / cell).alias("cx"), F.floor(F.col("miny") / cell).alias("cy")).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.count(F.lit(1)).alias("n"))
