"""Joins of two tables by place or time, as equi-joins on grid cells.

Spark plans a join on ranges as a nested loop.  Here both sides are exploded over the cells that their boxes
touch and joined on the cell; a pair is emitted only in the cell that holds the lower corner of the intersection of
the boxes, so it comes out once without a distinct.

The grid has levels, each with cells four times as wide as the one below.  The finest has cells as wide as nearly all boxes of the wider side, or as
its median box where sizes differ much; a box is dealt on the lowest level whose cells are at least as wide as itself, hence to four cells at most, and on the levels above that
which the other side uses.  So one very large box adds a level, not a cell for every small one, and a pair meets on the level of its larger box.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel
from ..options import Options
from ..storage import discard, written

BOX = ("minx", "miny", "maxx", "maxy")
_BOX_AXES = (("minx", "maxx"), ("miny", "maxy"))
_TIME_AXES = (("t_begin", "t_end"),)


class _Grid:
    """Cell width of the lowest level, and the levels that each side uses."""

    def __init__(self, sides: dict[str, DataFrame], axes, margin: float, cell: float | None, flat: bool = False):
        self.axes, self.margin = axes, {"l_": margin, "r_": 0.0}
        self.cell = cell or self._cell(sides)
        if flat:  # the caller knows that no box is wider than a cell
            self.flat = True
            return
        self.levels = {p: sorted({r[0] for r in df.select(self.level(self._side(p)).alias("l")).distinct().collect() if r[0] is not None}) for p, df in sides.items()}
        self.flat = all(v in ([], [0]) for v in self.levels.values())

    def _cell(self, sides: dict[str, DataFrame]) -> float:
        found = {}
        for p, df in sides.items():
            lo, hi = self.axes[0]
            found[p] = df.agg(F.percentile_approx(self._side(p), [0.5, 0.99], 1000), F.max(hi) - F.min(lo), F.count(F.lit(1))).first()
        # Boxes without extent: about a row a cell.
        apart = max((r[1] or 0.0) / max(1.0, sqrt(r[2])) for r in found.values())
        # Nearly all boxes on one level where they are of like size; else half of them, and the wider ones above.
        width = lambda half, most: most if most <= 4 * half else half
        return max(*[width(*r[0]) if r[0] else 0.0 for r in found.values()], 0.0) or apart or 1.0

    def level(self, side: Column) -> Column:
        """0 for boxes up to a cell wide.  Widths of all levels are the lowest's times powers of four, exactly."""
        up = F.ceil(F.log(side / self.cell) / log(4) - 1e-9)
        return F.when(side <= self.cell, 0).otherwise(F.greatest(up, F.lit(1)) + F.when(side > self.width(F.greatest(up, F.lit(1))), 1).otherwise(0)).cast("int")

    def width(self, level: Column) -> Column:
        return F.lit(self.cell) * F.pow(F.lit(4.0), level)

    def dealt(self, df: DataFrame, p: str) -> DataFrame:
        """df with its columns prefixed, a row for each cell it is dealt to: _m (unless there is one level), _c0, _c1."""
        rows = df.toDF(*[p + c for c in df.columns])
        width = F.lit(self.cell)
        if not self.flat:
            rows = rows.withColumn(p + "_level", self.level(self._side(p, p)))
            other = self.levels["r_" if p == "l_" else "l_"]
            above = F.filter(F.array(*[F.lit(m) for m in other]).cast("array<int>"), lambda m: m > F.col(p + "_level"))
            rows = rows.withColumn("_m", F.explode(F.concat(F.array(F.col(p + "_level")), above)))
            width = self.width(F.col("_m"))
        m = self.margin[p]
        for i, (lo, hi) in enumerate(self.axes):
            rows = rows.withColumn(f"_c{i}", F.explode(F.sequence(F.floor((F.col(p + lo) - m) / width), F.floor((F.col(p + hi) + m) / width))))
        return rows

    def _side(self, p: str, prefix: str = "") -> Column:
        """The widest side of a box of side p, margin included."""
        sides = [F.col(prefix + hi) - F.col(prefix + lo) for lo, hi in self.axes]
        return (F.greatest(*sides) if len(sides) > 1 else sides[0]) + 2 * self.margin[p]

    @property
    def keys(self) -> list[str]:
        return ([] if self.flat else ["_m"]) + [f"_c{i}" for i in range(len(self.axes))]

    def meet(self) -> Column:
        m, tests = self.margin["l_"], []
        for lo, hi in self.axes:
            tests += [F.col("l_" + lo) - m <= F.col("r_" + hi), F.col("l_" + hi) + m >= F.col("r_" + lo)]
        if not self.flat:
            tests.append(F.col("_m") == F.greatest("l__level", "r__level"))
        return _every(tests)

    def home(self) -> Column:
        width = F.lit(self.cell) if self.flat else self.width(F.col("_m"))
        return _every([F.floor(F.greatest(F.col("l_" + lo) - self.margin["l_"], F.col("r_" + lo)) / width) == F.col(f"_c{i}") for i, (lo, _) in enumerate(self.axes)])


def _every(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _spread(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two small tables are shuffled by cell: a broadcast join would have as few tasks as the other side has files, however many pairs come out.

    If only one is small, Spark broadcasts it after its own check of the size and leaves the large one where it is; two large ones it shuffles.
    """
    most = int(a.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    bytes_of = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return (a.hint("merge"), b.hint("merge")) if max(bytes_of(a), bytes_of(b)) <= most else (a, b)


def _joined(left: DataFrame, right: DataFrame, axes, margin: float, cell: float | None, flat: bool = False) -> DataFrame:
    grid = _Grid({"l_": left, "r_": right}, axes, margin, cell, flat)
    a, b = _spread(grid.dealt(left, "l_"), grid.dealt(right, "r_"))
    pairs = a.join(b, grid.keys).where(grid.meet() & grid.home())
    return pairs.drop(*grid.keys, "l__level", "r__level")


def box_join(left: DataFrame, right: DataFrame, exact: Callable[[], Column] | None = None, margin: float = 0.0, cell: float | None = None, options: Options | None = None) -> DataFrame:
    """Pairs whose boxes, left ones widened by margin, meet and that pass ``exact``.

    Columns of left are prefixed with l_, those of right with r_.  A hot cell is split by adaptive skew-join handling.  Rows without a box join nothing.
    """
    pairs = _joined(left, right, _BOX_AXES, margin, cell or (options or Options()).cell_size)
    return pairs if exact is None else pairs.where(exact())


def neighbours(left: DataFrame, right: DataFrame, exact: Callable[[], Column] | None = None, margin: float = 0.0, cell: float | None = None, anti: bool = False) -> DataFrame:
    """Rows of left (uri, ...) that some row of right joins with as in box_join, or with anti those that none does.

    A semi-join on the cells, which stops at a row's first partner in a cell: no table of all pairs is made.
    """
    grid = _Grid({"l_": left, "r_": right}, _BOX_AXES, margin, cell)
    test = grid.meet() if exact is None else grid.meet() & exact()
    a, b = grid.dealt(left, "l_"), grid.dealt(right, "r_")
    for k in grid.keys:
        b = b.withColumnRenamed(k, "r" + k)
    on = _every([F.col(k) == F.col("r" + k) for k in grid.keys])
    found = a.join(b, on & test, "left_semi").select(F.col("l_uri").alias("uri")).distinct()
    return left.join(found, "uri", "left_anti" if anti else "left_semi")


def intersects_join(left: DataFrame, right: DataFrame, cell: float | None = None) -> DataFrame:
    return box_join(left, right, lambda: kernel.intersects(F.col("l_shape"), F.col("r_shape")), cell=cell)


def contains_join(left: DataFrame, right: DataFrame, cell: float | None = None) -> DataFrame:
    """Pairs of which the left shape contains the right one."""
    return box_join(left, right, lambda: kernel.contains(F.col("l_shape"), F.col("r_shape")), cell=cell)


def distance_join(left: DataFrame, right: DataFrame, degrees: float, cell: float | None = None) -> DataFrame:
    """Pairs at most so far apart, with their distance."""
    pairs = box_join(left, right, margin=degrees, cell=cell)
    return pairs.withColumn("distance", kernel.distance(F.col("l_shape"), F.col("r_shape"))).where(F.col("distance") <= degrees)


def knn_join(queries: DataFrame, points: DataFrame, k: int, start: float | None = None) -> DataFrame:
    """The k nearest points of each query point, ties by uri: q_uri, rank, p_uri, distance.

    queries and points: uri, x, y; rows without a finite place take no part.  Rounds with a growing radius: a query is done once k points lie within
    the radius; only the others go on.  Each round is a cell join that starts from what the round before wrote, so plans stay as they are,
    and the last radius spans both tables, so every query is done in the end.  start: the first radius; None: what holds about k points if they were spread evenly.
    """
    finite = lambda df: df.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    square = lambda df: finite(df).select("uri", "x", "y", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))
    left, right = square(queries), written(square(points), "knn-points")
    span = [F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count(F.lit(1))]
    (ax, ay, bx, by, n), (cx, cy, dx, dy, m) = right.agg(*span).first(), left.agg(*span).first()
    out = None
    if n and m:
        most = sqrt((max(bx, dx) - min(ax, cx)) ** 2 + (max(by, dy) - min(ay, cy)) ** 2) * (1 + 1e-9) or 1.0
        radius = min(most, start or max(sqrt(max(bx - ax, 1e-9) * max(by - ay, 1e-9) * k / n), most * 1e-9))
        left, w = written(left, "knn-left"), Window.partitionBy("q_uri").orderBy("distance", "p_uri")
        while True:
            gx, gy = F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y")
            near = _joined(left, right, _BOX_AXES, radius, 2 * radius, flat=True).select(F.col("l_uri").alias("q_uri"), F.col("r_uri").alias("p_uri"), F.sqrt(gx * gx + gy * gy).alias("distance"))
            near = near.where(F.col("distance") <= radius).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            near = written(near, "knn-near")
            full = near.groupBy("q_uri").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, n)).select("q_uri")
            done = near if radius >= most else near.join(full, "q_uri", "left_semi")
            out = done if out is None else out.unionByName(done)
            if radius >= most:
                break
            rest = written(left.join(full.withColumnRenamed("q_uri", "uri"), "uri", "left_anti"), "knn-left")
            discard(left)
            left = rest
            if left.isEmpty():
                break
            radius = min(most, 2 * radius)
    kinds = {"q_uri": queries, "rank": None, "p_uri": points, "distance": None}
    types = {c: ("int" if c == "rank" else "double") if df is None else df.schema["uri"].dataType for c, df in kinds.items()}
    if out is None:
        return queries.sparkSession.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    return out.select("q_uri", "rank", "p_uri", "distance")


def interval_join(left: DataFrame, right: DataFrame, bucket: float | None = None) -> DataFrame:
    """Pairs of uri, t_begin, t_end rows whose times overlap, bounds included, by buckets on levels as boxes are.

    A null bound is open: such an interval reaches as far as any time of either table.  Columns of left are prefixed with l_, those of right with r_.
    """
    span = [df.agg(F.min(F.least("t_begin", "t_end")), F.max(F.greatest("t_begin", "t_end"))).first() for df in (left, right)]
    low, high = min((r[0] for r in span if r[0] is not None), default=0.0), max((r[1] for r in span if r[1] is not None), default=0.0)

    def closed(df: DataFrame) -> DataFrame:
        open_row = F.struct(F.col("t_begin").alias("b"), F.col("t_end").alias("e"))
        return df.withColumns({"_own": open_row, "t_begin": F.coalesce("t_begin", F.lit(low)), "t_end": F.coalesce("t_end", F.lit(high))}).where("t_begin <= t_end")

    pairs = _joined(closed(left), closed(right), _TIME_AXES, 0.0, bucket)
    for p in ("l_", "r_"):
        pairs = pairs.withColumns({p + "t_begin": F.col(p + "_own.b"), p + "t_end": F.col(p + "_own.e")})
    return pairs.drop("l__own", "r__own")
