"""Exact planar predicates and distance between shapes.

Each is built as one SQL text, chosen by the kinds that its two sides may have, and parsed by Spark in one go; a side whose
kind is known, such as a query's own shape, brings only the branches that kind needs.  No tolerance anywhere: a point is on a
segment only if the cross product is exactly zero, and crossings are counted without division.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("point", "linestring", "polygon", "box", "circle")
#: Kinds that go through the same formulas.
_CLASS = {"point": "point", "linestring": "line", "polygon": "area", "box": "area", "circle": "circle"}
_fresh = count()


def _name(prefix: str) -> str:
    return f"{prefix}{next(_fresh) % 100_000}"


def _let(value: str, use: Callable[[str], str]) -> str:
    v = _name("v")
    return f"get(transform(array({value}), {v} -> {use(v)}), 0)"


def _exists(items: str, test: Callable[[str], str]) -> str:
    v = _name("e")
    return f"exists({items}, {v} -> {test(v)})"


def _all(items: str, test: Callable[[str], str]) -> str:
    v = _name("f")
    return f"forall({items}, {v} -> {test(v)})"


def _map(items: str, f: Callable[[str], str]) -> str:
    v = _name("m")
    return f"transform({items}, {v} -> {f(v)})"


def _each(items: str, f: Callable[[str], str]) -> str:
    return f"flatten({_map(items, f)})"


# Parts of a shape


def _ring(s: str) -> str:
    return f"get({s}.rings, 0)"


def _first(s: str) -> str:
    return f"get({_ring(s)}, 0)"


def _points(s: str) -> str:
    return f"flatten({s}.rings)"


def _holes(s: str) -> str:
    return f"slice({s}.rings, 2, greatest(size({s}.rings) - 1, 0))"


def _segments(ring: str) -> str:
    a, b = _name("a"), _name("b")
    return f"zip_with(slice({ring}, 1, greatest(size({ring}) - 1, 0)), slice({ring}, 2, greatest(size({ring}) - 1, 0)), ({a}, {b}) -> struct({a} as a, {b} as b))"


def _edges(s: str) -> str:
    return _each(f"{s}.rings", _segments)


# Points and segments


def _turn(a: str, b: str, p: str) -> str:
    """Twice the signed area of a, b, p."""
    return f"(({b}.x - {a}.x) * ({p}.y - {a}.y) - ({b}.y - {a}.y) * ({p}.x - {a}.x))"


def _same(p: str, q: str) -> str:
    return f"({p}.x = {q}.x and {p}.y = {q}.y)"


def _on_segment(p: str, s: str) -> str:
    a, b = f"{s}.a", f"{s}.b"
    inside = " and ".join(f"{p}.{c} between least({a}.{c}, {b}.{c}) and greatest({a}.{c}, {b}.{c})" for c in "xy")
    return f"({inside} and {_turn(a, b, p)} = 0)"


def _on_ring(p: str, ring: str) -> str:
    return _exists(_segments(ring), lambda s: _on_segment(p, s))


def _on_edges(p: str, s: str) -> str:
    return _exists(_edges(s), lambda e: _on_segment(p, e))


def _odd_crossings(p: str, ring: str) -> str:
    """Even-odd rule with the division-free crossing test."""
    t, s = _name("t"), _name("s")
    o = _turn(f"{s}.a", f"{s}.b", p)
    crosses = f"((({s}.a.y > {p}.y) != ({s}.b.y > {p}.y)) and {o} != 0 and (({o} > 0) = ({s}.b.y > {s}.a.y)))"
    return f"aggregate({_segments(ring)}, false, ({t}, {s}) -> {t} != {crosses})"


def _in_area(p: str, s: str) -> str:
    """In the closed polygon."""
    return f"(({_on_ring(p, _ring(s))} or {_odd_crossings(p, _ring(s))}) and not {_exists(_holes(s), lambda h: f'({_odd_crossings(p, h)} and not {_on_ring(p, h)})')})"


def _in_interior(p: str, s: str) -> str:
    """Strictly inside the polygon."""
    return f"({_odd_crossings(p, _ring(s))} and not {_on_ring(p, _ring(s))} and not {_exists(_holes(s), lambda h: f'({_odd_crossings(p, h)} or {_on_ring(p, h)})')})"


def _opposite(s: str, t: str) -> str:
    return f"signum({_turn(f'{s}.a', f'{s}.b', f'{t}.a')}) * signum({_turn(f'{s}.a', f'{s}.b', f'{t}.b')}) < 0"


def _cross(s: str, t: str) -> str:
    """In one point inside both."""
    return f"({_opposite(s, t)} and {_opposite(t, s)})"


def _meet(s: str, t: str) -> str:
    ends = [_on_segment(f"{t}.a", s), _on_segment(f"{t}.b", s), _on_segment(f"{s}.a", t), _on_segment(f"{s}.b", t)]
    return f"({_cross(s, t)} or {' or '.join(ends)})"


def _edge_pairs(a: str, b: str, test: Callable[[str, str], str]) -> str:
    """Some edge of a and some edge of b pass the test; b's edges are made once."""
    return _let(_edges(b), lambda e: _exists(_edges(a), lambda s: _exists(e, lambda t: test(s, t))))


def _middles(s: str, rings: str) -> str:
    """Midpoints of the parts into which the vertices of rings that lie on the segment cut it."""
    a, b = f"{s}.a", f"{s}.b"
    dx, dy = f"({b}.x - {a}.x)", f"({b}.y - {a}.y)"
    p, q, t, u = _name("p"), _name("q"), _name("t"), _name("u")
    along = f"transform(filter(flatten({rings}), {p} -> {_on_segment(p, s)}), {q} -> (({q}.x - {a}.x) * {dx} + ({q}.y - {a}.y) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0))"
    cuts = f"array_sort(array_distinct(concat(array(0D, 1D), filter({along}, {t} -> {t} > 0 and {t} < 1))))"
    middle = lambda t, u: f"struct({a}.x + ({t} + {u}) / 2 * {dx} as x, {a}.y + ({t} + {u}) / 2 * {dy} as y)"
    return _let(cuts, lambda c: f"zip_with(slice({c}, 1, size({c}) - 1), slice({c}, 2, size({c}) - 1), ({t}, {u}) -> {middle(t, u)})")


def _flat(points: str) -> str:
    """Points without z, to stand in one array with midpoints."""
    return _map(points, lambda p: f"struct({p}.x as x, {p}.y as y)")


def _with_middles(s: str, rings: str) -> str:
    """The points of a shape, and the midpoints of its edges as cut by the vertices of rings."""
    return f"concat({_flat(_points(s))}, {_each(_edges(s), lambda e: _middles(e, rings))})"


def _between(p: str, q: str) -> str:
    return f"sqrt(({p}.x - {q}.x) * ({p}.x - {q}.x) + ({p}.y - {q}.y) * ({p}.y - {q}.y))"


def _to_segment(p: str, s: str) -> str:
    a = f"{s}.a"
    dx, dy = f"({s}.b.x - {a}.x)", f"({s}.b.y - {a}.y)"
    t = f"coalesce(greatest(0D, least(1D, (({p}.x - {a}.x) * {dx} + ({p}.y - {a}.y) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0))), 0D)"
    return _let(t, lambda t: f"sqrt(({p}.x - ({a}.x + {t} * {dx})) * ({p}.x - ({a}.x + {t} * {dx})) + ({p}.y - ({a}.y + {t} * {dy})) * ({p}.y - ({a}.y + {t} * {dy})))")


def _to_edges(p: str, s: str) -> str:
    return f"array_min({_map(_edges(s), lambda e: _to_segment(p, e))})"


def _line_ends(s: str, p: str) -> str:
    """p is an end of the open line."""
    last = f"element_at({_ring(s)}, -1)"
    return f"(not {_same(_first(s), last)} and ({_same(p, _first(s))} or {_same(p, last)}))"


def _in_line(p: str, s: str) -> str:
    """On the line, but not at its ends."""
    return f"({_on_edges(p, s)} and not {_line_ends(s, p)})"


# By class of both sides.  a and b are names; a formula may use each as often as it likes.


def _intersects(a: str, x: str, b: str, y: str) -> str:
    order = ("point", "line", "area", "circle")
    if order.index(x) > order.index(y):
        a, x, b, y = b, y, a, x
    if y == "circle":
        return f"({_between(_first(a), _first(b))} <= {a}.radius + {b}.radius)" if x == "circle" else f"({_from_point(_first(b), a, x)} <= {b}.radius)"
    if x == "point":
        return {"point": _same, "line": _on_edges, "area": _in_area}[y](_first(a), _first(b) if y == "point" else b)
    # Without a common point of edges one shape is inside the other or outside, whole.
    inside = [_in_area(_first(s), t) for s, t, kind in ((a, b, y), (b, a, x)) if kind == "area"]
    return "(" + " or ".join([_edge_pairs(a, b, _meet), *inside]) + ")"


def _from_point(p: str, s: str, kind: str) -> str:
    """Distance of a point from a shape."""
    if kind == "point":
        return _between(p, _first(s))
    if kind == "circle":
        return f"greatest(0D, {_between(p, _first(s))} - {s}.radius)"
    away = _to_edges(p, s)
    return away if kind == "line" else f"CASE WHEN {_in_area(p, s)} THEN 0D ELSE {away} END"


def _distance(a: str, x: str, b: str, y: str) -> str:
    if x == "point":
        return _from_point(_first(a), b, y)
    if y == "point":
        return _from_point(_first(b), a, x)
    if x == "circle":
        return f"greatest(0D, {_from_point(_first(a), b, y)} - {a}.radius)"
    if y == "circle":
        return f"greatest(0D, {_from_point(_first(b), a, x)} - {b}.radius)"
    nearest = lambda s, t: f"array_min({_map(_points(s), lambda p: _to_edges(p, t))})"
    return f"CASE WHEN {_intersects(a, x, b, y)} THEN 0D ELSE least({nearest(a, b)}, {nearest(b, a)}) END"


def _contains(a: str, x: str, b: str, y: str) -> str:
    p = _first(b)
    if x == "circle":
        if y == "circle":
            return f"({_between(_first(a), p)} + {b}.radius <= {a}.radius)"
        return _all(_points(b), lambda q: f"{_between(_first(a), q)} <= {a}.radius")
    if x == "point":
        return _same(_first(a), p) if y == "point" else "false"
    if x == "line":
        if y == "point":
            return _in_line(p, a)
        return _all(_with_middles(b, f"{a}.rings"), lambda q: _on_edges(q, a)) if y == "line" else "false"
    if y == "point":
        return _in_interior(p, a)
    if y == "circle":
        return f"({_in_interior(p, a)} and {_to_edges(p, a)} >= {b}.radius)"
    uncut = f"not {_edge_pairs(a, b, _cross)}"
    if y == "line":
        return _let(_with_middles(b, f"{a}.rings"), lambda q: f"({uncut} and {_all(q, lambda v: _in_area(v, a))} and {_exists(q, lambda v: _in_interior(v, a))})")
    # b's boundary is in a, no hole of a reaches into b, and b isn't itself a hole of a.
    inside = _all(_with_middles(b, f"{a}.rings"), lambda v: _in_area(v, a))
    open_hole = lambda h: _exists(f"concat({_flat(h)}, {_each(_segments(h), lambda e: _middles(e, f'{b}.rings'))})", lambda v: _in_interior(v, b))
    shell = lambda h: f"concat({_flat(_ring(b))}, {_each(_segments(_ring(b)), lambda e: _middles(e, f'array({h})'))})"
    is_hole = lambda h: _all(shell(h), lambda v: _on_ring(v, h))
    return f"({uncut} and {inside} and not {_exists(_holes(a), lambda h: f'({open_hole(h)} or {is_hole(h)})')})"


def _touches(a: str, x: str, b: str, y: str) -> str:
    """The shapes meet, but only where one of them has its boundary.  A circle is a disc."""
    if "circle" in (x, y):
        if x != "circle":
            a, x, b, y = b, y, a, x
        gap = _from_point(_first(a), b, "point" if y == "circle" else y)
        return f"({gap} = {a}.radius + {b}.radius)" if y == "circle" else f"({gap} = {a}.radius)"
    deep = []
    if x == "area":
        deep.append(_exists(_with_middles(b, f"{a}.rings"), lambda q: _in_interior(q, a)))
    if y == "area":
        deep.append(_exists(_with_middles(a, f"{b}.rings"), lambda q: _in_interior(q, b)))
    if x == y == "line":
        both = lambda q: f"({_in_line(q, a)} and {_in_line(q, b)})"
        deep += [_exists(_with_middles(s, f"{t}.rings"), both) for s, t in ((a, b), (b, a))]
    if "point" not in (x, y):
        deep.append(_edge_pairs(a, b, _cross))
    if "point" in (x, y) or x == y == "area":  # equal shapes too
        deep += [_contains(a, x, b, y), _contains(b, y, a, x)]
    return f"({_intersects(a, x, b, y)} and not ({' or '.join(deep)}))"


Formula = Callable[[str, str, str, str], str]


def _by_kind(s: str, kinds: Sequence[str], f: Callable[[str], str]) -> str:
    """f of the class of s, by its kind if it can be of several."""
    classes: dict[str, list[str]] = {}
    for k in kinds:
        classes.setdefault(_CLASS[k], []).append(k)
    if len(classes) == 1:
        return f(next(iter(classes)))
    whens = " ".join(f"WHEN {s}.kind IN ({', '.join(map(repr, names))}) THEN {f(c)}" for c, names in classes.items())
    return f"CASE {whens} END"


def _applied(f: Formula, a: Column, b: Column, a_kinds: Sequence[str], b_kinds: Sequence[str]) -> Column:
    """f of two shapes, each of which enters the plan once."""
    s = _name("s")
    text = _by_kind(f"{s}.a", a_kinds, lambda x: _by_kind(f"{s}.b", b_kinds, lambda y: f(f"{s}.a", x, f"{s}.b", y)))
    return F.get(F.call_function("transform", F.array(F.struct(a.alias("a"), b.alias("b"))), F.expr(f"{s} -> {text}")), F.lit(0))


def intersects(a: Column, b: Column, a_kinds: Sequence[str] = KINDS, b_kinds: Sequence[str] = KINDS) -> Column:
    """The shapes share a point; a circle stands for the disc of its radius."""
    return _applied(_intersects, a, b, a_kinds, b_kinds)


def contains(a: Column, b: Column, a_kinds: Sequence[str] = KINDS, b_kinds: Sequence[str] = KINDS) -> Column:
    """No point of b is outside a, and their interiors meet: a point on a polygon's boundary isn't contained."""
    return _applied(_contains, a, b, a_kinds, b_kinds)


def touches(a: Column, b: Column, a_kinds: Sequence[str] = KINDS, b_kinds: Sequence[str] = KINDS) -> Column:
    """The shapes meet, but only where one of them has its boundary."""
    return _applied(_touches, a, b, a_kinds, b_kinds)


def distance(a: Column, b: Column, a_kinds: Sequence[str] = KINDS, b_kinds: Sequence[str] = KINDS) -> Column:
    """In coordinate units (degrees): 0 if the shapes intersect."""
    return _applied(_distance, a, b, a_kinds, b_kinds)


# One literal shape against points given by two numbers: plain arithmetic, without arrays.


def point_in_rings(x: str, y: str, rings: Sequence[Sequence[Sequence[float]]], closed: bool = False) -> str:
    """SQL text: inside the polygon whose rings are given as numbers, strictly or, if closed, on its boundary too."""

    def ring(points: Sequence[Sequence[float]]) -> tuple[str, str]:
        odd, on = [], []
        for (ax, ay, *_), (bx, by, *_) in zip(points, points[1:]):
            o = f"({bx - ax!r}D * ({y} - {ay!r}D) - {by - ay!r}D * ({x} - {ax!r}D))"
            if ay != by:
                odd.append(f"CASE WHEN {y} >= {min(ay, by)!r}D AND {y} < {max(ay, by)!r}D AND {o} {'>' if by > ay else '<'} 0 THEN 1 ELSE 0 END")
            on.append(f"({x} between {min(ax, bx)!r}D and {max(ax, bx)!r}D and {y} between {min(ay, by)!r}D and {max(ay, by)!r}D and {o} = 0)")
        return f"(({' + '.join(odd) or '0'}) % 2 = 1)", f"({' or '.join(on) or 'false'})"

    (odd, on), *holes = [ring([[float(v) for v in p] for p in r]) for r in rings]
    if closed:
        return " and ".join([f"({odd} or {on})", *(f"not ({o} and not {at})" for o, at in holes)])
    return " and ".join([odd, f"not {on}", *(f"not ({o} or {at})" for o, at in holes)])
