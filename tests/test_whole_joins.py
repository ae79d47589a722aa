"""Time joins over whole tables, against brute force."""

from bisect import bisect_right

from geochron.plans import views
from geochron.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_interval_join_of_all_intervals(spark):
    rows = sorted((r["uri"], r["t_begin"], r["t_end"]) for r in views.intervals(spark, SF).collect())
    want = [(a, b) for i, (a, begin, end) in enumerate(rows) for b, b_begin, b_end in rows[i + 1 :] if begin <= b_end and end >= b_begin]
    assert sorted(map(tuple, QUERIES["interval_join"](spark, SF).collect())) == sorted(want)


def test_asof_previous_end_of_all_events(spark):
    last = {}
    for r in views.intervals(spark, SF).where("t_end is not null").collect():
        last[r["t_end"]] = min(r["uri"], last.get(r["t_end"], r["uri"]))
    ends = sorted(last)
    want = []
    for r in views.spacetime_features(spark, SF).select("uri", "t_begin").collect():
        i = bisect_right(ends, r["t_begin"] - 800000000)
        if i:
            want.append((r["uri"], last[ends[i - 1]], ends[i - 1]))
    assert sorted(map(tuple, QUERIES["asof_previous_end"](spark, SF).collect())) == sorted(want)
