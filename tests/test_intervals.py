"""Unions and the last interval before a point, cut into stretches of any width, against brute force."""

import random

import pytest

from varilume.operators.intervals import asof_interval, interval_union

WIDTHS = (7, 64, 1 << 18)


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("width", WIDTHS)
def test_union(spark, width):
    r = random.Random(1)
    rows = []
    for region in (0, 1, 2, None):
        for _ in range(80):
            a = r.randrange(600)
            # some run over many stretches, some touch, some repeat
            rows.append((region, a, a + r.choice((0, 1, 2, 3, 3, 40 if region == 1 else 4))))
    rows += [(3, 5, 500), (3, 100, 120), (3, 501, 501), (3, 503, 503), (0, None, 4), (0, 4, None)]
    df = spark.createDataFrame(rows, "region long, a long, b long").repartition(5)
    got = sorted(((x.region, x.a, x.b) for x in interval_union(df, ["region"], "a", "b", width).collect()), key=repr)
    want = [(k, *s) for k in (0, 1, 2, 3, None) for s in merged([(a, b) for g, a, b in rows if g == k and a is not None and b is not None])]
    assert got == sorted(want, key=repr)
    assert interval_union(df.limit(0), ["region"], "a", "b", width).count() == 0


@pytest.mark.parametrize("width", WIDTHS)
def test_last_interval_before(spark, width):
    r = random.Random(2)
    intervals = [(k, 50 * i + r.randrange(20), 50 * i + 20 + r.randrange(25)) for k in (0, 1) for i in range(2, 40, 3)]
    points = [(n, r.choice((0, 1, 2)), r.randrange(2200)) for n in range(400)] + [(1000 + n, k, p) for n, (k, a, b) in enumerate(intervals) for p in (a, b)] + [(5, 0, 700), (5, 0, 700), (6, 0, None)]
    p = spark.createDataFrame(points, "n long, region long, at long").repartition(5)
    i = spark.createDataFrame(intervals, "region long, a long, b long").repartition(3)
    got = sorted(((x.n, x.region, x["at"], x.a, x.b, x.inside) for x in asof_interval(p, i, "region", "at", "a", "b", width).collect()), key=repr)
    want = []
    for n, k, at in points:
        a, b = max(((a, b) for g, a, b in intervals if g == k and at is not None and a <= at), default=(None, None))
        want.append((n, k, at, a, b, b is not None and b >= at))
    assert got == sorted(want, key=repr)
    assert asof_interval(p, i.limit(0), "region", "at", "a", "b", width).filter("a is null and not inside").count() == len(points)
