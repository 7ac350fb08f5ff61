import math
import random

import numpy as np
import pytest

from gristmill.operators import regions as rg

POINTS = "id bigint, lat double, lng double"
POLYGONS = "region bigint, rings array<array<struct<lat: double, lng: double>>>"


def ring(*points):
    return [{"lat": float(a), "lng": float(b)} for a, b in points]


def star(lat, lng, r, n, seed):
    rng = random.Random(seed)
    return ring(*((max(-90, min(90, lat + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n))), lng + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)))


def brute(points, polygons):
    out = set()
    for region, rings in polygons:
        edges = rg.edges_of([r for r in rings or [] if r])
        for i, lat, lng in points:
            if lat is not None and len(edges) and any(rg.inside(edges, lat, lng + t) for t in (-360, 0, 360)):
                out.add((region, i))
    return out


def found(spark, points, polygons, **kw):
    got = [tuple(r) for r in rg.points_in_regions(spark.createDataFrame(points, POINTS), spark.createDataFrame(polygons, POLYGONS), **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("steps", [0, 1, 3])
def test_against_all_edges(spark, steps):
    rng = random.Random(steps)
    polygons = [(1, [star(50, 8, 3, 30, 1)]), (2, [star(0, 179.5, 5, 12, 2)]), (3, [star(0, -179.5, 5, 12, 3)]), (4, [star(-60, 20, 40, 80, 4)]), (5, [star(50, 8, 0.001, 5, 5)])]
    polygons.append((6, [star(50, 8, 3, 30, 6), star(50, 8, 1, 9, 7)]))  # an inner ring is a hole
    polygons.append((7, [ring((70, -180), (70, 180), (90, 180), (90, -180))]))  # around the pole
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(500)]
    points += [(1000 + i, 50 + rng.gauss(0, 2), 8 + rng.gauss(0, 2)) for i in range(500)] + [(2000 + i, rng.gauss(0, 3), (180 + rng.gauss(0, 3) + 180) % 360 - 180) for i in range(300)]
    points += [(3000, 90.0, 0.0), (3001, 90.0, 180.0), (3002, -90.0, 5.0), (3003, 70.0, 0.0), (3004, 50.0, 8.0)]
    want = brute(points, polygons)
    assert found(spark, points, polygons, steps=steps) == want and len({r for r, _ in want}) >= 6


def test_interior_cells_need_no_edges():
    edges = rg.edges_of([star(10, 20, 5, 40, 1)])
    cells = list(rg.cover(edges))
    inner = [c for c in cells if c[4]]
    area = lambda c: 4.0 ** -c[0]
    assert inner and all(len(c[5]) == 0 for c in inner) and sum(map(area, inner)) > 0.5 * sum(map(area, cells))
    assert len({c[0] for c in cells}) > 1 and np.mean([len(c[5]) for c in cells if not c[4]]) < len(edges) / 2


def test_odd_input(spark):
    nan = float("nan")
    square = [ring((0, 0), (0, 10), (10, 10), (10, 0))]
    points = [(1, 5.0, 5.0), (1, 5.0, 5.0001), (2, None, 5.0), (3, nan, 5.0), (4, 5.0, 181.0), (None, 5.0, 5.0), (5, 0.0, 0.0), (6, 10.0, 10.0)]
    polygons = [(1, square), (2, None), (3, []), (4, [ring((0, 0), (1, 1))]), (None, square), (5, [None])]
    df = spark.createDataFrame(points, POINTS).selectExpr("*", "'n' as cell", "1 as region", "2 as x", "3 as edges")
    got = rg.points_in_regions(df, spark.createDataFrame(polygons, POLYGONS), carry=["cell", "x"]).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "n", 2), (1, 1, "n", 2), (1, 5, "n", 2)]
    assert found(spark, points[:1], []) == set() and found(spark, [], [(1, square)]) == set()
    with pytest.raises(Exception, match="wider than a circle"):
        found(spark, points[:1], [(1, [ring((0, -200), (0, 200), (5, 0))])])
