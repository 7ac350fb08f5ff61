import random

import pytest
from test_geo import km

from gristmill.operators.nearby import nearby_pairs

SCHEMA = "id bigint, lat double, lng double, name string, loaded_at int"


def brute(rows, r):
    pts = {}
    for i, a, b, _, t in sorted(rows, key=lambda x: x[4]):
        if a is not None and b is not None and -90 <= a <= 90 and -180 <= b <= 180 and i is not None:
            pts.setdefault(i, (a, b))
    ids = sorted(pts)
    return {(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if km(*pts[i], *pts[j]) <= r}


def pairs(df):
    got = [(r.id_a, r.id_b) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("r", [0.01, 0.5, 7.0])
def test_against_brute_force(spark, r):
    rng = random.Random(int(r * 100))
    deg = r / 111.2
    rows = []
    for lat, lng, n in ((50.0, 8.0, 300), (0.0, 180.0, 60), (0.0, -180.0, 60), (90.0, 0.0, 60), (-90.0, 0.0, 60), (89.9, 100.0, 50), (-60.0, -179.9999, 60)):
        for _ in range(n):
            a = min(90.0, max(-90.0, lat + rng.gauss(0, 2 * deg)))
            b = rng.uniform(-180, 180) if abs(lat) == 90 else lng + rng.gauss(0, 2 * deg)
            rows.append((len(rows), a, (b + 180) % 360 - 180, None, 0))
    rows += [(10_000 + i, 50.0, 8.0, "same", 0) for i in range(40)]
    assert pairs(nearby_pairs(spark.createDataFrame(rows, SCHEMA), r)) == brute(rows, r)


def test_bad_points_repeats_and_names(spark):
    nan = float("nan")
    rows = [(1, 10.0, 20.0, "a", 0), (2, 10.0, 20.0, None, 0), (3, nan, 20.0, "x", 0), (4, 10.0, None, "x", 0), (5, 91.0, 20.0, "x", 0), (None, 10.0, 20.0, "x", 0), (1, 10.0, 20.0, "a", 9), (2, 50.0, 50.0, "moved", 9), (6, 0.0, 180.0, "", 0), (7, 0.0, -180.0, "", 0), (8, 90.0, 1.0, "p", 0), (9, 90.0, -120.0, "q", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = nearby_pairs(df, 0.5, carry=["name"]).collect()
    assert {(r.id_a, r.name_a, r.id_b, r.name_b) for r in got} == {(1, "a", 2, None), (6, "", 7, ""), (8, "p", 9, "q")}
    assert all(r.distance_km < 1e-6 for r in got)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, "a", 0), (2, 1.0, 1.0, "b", 0)], SCHEMA)
    assert nearby_pairs(df.limit(0), 1).count() == 0
    odd = df.selectExpr("*", "1 as band", "2 as cell", "'v' as y", "'w' as x", "3 as n", "4 as part", "5 as carry", "6 as id_a")
    got = nearby_pairs(odd, 1, carry=["y", "band", "cell"]).collect()
    assert [(r.id_a, r.id_b, r.y_a, r.band_b, r.cell_a) for r in got] == [(1, 2, "v", 1, 2)]
    with pytest.raises(ValueError):
        nearby_pairs(df, 0)


def test_classes_of_equal_points(spark):
    from gristmill.operators.nearby import nearby_classes

    rows = [(i, 10.0, 20.0, "x", 0) for i in range(1, 400)] + [(500, 10.001, 20.0, None, 0), (501, 10.001, 20.0, None, 0), (600, -5.0, 3.0, "lone", 0), (700, None, 3.0, "", 0), (None, 1.0, 1.0, "", 0)]
    got = {r.id: (r.class_id, r.n_near) for r in nearby_classes(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as class_id", "2 as many", "3 as n_near"), 0.5).collect()}
    assert got == {**{i: (1, 400) for i in range(1, 400)}, 500: (500, 400), 501: (500, 400), 600: (600, 0)}
    assert nearby_classes(spark.createDataFrame([], SCHEMA), 0.5).count() == 0
