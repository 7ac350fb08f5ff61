import math
import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import geo as fn
from gristmill.operators import geo
from gristmill.plans.reference import CITIES, geo_random_radius
from gristmill.sources.points import random_points


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1, x)))


EDGE = [(90.0, 0.0), (90.0, 77.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -180.0), (0.001, 179.999), (10.0, 20.0), (10.0, 20.0), (89.99, 10), (89.99, -170)]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(7)
    rows = EDGE + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(600)]
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "id bigint, lat double, lng double"), rows


@pytest.mark.parametrize("r", [0, 1e-9, 5, 100, 500, 2000, 5000, 20100, -1, float("nan")])
def test_radius_against_brute_force(spark, points, r):
    df, rows = points
    q = df.where("id < 40").withColumnRenamed("id", "qid")
    got = sorted((x.qid, x.id) for x in geo.radius_join(df, q, r).collect())
    want = sorted((i, j) for i in range(40) for j in range(len(rows)) if r >= math.pi * 6371 or km(*rows[i], *rows[j]) <= r)
    assert got == want
    assert sorted((x.qid, x.id) for x in geo.radius_join_plain(df, q, r).collect()) == want


def test_nearest_against_brute_force(spark, points):
    df, rows = points
    q = df.where("id % 5 = 0").select(F.col("id").alias("qid"), (F.col("lat") * 0.95).alias("lat"), (F.col("lng") * 0.95).alias("lng"))
    for start in (None, 0.1, 1e5):
        got = {x.qid: x.id for x in geo.nearest_join(df, q, start).collect()}
        for x in q.collect():
            assert got[x.qid] == min(range(len(rows)), key=lambda j: (round(km(x.lat, x.lng, *rows[j]), 9), j))


def test_ties_duplicates_and_empty(spark):
    p = spark.createDataFrame([(5, 1.0, 1.0), (3, 1.0, 1.0), (4, 1.0, -1.0)], "id bigint, lat double, lng double")
    q = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 0.0)], "qid bigint, lat double, lng double")
    assert {x.qid: x.id for x in geo.nearest_join(p, q).collect()} == {0: 3, 1: 3}
    assert geo.nearest_join(p.limit(0), q).count() == geo.nearest_join(p, q.limit(0)).count() == 0
    assert geo.radius_join(p.limit(0), q, 10).count() == 0


def test_cities(spark):
    cities = spark.createDataFrame(CITIES, "id bigint, lat double, lng double, name string")
    t = geo.PointTable(cities.where("id <> 7"))
    t.insert(cities.where("id = 7"))
    assert t.size() == 9
    q = spark.createDataFrame([(0, 55.76, 37.62)], "qid bigint, lat double, lng double")
    assert [(x.id, round(x.distance_km, 4)) for x in t.find_nearest(q).collect()] == [(0, 0.4966)]
    assert {x.id for x in t.find_in_radius(q, 50).collect()} == {0, 7}
    assert {x.id for x in t.find_in_radius(q, 800).collect()} == {0, 1, 7, 8}
    d = cities.where("id = 0").crossJoin(cities.where("id = 1").select(F.col("lat").alias("a"), F.col("lng").alias("b"), "name").withColumnRenamed("name", "n")).select(fn.haversine_km(F.col("lat"), F.col("lng"), F.col("a"), F.col("b"))).first()[0]
    assert round(d, 4) == 633.0202


def test_random_points_of_the_benchmark(spark):
    assert geo_random_radius(spark, "").count() == 168
    p = random_points(spark, 1000)
    q = random_points(spark, 1000, skip=1000).select(F.col("id").alias("qid"), "lat", "lng")
    assert round(geo.nearest_join(p, q).agg(F.avg("distance_km")).first()[0], 4) == 331.8723


def test_validation(spark):
    bad = spark.createDataFrame([(1, 90.0001, 0.0), (2, float("nan"), 0.0), (3, None, 0.0), (4, 0.0, 180.1)], "id bigint, lat double, lng double")
    assert geo.valid_points(bad).count() == 0
    with pytest.raises(Exception, match="invalid coordinates"):
        geo.check_points(bad).collect()
    ok = spark.createDataFrame([(1, -90.0, 180.0, "x")], "id bigint, lat double, lng double, name string")
    assert geo.check_points(ok).select(geo.shown(F.col("name"), F.col("lat"), F.col("lng"))).first()[0] == "x(-90.0, 180.0)"


def test_chord_and_box(spark):
    row = spark.range(1).select(
        fn.squared_distance(fn.unit_xyz(F.lit(0.0), F.lit(0.0)), fn.unit_xyz(F.lit(0.0), F.lit(180.0))).alias("far"),
        fn.squared_distance_to_box((F.lit(2.0), F.lit(0.5), F.lit(-1.0)), (F.lit(0.0),) * 3, (F.lit(1.0),) * 3).alias("box"),
        fn.squared_chord(F.lit(100.0)).alias("chord2"),
        fn.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"),
    ).first()
    assert round(row.far, 9) == 4 and row.box == 2 and math.isclose(row.chord2, fn.chord(100) ** 2) and math.isclose(row.half, math.pi * 6371)


def test_crowded_cells_are_met_in_parts(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, 50 + rng.gauss(0, 0.01), 8 + rng.gauss(0, 0.01)) for i in range(400)] + [(400 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, lat double, lng double")
    q = df.where("id % 3 = 0").withColumnRenamed("id", "qid")
    want = {r: sorted((i, j) for i in range(0, 450, 3) for j in range(450) if km(*rows[i][1:], *rows[j][1:]) <= r) for r in (1.0, 3000.0)}
    away = df.where("id % 5 = 0").select(F.col("id").alias("qid"), (F.col("lat") + 0.03).alias("lat"), "lng").where("lat <= 90")
    near = {x.qid: min(range(450), key=lambda j: (km(x.lat, x.lng, *rows[j][1:]), j)) for x in away.collect()}
    monkeypatch.setattr(geo, "PART", 30)
    monkeypatch.setattr(geo, "CROWDED", 5)
    monkeypatch.setattr(geo, "SLICE", 40)
    for r in want:
        assert sorted((x.qid, x.id) for x in geo.radius_join(df, q, r).collect()) == want[r]
    assert sorted((x.qid, x.id) for x in geo.radius_join_plain(df, q, 1.0).collect()) == want[1.0]
    assert {x.qid: x.id for x in geo.nearest_join(df, away).collect()} == near
