"""Points near other points, by an adaptive cover of each point's surroundings with cells.

The sphere is cut into bands of latitude, each band into cells of equal width.  The disc around a point
is covered by cells.  Cells with few points are taken as they are.  A crowded cell is split further, and
of its parts those fully inside the disc are told from those that the disc's edge may cross: points in
interior parts are near by an equi-join alone, points in boundary cells get the exact test.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.geo import EARTH_KM, haversine_km, is_valid
from gristmill.session import materialize

#: Side of a cell in radii; parts of a crowded cell along each side; points from which a cell is crowded.
CELL_RADII, PARTS, CROWDED = 2.0, 8, 32
#: Slack of the cover in km, well above rounding; the exact test has none.
SLACK_KM = 1e-6


class Grid:
    """Bands and cells for discs of one radius."""

    def __init__(self, radius_km: float):
        self.radius = radius_km
        self.height = math.degrees(CELL_RADII * radius_km / EARTH_KM)
        if not 1e-7 <= self.height <= 45:
            raise ValueError("the radius is out of the grid's range")
        self.bands = math.ceil(180 / self.height)

    def band(self, lat: Column) -> Column:
        return F.least(F.floor((lat + 90) / self.height), F.lit(self.bands - 1)).cast("long")

    def cells(self, band: Column) -> Column:
        """Cells of a band: as many as fit at its narrow edge, one at the poles."""
        low = band * self.height - 90
        edge = F.least(F.greatest(F.abs(low), F.abs(low + self.height)), F.lit(90.0))
        return F.greatest(F.floor(360 * F.cos(F.radians(edge)) / self.height), F.lit(1)).cast("long")

    def cover(self, df: DataFrame, lat: str, lng: str) -> DataFrame:
        """Each row once for each cell, (band, cell, n), that its disc may touch."""
        reach = math.degrees((self.radius + SLACK_KM) / EARTH_KM)
        p, q = F.col(lat), F.col(lng)
        first, last = F.greatest(F.floor((p + 90 - reach) / self.height), F.lit(0)), F.least(F.floor((p + 90 + reach) / self.height), F.lit(self.bands - 1))
        out = df.withColumn("band", F.explode(F.sequence(first.cast("long"), F.greatest(first, last).cast("long")))).withColumn("n", self.cells(F.col("band")))
        # Half the width of the disc in degrees of longitude; with a pole inside it is all around.
        ratio = math.sin(math.radians(reach)) / F.cos(F.radians(p))
        half = F.when(F.abs(p) + reach < 90, F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9).otherwise(180.0)
        width = 360 / F.col("n")
        c0, c1 = F.floor((q + 180 - half) / width).cast("long"), F.floor((q + 180 + half) / width).cast("long")
        around = c1 - c0 + 1 >= F.col("n")
        cells = F.when(around, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.transform(F.sequence(c0, c1), lambda c: F.pmod(c, F.col("n"))))
        return out.withColumn("cell", F.explode(cells))

    def locate(self, df: DataFrame, lat: str, lng: str) -> DataFrame:
        """Adds the row's own band and cell, and its part of the cell, should that be crowded."""
        p, q = F.col(lat), F.col(lng)
        out = df.withColumn("band", self.band(p)).withColumn("n", self.cells(F.col("band")))
        turn = (q + 180) / (360 / F.col("n"))
        out = out.withColumn("cell", F.pmod(F.floor(turn).cast("long"), F.col("n")))
        i = F.least(F.greatest(F.floor(((p + 90) / self.height - F.col("band")) * PARTS), F.lit(0)), F.lit(PARTS - 1))
        j = F.least(F.greatest(F.floor((turn - F.floor(turn)) * PARTS), F.lit(0)), F.lit(PARTS - 1))
        return out.withColumn("part", (i * PARTS + j).cast("int"))

    def parts(self, lat: str, lng: str) -> Column:
        """Array of (part, interior) of the parts of a crowded cell that the row's disc may touch."""
        band, cell, n = F.col("band"), F.col("cell"), F.col("n")

        def one(k: Column) -> Column:
            i, j = F.floor(k / PARTS), F.pmod(k, F.lit(PARTS))
            clat = (band + (i + 0.5) / PARTS) * self.height - 90
            clng = (cell + (j + 0.5) / PARTS) * (360 / n) - 180
            far = F.greatest(F.abs(clat) - self.height / PARTS / 2, F.lit(0.0))
            # From the middle to any point of the part: along the meridian, then along the parallel.
            size = EARTH_KM * (math.radians(self.height) / PARTS / 2 + F.cos(F.radians(far)) * F.radians(360 / n) / PARTS / 2) + SLACK_KM
            return F.struct(k.cast("int").alias("part"), haversine_km(F.col(lat), F.col(lng), clat, clng).alias("d"), size.alias("s"))

        every = F.transform(F.sequence(F.lit(0), F.lit(PARTS * PARTS - 1)), one)
        touched = F.filter(every, lambda x: x["d"] - x["s"] <= self.radius + SLACK_KM)
        return F.transform(touched, lambda x: F.struct(x["part"].alias("part"), (x["d"] + x["s"] <= self.radius - SLACK_KM).alias("interior")))


def first_of_each(points: DataFrame, order: str | None) -> DataFrame:
    """One row (id, y, x, carry) for each id: the first by ``order``, of equal ones the smallest."""
    first = F.min(F.struct(*([order] if order else []), "y", "x", "carry")).alias("__x")
    return points.groupBy("id").agg(first).select("id", "__x.y", "__x.x", "__x.carry")


def nearby_pairs(df: DataFrame, radius_km: float, id_col: str = "id", lat: str = "lat", lng: str = "lng", carry: list[str] | None = None, order: str | None = "loaded_at") -> DataFrame:
    """(id_a, id_b, distance_km), id_a < id_b, of different ids at most ``radius_km`` apart by haversine.

    With ``carry``, those columns of both points come out as name_a, name_b and so on.  An id that
    comes more than once counts once, by its first row in ``order``.  Null ids and points with null,
    NaN or out-of-range coordinates take no part; equal points are at distance 0; longitudes -180
    and 180 are one, and so are all longitudes at a pole.  Names may be null or repeated.  An empty table
    gives an empty table.  A radius that isn't above 0 is refused.
    """
    grid = Grid(radius_km)
    carry = carry or []
    y, x = F.col(f"`{lat}`"), F.col(f"`{lng}`")
    good = df.where(is_valid(y, x) & F.col(f"`{id_col}`").isNotNull())
    extra = F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)))
    named = good.select(F.col(f"`{id_col}`").alias("id"), *([F.col(f"`{order}`").alias("__order")] if order else []), y.alias("y"), x.alias("x"), extra.alias("carry"))
    points = first_of_each(named, "__order" if order else None)
    own = grid.locate(points, "y", "x")
    crowded = own.groupBy("band", "cell").agg(F.count("*").alias("many")).where(F.col("many") > CROWDED).select("band", "cell", F.lit(True).alias("crowded"))
    target = own.join(crowded, ["band", "cell"], "left").withColumn("part", F.when(F.col("crowded"), F.col("part")).otherwise(-1))
    reach = grid.cover(points, "y", "x").join(crowded, ["band", "cell"], "left")
    parts = F.when(F.col("crowded"), grid.parts("y", "x")).otherwise(F.array(F.struct(F.lit(-1).alias("part"), F.lit(False).alias("interior"))))
    reach = reach.withColumn("p", F.explode(parts)).select("id", "y", "x", "band", "cell", "p.part", "p.interior", *(["carry"] if carry else []))
    a, b = reach.alias("a"), target.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.part") == F.col("b.part"))
    distance = haversine_km(F.col("a.y"), F.col("a.x"), F.col("b.y"), F.col("b.x"))
    near = a.join(b, same & (F.col("a.id") < F.col("b.id")) & (F.col("a.interior") | (distance <= radius_km)))
    names = [F.col(f"{s}.carry.c{k}").alias(f"{c}_{s}") for s in "ab" for k, c in enumerate(carry)]
    return near.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), distance.alias("distance_km"), *names)


def nearby_classes(df: DataFrame, radius_km: float, id_col: str = "id", lat: str = "lat", lng: str = "lng", order: str | None = "loaded_at") -> DataFrame:
    """(id, class_id, n_near) of each id with valid coordinates: the ids at its very coordinates, by the smallest, and how many other ids are near.

    Equal points stand as one, with their number, before any pairing: a place that a third of all rows share is
    one point, and its rows never form pairs.  Otherwise as nearby_pairs.
    """
    y, x = F.col(f"`{lat}`"), F.col(f"`{lng}`")
    good = df.where(is_valid(y, x) & F.col(f"`{id_col}`").isNotNull())
    named = good.select(F.col(f"`{id_col}`").alias("id"), *([F.col(f"`{order}`").alias("__order")] if order else []), y.alias("y"), x.alias("x"), F.lit(0).alias("carry"))
    points = materialize(first_of_each(named, "__order" if order else None).select("id", "y", "x"), "points")
    places = points.groupBy("y", "x").agg(F.min("id").alias("class_id"), F.count("*").alias("many"))
    pairs = nearby_pairs(places.withColumnRenamed("class_id", "id").withColumnRenamed("y", "lat").withColumnRenamed("x", "lng"), radius_km, carry=["many"], order=None)
    ends = pairs.select(F.col("id_a").alias("class_id"), F.col("many_b").alias("n")).unionByName(pairs.select(F.col("id_b").alias("class_id"), F.col("many_a").alias("n")))
    near = places.join(ends.groupBy("class_id").agg(F.sum("n").alias("n")), "class_id", "left").select("y", "x", "class_id", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_near"))
    return points.join(near, ["y", "x"]).select("id", "class_id", "n_near")
