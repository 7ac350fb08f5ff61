"""Radius and nearest-neighbour joins of query points with points."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import space
from gristmill.functions.geo import EARTH_KM, chord, haversine_km, is_valid
from gristmill.operators.nearby import Grid
from gristmill.session import materialize

#: Radius from which bands of latitude have too few cells to be of use; beyond it, cells of space of this level are taken.
WIDE_KM, WIDE_LEVEL = 2500.0, 4
#: Points or queries of one cell in a part; queries of a slice when all meet all; points from which a cell is looked at in parts.
PART, SLICE, CROWDED = 50_000, 50_000, 4_096
HALF_ROUND_KM = math.pi * EARTH_KM


class GeoIndex(Protocol):
    """What an index of points answers."""

    def insert(self, points: DataFrame) -> None: ...

    def find_nearest(self, queries: DataFrame) -> DataFrame: ...

    def find_in_radius(self, queries: DataFrame, km: float) -> DataFrame: ...

    def size(self) -> int: ...


def check_points(df: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """``df``; reading it fails at a row whose coordinates are missing, NaN or out of range."""
    shown = F.concat(F.lit("invalid coordinates: "), F.coalesce(F.col(lat).cast("string"), F.lit("null")), F.lit(", "), F.coalesce(F.col(lng).cast("string"), F.lit("null")))
    return df.withColumn(lat, F.when(is_valid(F.col(lat), F.col(lng)), F.col(lat)).otherwise(F.raise_error(shown).cast("double")))


def valid_points(df: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Only the rows with valid coordinates."""
    return df.where(is_valid(F.col(lat), F.col(lng)))


def shown(name: Column, lat: Column, lng: Column) -> Column:
    """``name(lat, lng)``."""
    return F.concat(F.coalesce(name, F.lit("null")), F.lit("("), lat.cast("string"), F.lit(", "), lng.cast("string"), F.lit(")"))


def _sides(points: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = valid_points(points).select("id", F.col("lat").alias("y"), F.col("lng").alias("x"))
    q = valid_points(queries).select("qid", F.col("lat").alias("qy"), F.col("lng").alias("qx"))
    return p, q


def _distance() -> Column:
    return haversine_km(F.col("qy"), F.col("qx"), F.col("y"), F.col("x"))


def _split_join(reach: DataFrame, own: DataFrame) -> DataFrame:
    """Joins queries' cells with points' cells (column ``cell``), crowded cells in parts.

    A cell with more than ``PART`` points or queries is cut into parts of about so many, by hash; every part of
    its points meets every part of its queries in a task of its own.  Tables that are no larger as a whole have no such cell.
    """
    sizes = own.select(F.lit(1).alias("own"), F.lit(0).alias("reach")).unionAll(reach.select(F.lit(0), F.lit(1))).agg(F.sum("own"), F.sum("reach")).first()
    if max(n or 0 for n in sizes) <= PART:
        return reach.join(own, "cell")

    def crowded(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("cell", F.ceil(F.col("n") / PART).alias(name))

    many = crowded(own, "ps").join(crowded(reach, "qs"), "cell", "full").select("cell", F.coalesce("ps", F.lit(1)).alias("ps"), F.coalesce("qs", F.lit(1)).alias("qs"))

    def parts(side: DataFrame, by: Column, mine: str, other: str, mine_first: bool) -> DataFrame:
        own_part = F.pmod(by, F.coalesce(F.col(mine), F.lit(1)))
        theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(other), F.lit(1)) - 1))
        cut = side.join(many, "cell", "left").withColumn("i" if mine_first else "j", own_part).withColumn("j" if mine_first else "i", theirs)
        return cut.drop("ps", "qs")

    return parts(reach, F.xxhash64("qid", "qy", "qx"), "qs", "ps", True).join(parts(own, F.xxhash64("id", "y", "x"), "ps", "qs", False), ["cell", "i", "j"]).drop("i", "j")


def radius_join(points: DataFrame, queries: DataFrame, km: float) -> DataFrame:
    """(qid, id, distance_km): all points (id, lat, lng) at most ``km``, inclusive, from each query (qid, lat, lng).

    Points and queries without valid coordinates take no part; a NaN or negative radius finds nothing,
    one of half the circumference or more finds all; radius 0 finds equal points.  The queries' discs are
    covered with cells, which are joined with the points' cells by equality: cells of latitude bands up to
    ``WIDE_KM``, cells of space beyond it, of which those fully inside the disc need no test.  The final test
    is the haversine distance.  Repeated ids come out as often as they are there.
    """
    p, q = _sides(points, queries)
    if math.isnan(km) or km < 0:
        return p.limit(0).join(q.limit(0), F.lit(True)).select("qid", "id", _distance().alias("distance_km"))
    if km > WIDE_KM:
        limit = 4.0 if km >= HALF_ROUND_KM else chord(km) ** 2
        asked = space.with_vector(q, "qy", "qx", "v").withColumn("level", F.lit(WIDE_LEVEL))
        reach = space.boxes_near(asked, "v", f"{math.sqrt(limit)!r}D", 1 << WIDE_LEVEL).select("qid", "qy", "qx", "cell", (F.lit(km >= HALF_ROUND_KM) | (F.col("far2") <= limit - space.SLACK)).alias("inside"))
        own = space.with_vector(p, "y", "x", "u").selectExpr("id", "y", "x", f"{space.cell_sql('u', str(WIDE_LEVEL))} AS cell")
        return _split_join(reach, own).select("qid", "id", "inside", _distance().alias("distance_km")).where(F.col("inside") | (F.col("distance_km") <= km)).drop("inside")
    grid = Grid(max(km, 0.01))
    cell = F.shiftleft(F.col("band"), 32).bitwiseOR(F.col("cell")).alias("cell")
    reach = grid.cover(q, "qy", "qx").select("qid", "qy", "qx", cell)
    own = grid.locate(p, "y", "x").select("id", "y", "x", cell)
    return _split_join(reach, own).select("qid", "id", _distance().alias("distance_km")).where(F.col("distance_km") <= km)


def radius_join_plain(points: DataFrame, queries: DataFrame, km: float) -> DataFrame:
    """radius_join without cells, every query with every point; what the pruned join must equal.

    Queries go to the tasks in slices of about ``SLICE``, each of which meets all points: pairs are ruled out by the
    dot products of their unit vectors, as a product of matrices, with some slack; what is left gets
    the haversine test.
    """
    p, q = _sides(points, queries)
    slices = -(-q.count() // SLICE)
    if not slices or math.isnan(km) or km < 0:
        return p.limit(0).join(q.limit(0), F.lit(True)).select("qid", "id", _distance().alias("distance_km"))
    least = -2.0 if km >= HALF_ROUND_KM else math.cos(km / EARTH_KM) - 1e-12
    kind = {n: side.schema[n].dataType.simpleString() for side, n in ((p, "id"), (q, "qid"))}
    found = None
    for k in range(slices):
        part = q if slices == 1 else q.where(F.pmod(F.xxhash64("qid", "qy", "qx"), F.lit(slices)) == k)
        asked = p.sparkSession.sparkContext.broadcast(pa.Table.from_pandas(part.select("qid", "qy", "qx").toPandas(), preserve_index=False))

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            table = asked.value
            there = _unit(table.column("qy").to_numpy(), table.column("qx").to_numpy()).T
            for batch in batches:
                here = _unit(batch.column(1).to_numpy(), batch.column(2).to_numpy())
                for lo in range(0, table.num_rows, 1024):
                    i, j = np.nonzero(here @ there[:, lo : lo + 1024] >= least)
                    if len(i):
                        hit = table.take(pa.array(lo + j)).combine_chunks()
                        own = batch.take(pa.array(i))
                        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in hit.columns), *own.columns], names=["qid", "qy", "qx", "id", "y", "x"])

        near = p.mapInArrow(run, f"qid {kind['qid']}, qy double, qx double, id {kind['id']}, y double, x double")
        found = near if found is None else found.unionByName(near)
    return found.select("qid", "id", _distance().alias("distance_km")).where(F.lit(km >= HALF_ROUND_KM) | (F.col("distance_km") <= km))


def _unit(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lng)
    return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def nearest_join(points: DataFrame, queries: DataFrame, finest_km: float | None = None) -> DataFrame:
    """(qid, id, distance_km): the nearest point of each query, of several the one with the smallest id.

    Space is cut into cells on levels, each with a quarter of the side of the one above.  Points are counted by
    cell and level.  A query starts at the finest level on which its own cell holds a point: that cell's
    farthest corner bounds the distance.  Of the cells around it on that level, those that hold points and
    whose box is within the bound are kept; the nearest farthest corner among them lowers the bound.
    Kept cells with many points are replaced by their parts on the next level, in rounds, until none is left
    or the finest level (cells of ``finest_km``) is reached; then the points of the kept cells are compared.
    Dense towns and lone points so cost the same few comparisons, and there is no round that meets all points.
    Each qid should come once.  Without points no query has a row.  Only the levels in use reach the driver.
    """
    p, q = _sides(points, queries)
    p, q = space.with_vector(p, "y", "x", "u"), space.with_vector(q, "qy", "qx", "v")
    finest = space.level_of((finest_km or 0.05) / EARTH_KM)
    levels = space.levels(finest)
    base = p.selectExpr(f"{space.cell_sql('u', str(finest))} AS cell").groupBy("cell").agg(F.count("*").alias("n"))
    coarser = ", ".join(space.ancestor_sql("cell", finest, k) for k in levels)
    counts = materialize(base.selectExpr(f"explode(array({coarser})) AS cell", "n").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    # Each query's own cells; the number of a cell begins with its level, so the largest one found is the finest.
    own = q.select("qid", "qy", "qx", "v0", "v1", "v2", F.explode(space.cells_on("v", levels)).alias("own"))
    start = own.join(counts.select(F.col("cell").alias("own")), "own", "left_semi").groupBy("qid", "qy", "qx", "v0", "v1", "v2").agg(F.max("own").alias("own"))
    start = start.selectExpr("*", f"cast(shiftright(own, {3 * space.BITS}) as int) AS level")
    start = start.selectExpr("*", f"sqrt({space.far2_sql('v', 'own', 'level')}) AS bound").drop("own")
    # The bound is at most the cell's diagonal: two cells on either side of the own one.
    around = space.boxes_near(start, "v", "bound", 5)
    columns = ["qid", "qy", "qx", "v0", "v1", "v2", "level", "cell", "n", "near2", "far2"]

    def kept(near: DataFrame) -> DataFrame:
        least = F.min("far2").over(Window.partitionBy("qid"))
        return materialize(near.select(*columns, least.alias("least")).where(F.col("near2") <= F.col("least") + space.SLACK).drop("least"), "reach")

    reach = kept(around.join(counts, "cell"))
    crowded = (F.col("n") > CROWDED) & (F.col("level") < finest)
    while True:
        used = reach.groupBy("level").agg(F.max(crowded.cast("int")).alias("crowded")).collect()
        if not any(r.crowded for r in used):
            break
        reach = kept(reach.where(~crowded).unionByName(space.children(reach.where(crowded), "v").join(counts, "cell").select(*columns)))
    if not used:
        return p.limit(0).join(q.limit(0), F.lit(True)).select("qid", "id", _distance().alias("distance_km"))
    located = p.select("id", "y", "x", F.explode(space.cells_on("u", sorted(r.level for r in used))).alias("cell"))
    pairs = reach.select("qid", "qy", "qx", "cell").join(located, "cell").select("qid", "id", _distance().alias("distance_km"))
    best = pairs.groupBy("qid").agg(F.min(F.struct("distance_km", "id")).alias("x"))
    return best.select("qid", "x.id", "x.distance_km")


class PointTable:
    """Points that can be added to, with the look-ups of an index."""

    def __init__(self, points: DataFrame):
        self.points = points.select("id", "lat", "lng")

    def insert(self, points: DataFrame) -> None:
        self.points = self.points.unionByName(points.select("id", "lat", "lng"))

    def find_nearest(self, queries: DataFrame) -> DataFrame:
        return nearest_join(self.points, queries)

    def find_in_radius(self, queries: DataFrame, km: float) -> DataFrame:
        return radius_join(self.points, queries, km)

    def size(self) -> int:
        return self.points.count()
