"""Points in regions, by an adaptive cover of each polygon with cells.

Degrees of longitude and latitude are a plane here, which is halved along both axes from level to level.  A
polygon is covered from coarse cells on: a cell that no edge touches is interior or outside as a whole; one
that an edge touches is cut into its parts, down to a depth that depends on the polygon's own size.  Points in
interior cells are in the region by an equi-join alone; points in boundary cells get the exact test, with
only those edges of the polygon that a ray from the cell can meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.geo import is_valid
from gristmill.session import materialize

#: Levels between two that are used, the deepest level, and how many steps below a polygon's own size its border is followed.
STEP, DEEPEST, STEPS = 2, 24, 3
#: Pairs of cells and edges looked at in one step.
PAIRS = 1 << 20
#: Slack in degrees within which an edge counts as touching a cell; cells that it touches get the exact test.
SLACK = 1e-9


def edges_of(rings: list[list[dict]]) -> np.ndarray:
    """Edges (lat, lng, lat, lng) of all rings, closed; rings of fewer than three points have none."""
    out = []
    for ring in rings:
        p = np.array([(v["lat"], v["lng"]) for v in ring], float).reshape(-1, 2)
        if len(p) >= 3:
            out.append(np.column_stack([p, np.roll(p, -1, axis=0)]))
    return np.concatenate(out) if out else np.zeros((0, 4))


def inside(edges: np.ndarray, lat: float, lng: float) -> bool:
    """Whether a point has an odd number of edges to its east."""
    a, b, c, d = edges.T
    cut = (a > lat) != (c > lat)
    a, b, c, d = a[cut], b[cut], c[cut], d[cut]
    return bool(((d - b) * (lat - a) / (c - a) + b > lng).sum() & 1)


def _touching(edges: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which edges (columns) may meet which boxes (rows): their own box does, and not all corners are on one side of their line."""
    a, b, c, d = edges.T
    (y0, x0), (y1, x1) = low.T[:, :, None], high.T[:, :, None]
    near = (np.minimum(a, c) <= y1 + SLACK) & (np.maximum(a, c) >= y0 - SLACK) & (np.minimum(b, d) <= x1 + SLACK) & (np.maximum(b, d) >= x0 - SLACK)
    slack = SLACK * (np.abs(c - a) + np.abs(d - b))
    above, below = np.ones(near.shape, bool), np.ones(near.shape, bool)
    for y in (y0, y1):
        for x in (x0, x1):
            side = (c - a) * (x - b) - (d - b) * (y - a)
            above &= side > slack
            below &= side < -slack
    return near & ~above & ~below


def _all_inside(edges: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The test of inside() for many points (lat, lng)."""
    a, b, c, d = edges.T
    y, x = at.T[:, :, None]
    cut = (a > y) != (c > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        east = (d - b) * (y - a) / (c - a) + b > x
    return ((cut & east).sum(axis=1) & 1).astype(bool)


def cover(edges: np.ndarray, steps: int = STEPS) -> Iterator[tuple[int, int, int, int, bool, np.ndarray]]:
    """Cells (level, row, column, turns, interior, edges for the exact test) of a polygon.

    ``turns`` says how often the cell's longitudes lie a full circle beyond the table's own; of interior cells
    no edges are given.
    """
    if not len(edges):
        return
    (y0, x0), (y1, x1) = edges[:, [0, 1]].min(axis=0), edges[:, [0, 1]].max(axis=0)
    if not (math.isfinite(y0 + y1 + x0 + x1) and -90 <= y0 and y1 <= 90 and x1 - x0 <= 360):
        raise ValueError("a polygon has coordinates that are missing, beyond a pole, or wider than a circle")
    own = math.floor(min(math.log2(360 / max(x1 - x0, 1e-6)), math.log2(180 / max(y1 - y0, 1e-6))))
    level = max(0, min(DEEPEST - STEP * steps, own)) // STEP * STEP
    last = level + STEP * steps

    h, w = 180 / (1 << level), 360 / (1 << level)
    rows = np.arange(max(0, math.floor((y0 + 90) / h)), min((1 << level) - 1, math.floor((y1 + 90) / h)) + 1)
    columns = np.arange(math.floor((x0 + 180) / w), math.floor((x1 + 180) / w) + 1)
    cells = np.stack(np.meshgrid(rows, columns, indexing="ij"), axis=-1).reshape(-1, 2)
    part = np.stack(np.meshgrid(np.arange(1 << STEP), np.arange(1 << STEP), indexing="ij"), axis=-1).reshape(-1, 2)
    width = max(1, PAIRS // len(edges))
    # All cells of a level at once, in slices of bounded size.
    while len(cells):
        finer = []
        side = np.array([180 / (1 << level), 360 / (1 << level)])
        for at in range(0, len(cells), width):
            own = cells[at : at + width]
            low = own * side - np.array([90.0, 180.0])
            high = low + side
            touched = _touching(edges, low, high).any(axis=1)
            free = np.flatnonzero(~touched)
            for k in free[_all_inside(edges, (low[free] + high[free]) / 2)].tolist():
                turns, column = divmod(int(own[k, 1]), 1 << level)
                yield level, int(own[k, 0]), column, turns, True, edges[:0]
            border = np.flatnonzero(touched)
            if level < last:
                finer.append(((own[border] << STEP)[:, None, :] + part).reshape(-1, 2))
                continue
            # A ray to the east from within a cell meets no edge that is above, below or west of it.
            a, b, c, d = edges.T
            lo, hi = low[border], high[border]
            ray = (np.minimum(a, c) <= hi[:, :1] + SLACK) & (np.maximum(a, c) >= lo[:, :1] - SLACK) & (np.maximum(b, d) >= lo[:, 1:] - SLACK)
            for k, met in zip(border.tolist(), ray):
                turns, column = divmod(int(own[k, 1]), 1 << level)
                yield level, int(own[k, 0]), column, turns, False, edges[met]
        if level == last:
            return
        cells, level = np.concatenate(finer), level + STEP


def _cell(level: Column, row: Column, column: Column) -> Column:
    return (level.cast("long") * (1 << 28) + row) * (1 << 28) + column


def covers(polygons: DataFrame, region: str = "region", rings: str = "rings", steps: int = STEPS) -> DataFrame:
    """(region, level, cell, turns, interior, edges) of all polygons; ``edges`` is an array of (lat, lng, lat, lng), one number after the other."""
    kind = polygons.schema[region].dataType.simpleString()
    names = ["region", "level", "row", "column", "turns", "interior", "edges"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, shape in enumerate(batch.column(1).to_pylist()):
                found = list(cover(edges_of([r for r in shape or [] if r]), steps))
                for lo in range(0, len(found), 1000):
                    part = found[lo : lo + 1000]
                    cols = [pa.array([f[c] for f in part], t) for c, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(part)), *cols, pa.array([f[5].ravel().tolist() for f in part], pa.list_(pa.float64()))], names=names)

    schema = f"region {kind}, level int, row bigint, column bigint, turns int, interior boolean, edges array<double>"
    made = polygons.where(F.col(f"`{region}`").isNotNull()).select(F.col(f"`{region}`").alias("region"), F.col(f"`{rings}`").alias("rings"))
    # Polygons are few bytes and much work: they are spread by number, whatever their size.
    spread = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = made.repartition(spread).mapInArrow(run, schema)
    return made.select("region", "level", _cell(F.col("level"), F.col("row"), F.col("column")).alias("cell"), "turns", "interior", "edges")


def _contains() -> Column:
    """The exact test of (y, x) with the cell's edges: an odd number of them to the east."""
    n = F.size("edges") / 4
    at = lambda k, i: F.element_at("edges", (k * 4 + i + 1).cast("int"))
    x = F.col("x") + F.col("turns") * 360.0

    def crossed(k: Column) -> Column:
        a, b, c, d = (at(k, i) for i in range(4))
        cut = (a > F.col("y")) != (c > F.col("y"))
        return F.when(cut, ((d - b) * (F.col("y") - a) / (c - a) + b > x).cast("int")).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(0), (n - 1).cast("int")), F.lit(0), lambda s, k: s + crossed(k))
    return F.when(n == 0, F.lit(False)).otherwise(F.pmod(total, F.lit(2)) == 1)


def points_in_regions(points: DataFrame, polygons: DataFrame, id_col: str = "id", lat: str = "lat", lng: str = "lng", region: str = "region", rings: str = "rings", carry: list[str] | None = None, steps: int = STEPS) -> DataFrame:
    """(region, id, carried columns ...): each row of points once for each polygon that contains it.

    A polygon is ``rings``, arrays of (lat, lng) whose edges are straight in degrees; a point is in it if an
    odd number of edges lie east of it, so an inner ring is a hole, a point on a western or southern border
    is inside and one on an eastern or northern border isn't.  A polygon across the date line has
    longitudes beyond 180 (or below -180); one around a pole runs along latitude 90 or -90 for 360 degrees.  Null,
    empty and two-point rings contain nothing; polygons wider than a circle are refused.  Points without valid
    coordinates or id take no part; repeated rows come out as often as they are there; an empty table
    gives an empty table.  Only the levels in use reach the driver.
    """
    carry = carry or []
    cells = materialize(covers(polygons, region, rings, steps), "cover")
    used = sorted(r[0] for r in cells.select("level").distinct().collect())
    y, x = F.col(f"`{lat}`"), F.col(f"`{lng}`")
    own = points.where(is_valid(y, x) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), y.alias("y"), x.alias("x"), *(F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(carry)))

    def at(level: int) -> Column:
        many = 1 << level
        row = F.least(F.floor((F.col("y") + 90) / (180 / many)), F.lit(many - 1))
        column = F.pmod(F.floor((F.col("x") + 180) / (360 / many)), F.lit(many))
        return _cell(F.lit(level), row, column)

    if not used:
        own, used = own.limit(0), [0]
    located = own.withColumn("cell", F.explode(F.array(*map(at, used))))
    hit = located.join(cells.drop("level"), "cell").where(F.col("interior") | _contains())
    return hit.select("region", "id", *(F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)))
