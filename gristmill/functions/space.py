"""Cells of space around the unit sphere, on levels, as Column expressions over unit vectors.

On level k the cube from -1 to 1 is cut into 2**k cells along each axis.  A cell's number holds its level and
three indices; the cell of a coarser level is found by shifting the indices.  Vectors are three columns whose
names begin alike and end in 0, 1 and 2.  Expressions are SQL texts, as each call from Python to the session costs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of an index, and levels between two that are used.
BITS, STEP = 19, 2
#: Slack in squared distances on the unit sphere, well above rounding: 6 m for points in one place, less farther off.
SLACK = 1e-12


def level_of(side: float) -> int:
    """The finest level in use whose cells are at least so wide (of radius 1), 18 at most."""
    return max(0, min(BITS - 1, math.floor(math.log2(2 / max(side, 1e-12))))) // STEP * STEP


def levels(finest: int) -> list[int]:
    return list(range(0, finest + 1, STEP))


def with_vector(df: DataFrame, lat: str, lng: str, v: str) -> DataFrame:
    """``df`` with the unit vector of each row as columns."""
    return df.selectExpr("*", f"cos(radians({lat})) * cos(radians({lng})) AS {v}0", f"cos(radians({lat})) * sin(radians({lng})) AS {v}1", f"sin(radians({lat})) AS {v}2")


def _index(x: str, level: str) -> str:
    return f"cast(least(greatest(floor(({x} + 1) * pow(2D, ({level}) - 1)), 0), pow(2D, {level}) - 1) as bigint)"


def _number(level: str, i: list[str]) -> str:
    wide = 1 << BITS
    return f"(((cast({level} as bigint) * {wide} + {i[0]}) * {wide} + {i[1]}) * {wide} + {i[2]})"


def cell_sql(v: str, level: str) -> str:
    """The cell of the vector ``v`` on a level."""
    return _number(level, [_index(f"{v}{k}", level) for k in range(3)])


def _index_of(cell: str, axis: int) -> str:
    return f"(shiftright({cell}, {(2 - axis) * BITS}) & {(1 << BITS) - 1})"


def ancestor_sql(cell: str, own: int, level: int) -> str:
    """The number of the cell's part of space on a coarser level."""
    return _number(str(level), [f"shiftright({_index_of(cell, k)}, {own - level})" for k in range(3)])


def _low(cell: str, level: str, axis: int) -> str:
    return f"({_index_of(cell, axis)} * pow(2D, 1 - ({level})) - 1)"


def near2_sql(v: str, cell: str, level: str) -> str:
    """Squared distance of a vector to a cell's box, 0 inside."""
    gaps = [f"greatest({_low(cell, level, k)} - {v}{k}, {v}{k} - {_low(cell, level, k)} - pow(2D, 1 - ({level})), 0D)" for k in range(3)]
    return "(" + " + ".join(f"{g} * {g}" for g in gaps) + ")"


def far2_sql(v: str, cell: str, level: str) -> str:
    """Squared distance of a vector to a cell's farthest corner."""
    gaps = [f"greatest({v}{k} - {_low(cell, level, k)}, {_low(cell, level, k)} + pow(2D, 1 - ({level})) - {v}{k})" for k in range(3)]
    return "(" + " + ".join(f"{g} * {g}" for g in gaps) + ")"


def _touches_sphere(cell: str, level: str) -> str:
    low = [_low(cell, level, k) for k in range(3)]
    side = f"pow(2D, 1 - ({level}))"
    inner = " + ".join(f"pow(greatest({x}, -{x} - {side}, 0D), 2)" for x in low)
    outer = " + ".join(f"pow(greatest(abs({x}), abs({x} + {side})), 2)" for x in low)
    return f"({inner}) <= 1.000000001D AND ({outer}) >= 0.999999999D"


def boxes_near(df: DataFrame, v: str, reach: str, most: int) -> DataFrame:
    """Each row (with a column ``level``) once for each cell of its level within ``reach``: adds cell, near2, far2.

    Only cells that touch the sphere count.  ``most`` is how many cells along an axis the reach may span.
    """
    out = df.selectExpr("*", f"{reach} AS __reach")
    for k in range(3):
        first, last = (_index(f"({v}{k} {sign} __reach {sign} 1e-9D)", "level") for sign in "-+")
        out = out.selectExpr("*", f"explode(sequence({first}, least({last}, {first} + {most}L))) AS __i{k}")
    out = out.selectExpr("*", f"{_number('level', [f'__i{k}' for k in range(3)])} AS cell").drop("__i0", "__i1", "__i2")
    out = out.where(_touches_sphere("cell", "level")).selectExpr("*", f"{near2_sql(v, 'cell', 'level')} AS near2").where(f"near2 <= __reach * __reach + {SLACK}D")
    return out.drop("__reach").selectExpr("*", f"{far2_sql(v, 'cell', 'level')} AS far2")


def children(df: DataFrame, v: str) -> DataFrame:
    """Each row (level, cell) once for each part of its cell on the next level in use that touches the sphere, with near2 and far2 of the part."""
    wide, part = 1 << STEP, (1 << STEP) - 1
    out = df.drop("n", "near2", "far2").withColumnRenamed("cell", "__cell").selectExpr("*", f"explode(sequence(0L, {wide**3 - 1}L)) AS __part")
    index = [f"({_index_of('__cell', k)} * {wide} + (shiftright(__part, {k * STEP}) & {part}))" for k in range(3)]
    out = out.withColumn("level", F.col("level") + STEP)
    out = out.selectExpr("*", f"{_number('level', index)} AS cell").drop("__cell", "__part").where(_touches_sphere("cell", "level"))
    return out.selectExpr("*", f"{near2_sql(v, 'cell', 'level')} AS near2", f"{far2_sql(v, 'cell', 'level')} AS far2")


def cells_on(v: str, on: list[int]) -> Column:
    """Array of the cells of a vector on some levels."""
    return F.expr("array(" + ", ".join(cell_sql(v, str(k)) for k in on) + ")")
