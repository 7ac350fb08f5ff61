"""Filling containers of fixed capacity with items, by hierarchical packing of residuals.

Tasks pack their own items by best fit, largest first, and emit the nearly full containers.  All other containers
are opened again: their items go on as residual items, which groups of tasks pack together, emit what is
nearly full, and hand the rest on in turn, until one group is left.  So it doesn't matter which sizes came
together in a task.

A residual item goes on as a number only: its size and its rank among those of its task and size.  A group sees
how many items of each size each of its members hands on, at most one row for each size, packs equal items
many at a time, and says for ranges of ranks which container and place they get.  The items themselves are
joined with these ranges once, at the end.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import materialize

#: A container is nearly full, and emitted, if at most this share of it is free.
NEARLY_FULL = 1 / 64
#: Members of a group in each round.
FAN_IN = 8
#: Sizes told apart; in larger capacities sizes are rounded up to as many classes.
CLASSES = 1 << 16
MAX_PLANS = 10_000
#: Numbers of containers: round, group, and place within the group's own.
_ROUND, _GROUP = 1 << 56, 1 << 32


@dataclass
class Bins:
    """``many`` containers alike: of each size, ``each`` items, those of ranks from ``first`` on, one container after the other."""

    room: int
    many: int
    parts: tuple[tuple[int, int, int], ...]  # (size, each, first)

    def split(self, n: int) -> tuple[Bins, Bins]:
        """The first ``n`` of them and the rest."""
        rest = tuple((size, each, first + n * each) for size, each, first in self.parts)
        return Bins(self.room, n, self.parts), Bins(self.room, self.many - n, rest)


def best_fit(sizes: list[int], counts: list[int], capacity: int) -> list[Bins]:
    """Best fit, largest first, of ``counts`` items of each of the sizes; equal items are placed many at a time.

    An item goes where it leaves the least room, so a container that takes one of a size takes as many of it as
    fit before the next container gets any.  Items of size 0 go into the fullest container.
    """
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def push(bins: Bins) -> None:
        if bins.many:
            if bins.room not in by_room:
                insort(rooms, bins.room)
            by_room.setdefault(bins.room, []).append(bins)

    for size, n in sorted(zip(sizes, counts), reverse=True):
        first = 0
        if size == 0:
            if n:
                bins = by_room[rooms[0]].pop() if rooms else Bins(capacity, 1, ())
                if rooms and not by_room[rooms[0]]:
                    del by_room[rooms[0]], rooms[0]
                one, rest = bins.split(1)
                push(rest)
                push(Bins(one.room, 1, (*one.parts, (0, n, 0))))
            continue
        while n:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                bins = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[k]
            else:
                bins = Bins(capacity, -(-n // (capacity // size)), ())
            each = bins.room // size
            full, rest = bins.split(min(bins.many, n // each))
            push(Bins(full.room - each * size, full.many, (*full.parts, (size, each, first))))
            first, n = first + full.many * each, n - full.many * each
            if rest.many and n:
                last, rest = rest.split(1)
                push(Bins(last.room - n * size, 1, (*last.parts, (size, n, first))))
                n = 0
            if rest.parts:
                push(rest)
    return [b for room in rooms for b in by_room[room]]


def _units(capacity: int) -> tuple[int, int]:
    """Size of a class, and the capacity in classes."""
    unit = -(-capacity // CLASSES)
    return unit, capacity // unit


def _classes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sizes in classes, rounded up; an item that fills a container but for less than a class fills it."""
    unit, whole = _units(capacity)
    return np.minimum(-(-sizes // unit), whole)


def _nearly_full(bins: Bins, whole: int) -> bool:
    return bins.room <= int(whole * NEARLY_FULL)


@dataclass
class Local:
    """Items of one task in order of their class: item, class; and what became of them: container (-1: residual), rank, place."""

    item: np.ndarray
    cls: np.ndarray
    container: np.ndarray
    rank: np.ndarray
    place: np.ndarray


def _pack_rest(sizes: np.ndarray, capacity: int, emit_all: bool) -> Local:
    """Packs sizes up to the capacity; containers that aren't nearly full are opened again unless ``emit_all``."""
    unit, whole = _units(capacity)
    cls = _classes(sizes, capacity)
    item = np.argsort(-cls, kind="stable")
    cls = cls[item]
    known, at, counts = np.unique(-cls, return_index=True, return_counts=True)
    start = dict(zip((-known).tolist(), at.tolist()))
    n = len(item)
    container, rank, place = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    left: dict[int, int] = {}
    base = 0
    for bins in best_fit((-known).tolist(), counts.tolist(), whole):
        emit = emit_all or _nearly_full(bins, whole)
        offset = 0
        for size, each, first in bins.parts:
            many = bins.many * each
            rows = np.s_[start[size] + first : start[size] + first + many]
            if emit:
                nth = np.arange(many)
                container[rows], place[rows] = base + nth // each, (offset + nth % each * size) * unit
                offset += each * size
            else:
                rank[rows] = left.get(size, 0) + np.arange(many)
                left[size] = left.get(size, 0) + many
        base += bins.many if emit else 0
    return Local(item, cls, container, rank, place)


def _whole_parts(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Full containers that an item needs for itself, and its rest; 0 for items up to the capacity."""
    whole = np.where(sizes > capacity, (sizes - 1) // capacity, 0)
    return whole, sizes - whole * capacity


def pack_local(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packs the items of one task for good.

    Gives item, part, part's size, container, place of each part, and each container's fill.  An item
    over the capacity is split into full containers and a rest; no other item is split.
    """
    sizes = np.asarray(sizes, np.int64)
    whole, rest = _whole_parts(sizes, capacity)
    own = _pack_rest(rest, capacity, True)
    used = int(own.container.max(initial=-1)) + 1
    big, part, bins = _full_parts(whole, used)
    n_full = len(big)
    container = np.concatenate([bins, own.container])
    size = np.concatenate([np.full(n_full, capacity, np.int64), rest[own.item]])
    return (
        np.concatenate([big, own.item]),
        np.concatenate([part, whole[own.item]]),
        size,
        container,
        np.concatenate([np.zeros(n_full, np.int64), own.place]),
        np.bincount(container, size, used + n_full).astype(np.int64),
    )


def _full_parts(whole: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, part and container of the parts that fill a container alone."""
    n = int(whole.sum())
    return np.repeat(np.arange(len(whole)), whole), np.arange(n) - np.repeat(np.cumsum(whole) - whole, whole), base + np.arange(n)


def merge_group(members: list[int], sizes: list[int], counts: list[int], capacity: int, number: int, last: bool) -> dict[str, list]:
    """What becomes of the residual items of a group: rows of ranges of ranks, for each member and size.

    Rank r of a range lo <= r < hi has k = r + shift; emitted, it is in container base + k // each at place +
    (k % each) * size; else it is rank k of its size among the group's own residual items.
    """
    _, whole = _units(capacity)
    total: dict[int, int] = {}
    spans: dict[int, list[tuple[int, int, int]]] = {}  # size -> (member, first rank in the group, past the last)
    for member, size, n in sorted(zip(members, sizes, counts)):
        at = total.get(size, 0)
        spans.setdefault(size, []).append((member, at, at + n))
        total[size] = at + n
    out: dict[str, list] = {c: [] for c in ("member", "size", "lo", "hi", "emit", "shift", "each", "base", "place")}
    starts = {size: [s[1] for s in own] for size, own in spans.items()}

    def rows(size: int, lo: int, hi: int, emit: bool, shift: int, each: int, base: int, place: int) -> None:
        k = bisect_left(starts[size], lo + 1) - 1
        while lo < hi:
            member, first, end = spans[size][k]
            to = min(hi, end)
            values = (member, size, lo - first, to - first, emit, first + shift, each, base, place)
            for name, v in zip(out, values):
                out[name].append(v)
            lo, k = to, k + 1

    left: dict[int, int] = {}
    for bins in best_fit(list(total), list(total.values()), whole):
        emit = last or _nearly_full(bins, whole)
        offset = 0
        for size, each, first in bins.parts:
            hi = first + bins.many * each
            if emit:
                rows(size, first, hi, True, -first, each, number, offset)
                offset += each * size
            else:
                rows(size, first, hi, False, left.get(size, 0) - first, 1, 0, 0)
                left[size] = left.get(size, 0) + hi - first
        number += bins.many if emit else 0
    return out


def pack(items: DataFrame, plans: DataFrame | list[tuple[int, int]], id_col: str = "doc_id", size: str = "n_tokens", plan_col: str = "plan_id", capacity_col: str = "capacity") -> DataFrame:
    """(plan_id, container, id, part, size, place): where each item goes, for each plan (id, capacity).

    Each partition packs its items and emits its nearly full containers; the items of all others are packed
    by groups of ``FAN_IN`` partitions, then of as many groups, in rounds until one group is left, which emits
    all.  No item is left in a container only because of the task that it came from.  ``place`` counts
    sizes from the container's start, without gaps for capacities up to ``CLASSES``; ``part`` counts from 0
    and is over 0 only for items larger than the capacity.  A null or negative size counts as 0; such items and
    those of size 0 have a container and place too.  Null ids and repeated rows are items of their own.  Plans
    with a null or non-positive capacity are refused.  No items or no plans give an empty table.  A group's
    task has one row for each member, size and plan at most, however many items there are.
    """
    if isinstance(plans, DataFrame):
        plans = [tuple(r) for r in plans.select(plan_col, capacity_col).distinct().limit(MAX_PLANS + 1).collect()]
    if len(plans) > MAX_PLANS or any(c is None or c <= 0 for _, c in plans):
        raise ValueError("plans need a positive capacity, and there may be at most %d" % MAX_PLANS)
    plans = sorted((int(p), int(c)) for p, c in plans)
    capacity_of = dict(plans)
    kind = items.schema[id_col].dataType.simpleString()
    sized = items.select(F.col(f"`{id_col}`").alias("id"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("size"), F.spark_partition_id().alias("task"))
    schema = f"plan int, grp bigint, container bigint, id {kind}, part bigint, size bigint, place bigint, cls bigint, rank bigint"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        ids, sizes = pa.concat_arrays(table.column(0).chunks), table.column(1).to_numpy()
        task = table.column(2)[0].as_py()
        for plan, capacity in plans:
            whole, rest = _whole_parts(sizes, capacity)
            own = _pack_rest(rest, capacity, False)
            big, part, bins = _full_parts(whole, int(own.container.max(initial=-1)) + 1)
            n, n_full = len(own.item), len(big)
            zero = np.zeros(n_full, np.int64)
            container = np.concatenate([bins, own.container])
            cols = {
                "plan": np.full(n + n_full, plan, np.int32),
                "grp": np.full(n + n_full, task, np.int64),
                "container": pa.array(task * _GROUP + container, mask=container < 0),
                "id": ids.take(pa.array(np.concatenate([big, own.item]))),
                "part": np.concatenate([part, whole[own.item]]),
                "size": np.concatenate([np.full(n_full, capacity, np.int64), rest[own.item]]),
                "place": np.concatenate([zero, own.place]),
                "cls": np.concatenate([zero, own.cls]),
                "rank": np.concatenate([zero, own.rank]),
            }
            yield from pa.Table.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in cols.values()], names=list(cols)).to_batches(max_chunksize=100_000)

    placed = materialize(sized.mapInArrow(local, schema), "packed")
    residual = placed.where("container is null")
    top = placed.agg(F.max("grp")).first()[0]
    groups = 0 if top is None else int(top) + 1
    level = residual.groupBy("plan", "grp", F.col("cls").alias("size")).agg(F.count("*").alias("n"))
    columns = "plan int, grp bigint, parent bigint, size bigint, lo bigint, hi bigint, emit boolean, shift bigint, each bigint, base bigint, place bigint"

    def merger(nth: int, last: bool):
        def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            plan, parent = int(key[0]), int(key[1])
            out = merge_group(rows["grp"].tolist(), rows["size"].tolist(), rows["n"].tolist(), capacity_of[plan], nth * _ROUND + parent * _GROUP, last)
            found = pd.DataFrame(out).rename(columns={"member": "grp"})
            found.insert(0, "plan", plan)
            found.insert(2, "parent", parent)
            return found

        return merge

    rounds: list[DataFrame] = []
    while groups > 0 and not (rounds and groups == 1):
        merge = merger(len(rounds) + 1, groups <= FAN_IN)
        ranges = level.withColumn("parent", F.floor(F.col("grp") / FAN_IN)).groupBy("plan", "parent").applyInPandas(merge, columns)
        ranges = materialize(ranges, "ranges")
        rounds.append(ranges)
        level = ranges.where("not emit").groupBy("plan", F.col("parent").alias("grp"), "size").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
        groups = -(-groups // FAN_IN)
    names = [F.col("plan").alias(plan_col), "container", F.col("id").alias(id_col), "part", F.col("size").alias(size), "place"]
    stay = placed.where("container is not null").select(*names)
    if not rounds:
        return stay
    # From the last round back to the first: what a round hands on gets the containers of the next one's ranges.
    final = rounds[-1].drop("parent", "emit")
    for ranges in reversed(rounds[:-1]):
        own, after = ranges.alias("o"), final.alias("f")
        lo, hi = F.greatest(F.col("o.lo"), F.col("f.lo") - F.col("o.shift")), F.least(F.col("o.hi"), F.col("f.hi") - F.col("o.shift"))
        meet = (F.col("o.plan") == F.col("f.plan")) & (F.col("o.parent") == F.col("f.grp")) & (F.col("o.size") == F.col("f.size")) & (lo < hi)
        passed = own.where("not emit").join(after, meet).select("o.plan", "o.grp", "o.size", lo.alias("lo"), hi.alias("hi"), (F.col("o.shift") + F.col("f.shift")).alias("shift"), "f.each", "f.base", "f.place")
        final = ranges.where("emit").drop("parent", "emit").unionByName(passed)
    ranges = final.select(F.col("plan").alias("p"), F.col("grp").alias("g"), F.col("size").alias("s"), "lo", "hi", "shift", "each", "base", F.col("place").alias("at"))
    own = (F.col("plan") == F.col("p")) & (F.col("grp") == F.col("g")) & (F.col("cls") == F.col("s")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    k = F.col("rank") + F.col("shift")
    unit = F.lit(1)
    for plan, capacity in plans:
        if _units(capacity)[0] > 1:
            unit = F.when(F.col("plan") == plan, F.lit(_units(capacity)[0])).otherwise(unit)
    moved = residual.drop("container", "place").join(ranges, own).withColumn("container", F.col("base") + F.floor(k / F.col("each"))).withColumn("place", (F.col("at") + F.pmod(k, F.col("each")) * F.col("cls")) * unit)
    return stay.unionByName(moved.select(*names))


def fill_report(packed: DataFrame, plans: DataFrame, size: str = "n_tokens", plan_col: str = "plan_id", capacity_col: str = "capacity") -> DataFrame:
    """For each plan: containers used, the fewest that could do by total size, and the share of room left free."""
    bins = packed.groupBy(plan_col, "container").agg(F.sum(size).alias("fill"))
    by = bins.groupBy(plan_col).agg(F.count("*").alias("containers"), F.sum("fill").alias("total"))
    joined = by.join(plans.select(plan_col, capacity_col).distinct(), plan_col)
    return joined.select(plan_col, capacity_col, "containers", F.ceil(F.col("total") / F.col(capacity_col)).alias("fewest"), F.round(1 - F.col("total") / (F.col("containers") * F.col(capacity_col)), 6).alias("free_share"))
