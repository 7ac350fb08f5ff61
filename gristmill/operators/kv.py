"""A keyed table that a log of puts and deletes changes: snapshots, look-ups, results of each operation, layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.hashing import spread_hashes, with_numbers
from gristmill.session import materialize

#: Operations of one key that are put in order within one task; longer histories are cut into stretches.
STRETCH = 100_000
#: Bytes of a bucket's header and, besides key and value, of a record; the deepest directory.
HEADER_BYTES, RECORD_BYTES, MAX_DEPTH = 8, 9, 24
#: Smallest page; smaller ones are raised to it.
LEAST_PAGE = 512


def operations(log: DataFrame, seq: str = "seq", op: str = "op", key: str = "key", value: str = "value") -> DataFrame:
    """(seq, op, key, value) with each seq once, op in lower case without outer blanks.

    Rows without seq or key, and operations other than put, get and delete, are left out: no null key can be
    stored.  A put without a value stores ''.  Keys are compared byte by byte: blanks and case count, and
    the empty key is a key.
    """
    rows = log.select(F.col(f"`{seq}`").cast("long").alias("seq"), F.lower(F.trim(F.col(f"`{op}`"))).alias("op"), F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value"))
    rows = rows.where("seq is not null and key is not null and op in ('put', 'get', 'delete')")
    rows = rows.withColumn("value", F.when(F.col("op") == "put", F.coalesce("value", F.lit(""))))
    return rows.dropDuplicates(["seq"])


def snapshot(ops: DataFrame) -> DataFrame:
    """(key, value, seq): the live record of each key after all operations; the last write wins.

    One shuffle of one row for each key and task: hot keys are aggregated before it.
    """
    last = ops.where("op <> 'get'").groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("x"))
    return last.where("x.op = 'put'").select("key", "x.value", "x.seq")


def merge(base: DataFrame, batch: DataFrame) -> DataFrame:
    """A snapshot after a later batch of operations: records that the batch doesn't touch, and its own latest."""
    last = batch.where("op <> 'get'").groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("x"))
    both = base.select("key", "value", "seq").join(last, "key", "full")
    touched = F.col("x").isNotNull()
    return both.where(~touched | (F.col("x.op") == "put")).select("key", F.when(touched, F.col("x.value")).otherwise(F.col("value")).alias("value"), F.when(touched, F.col("x.seq")).otherwise(F.col("seq")).alias("seq"))


def get_many(table: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """Each probed key once for each of its rows, with (value, found); a key that isn't there has a null value."""
    found = table.select(F.col("key"), F.col("value"), F.lit(True).alias("__hit"))
    p = probes.select(F.col(f"`{key}`").alias("key"))
    return p.join(found, "key", "left").select("key", "value", F.coalesce("__hit", F.lit(False)).alias("found"))


def get(table: DataFrame, key: str) -> str | None:
    """One key's value or None: a filter that is pushed to the table's files."""
    row = table.where(F.col("key") == key).select("value").first()
    return None if row is None else row[0]


def results(ops: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(seq, op, key, result, existed): what each operation found before it.

    ``existed`` says whether the key had a live record, ``result`` its value then: the answer of a get,
    ``existed`` the answer of a delete.  A key's history is cut at multiples of ``stretch`` in seq; each
    stretch starts with the state that the earlier ones left, which comes from one row for each key and
    stretch, so that no task orders a hot key's whole history.
    """
    cut = ops.withColumn("stretch", F.floor(F.col("seq") / stretch))
    ends = cut.where("op <> 'get'").groupBy("key", "stretch").agg(F.max(F.struct("seq", "op", "value")).alias("x"))
    # The state at the start of every stretch that follows one with a change.
    marks = cut.select("key", "stretch").distinct().join(ends, ["key", "stretch"], "left")
    before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = marks.select("key", "stretch", F.last("x", True).over(before).alias("start")).where("start is not null")
    carried = starts.select(F.col("start.seq").alias("seq"), F.col("start.op").alias("op"), "key", F.col("start.value").alias("value"), "stretch", F.lit(True).alias("carried"))
    earlier = Window.partitionBy("key", "stretch").orderBy(F.desc("carried"), "seq").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("op") != "get", F.struct("op", "value"))
    done = cut.withColumn("carried", F.lit(False)).unionByName(carried).withColumn("prev", F.last(change, True).over(earlier)).where("not carried")
    live = F.coalesce(F.col("prev.op") == "put", F.lit(False))
    return done.select("seq", "op", "key", F.when(live, F.col("prev.value")).alias("result"), live.alias("existed"))


def record_bytes(key: Column, value: Column) -> Column:
    """Size of a stored record: two lengths, key and value in UTF-8, a flag."""
    return F.octet_length(key) + F.octet_length(value) + RECORD_BYTES


def layout(table: DataFrame, page_bytes: int = 4096) -> DataFrame:
    """(depth, prefix, records, bytes) of the buckets of an extendible hash directory that holds the table.

    A bucket of the low ``depth`` bits of the spread string hash is split while it exceeds its page, 24
    bits at most; this is the settled layout, whatever the order of inserts.  An empty table has one bucket.

    Records are summed by hash, then to nodes of the depth at which buckets of average fill lie and two more
    levels; the levels above are summed from these few nodes, the levels below only from records whose
    node there is still overfull.
    """
    page = max(page_bytes, LEAST_PAGE)
    sized = table.select("key", record_bytes(F.col("key"), F.col("value")).alias("size"))
    hashed = with_numbers(sized, "key", "h", spread_hashes)
    low = materialize(hashed.groupBy(F.col("h").bitwiseAND((1 << MAX_DEPTH) - 1).alias("h")).agg(F.count("*").alias("records"), F.sum("size").alias("bytes")), "hashes")
    total = low.agg(F.sum("bytes")).first()[0] or 0
    middle = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total / page)))) + 2)
    overfull = (F.col("bytes") + HEADER_BYTES > page) & (F.col("depth") < MAX_DEPTH)

    def nodes(rows: DataFrame, first: int, last: int) -> DataFrame:
        deep = rows.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("prefix", F.col("h").bitwiseAND(F.expr("shiftleft(1L, depth) - 1")))
        return deep.groupBy("depth", "prefix").agg(F.sum("records").cast("long").alias("records"), F.sum("bytes").cast("long").alias("bytes"))

    at = low.groupBy(F.col("h").bitwiseAND((1 << middle) - 1).alias("h")).agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))
    sums = nodes(at, 0, middle)
    if middle < MAX_DEPTH:
        dense = at.where(F.col("bytes") + HEADER_BYTES > page).select(F.col("h").alias("top"))
        below = low.join(dense, low["h"].bitwiseAND((1 << middle) - 1) == dense["top"], "left_semi")
        sums = sums.unionByName(nodes(below, middle + 1, MAX_DEPTH))
    sums = materialize(sums, "nodes")
    full = sums.where(overfull).select("depth", "prefix")
    children = full.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix"), F.col("prefix") + F.expr("shiftleft(1L, depth)"))).alias("prefix"))
    root = table.sparkSession.createDataFrame([(0, 0)], "depth int, prefix bigint")
    leaves = children.unionByName(root).join(full, ["depth", "prefix"], "left_anti")
    return leaves.join(sums, ["depth", "prefix"], "left").select("depth", "prefix", F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def file_bytes(used: Column, page_bytes: int) -> Column:
    """Size of a bucket's file: the page, doubled until header and records fit."""
    page = max(page_bytes, LEAST_PAGE)
    need = used + HEADER_BYTES
    # Doublings are counted in whole numbers; a logarithm may be off by rounding.
    return F.aggregate(F.sequence(F.lit(0), F.lit(48)), F.lit(page).cast("long"), lambda size, _: F.when(size < need, size * 2).otherwise(size))


def layout_summary(buckets: DataFrame) -> DataFrame:
    """(global_depth, buckets) of a layout."""
    return buckets.agg(F.max("depth").cast("int").alias("global_depth"), F.count("*").alias("buckets"))
