"""Near-duplicate texts by covering locality-sensitive hashing.

A text is the set of its distinct 3-character substrings.  Its sketch has ``blocks`` blocks of
``2**(radius + 1) - 1`` places; a place holds nine bits of the smallest value of one hash function over
the set, so that two texts agree in a place with a chance of (nearly) their Jaccard similarity.
Within a block, place i (counted from 1) is labelled with the bits of i, and there is a table for each
non-zero vector v of as many bits: its mask keeps the places whose label has an odd number of bits in
common with v.  Any set of at most ``radius`` places is orthogonal to some v, so two blocks that differ in at
most ``radius`` places agree under some mask and collide in that table: no pair within the radius is
lost, whichever places differ.  Candidates whose numbers of substrings or parity bitmaps rule the similarity
out are dropped, which loses none that has it; all others are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrow import parts, row_chunks, text_bytes
from gristmill.functions.text import fold
from gristmill.operators.collide import binary_rows, colliding_pairs
from gristmill.operators.components import components
from gristmill.operators.neardup import Classes, alike_in_bits, exact_pairs, mixed, parity_words
from gristmill.session import materialize

SHINGLE = 3
#: Places in which two blocks may differ and still collide; blocks of 7 places and 7 tables.
RADIUS = 2
BLOCKS = 12
PLACE_BITS = 9
#: 64-bit words of a set's parity bitmap, a power of two.
CHECK_WORDS = 8
SEED = 20260101
#: Bytes of text sketched at once in a task; pairs, and bytes of their texts, compared at once.
SKETCH_BYTES, VERIFY_PAIRS, VERIFY_BYTES = 1 << 18, 512, 1 << 18


def masks(radius: int = RADIUS) -> np.ndarray:
    """Bit masks over the packed places of a block, one for each non-zero vector."""
    places = range(1, 1 << (radius + 1))
    field = (1 << PLACE_BITS) - 1
    return np.array([sum(field << (PLACE_BITS * (i - 1)) for i in places if (i & v).bit_count() & 1) for v in places], np.uint64)


def shingle_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all 3-character substrings (one number for each substring, without collisions), and the count of each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.maximum(lengths - SHINGLE + 1, 0)
    starts = np.cumsum(lengths) - lengths
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
    if not len(at):
        return np.zeros(0, np.uint64), counts
    return cp[at] << np.uint64(42) | cp[at + 1] << np.uint64(21) | cp[at + 2], counts


def sketch(texts: list[str], radius: int = RADIUS, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: whether it has a substring, its table keys, its check columns (distinct substrings, parity bitmap)."""
    width = (1 << (radius + 1)) - 1
    places = width * blocks
    codes, counts = shingle_codes(texts)
    some = counts > 0
    n = int(some.sum())
    x = mixed(codes)
    starts = (np.cumsum(counts) - counts)[some]
    factors = mixed(np.arange(places, dtype=np.uint64) + np.uint64(SEED)) | np.uint64(1)
    low = np.empty((places, n), np.uint64)
    for k in range(places):
        if n:
            np.minimum.reduceat(x * factors[k], starts, out=low[k])
    low = mixed(low)
    field = low >> np.uint64(64 - PLACE_BITS)
    words = np.zeros((n, blocks), np.uint64)
    for k in range(places):
        words[:, k // width] |= field[k] << np.uint64(PLACE_BITS * (k % width))
    own = masks(radius)
    table = (np.arange(blocks * width, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    keys = mixed((words[:, :, None] & own[None, None, :]).reshape(n, blocks * width) ^ mixed(table)[None, :])
    row = np.repeat(np.arange(n), counts[some])
    order = np.lexsort((codes, row))
    codes, row = codes[order], row[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    sizes = np.bincount(row[new], minlength=n).astype(np.int64)
    checks = np.column_stack([sizes, parity_words(codes[new], sizes, CHECK_WORDS)])
    return some, keys.view(np.int64), checks


def may_reach(load: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Drops only pairs of rows of check columns whose sets can't have the similarity.

    The smaller set has at least that share of the larger one's members, and the sets differ in at least as
    many members as their bitmaps in bits.
    """
    na, nb = load[:, 0][i], load[:, 0][j]
    keep = np.minimum(na, nb) >= np.maximum(na, nb) * similarity - 1e-9
    return alike_in_bits(load, 1, i[keep], j[keep], (na + nb)[keep] * (1 - similarity) / (1 + similarity) + 1e-9)


def distinct_texts(df: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(rep, text) of each distinct text with its smallest id, and the members (id, rep) of each.

    Ids that come more than once with the same text count once.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).where("id is not null and text is not null and text <> ''")
    rows = materialize(rows.withColumn("h", F.xxhash64("text")), "texts")
    reps = materialize(rows.groupBy("h", "text").agg(F.min("id").alias("rep")), "reps")
    # Texts are joined by hash and text; a text with very many copies is split by the join's skew handling.
    members = materialize(rows.join(reps, ["h", "text"]).select("id", "rep").distinct(), "members")
    return reps.select("rep", "text"), members


def candidate_pairs(reps: DataFrame, similarity: float, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct pairs (a, b), a < b, that collide in some table and may have the similarity by their check columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, SKETCH_BYTES):
                some, keys, checks = sketch(part.column(1).to_pylist(), radius, blocks)
                ids = part.column(0).to_numpy()[some]
                offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * np.int32(keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), binary_rows(np.column_stack([ids, checks]))], names=["keys", "load"])

    entries = reps.select(F.col("rep").cast("long"), "text").mapInArrow(run, "keys array<bigint>, load binary").select("load", F.explode("keys").alias("key"))
    return colliding_pairs(entries, 1 + CHECK_WORDS, lambda load, i, j: may_reach(load, i, j, similarity))


def common_counts(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of texts: distinct substrings of the first, of the second, and of both.

    The substrings of all texts are numbered; a text is a row of bits, one for each number.
    """
    index: dict[str, int] = {}
    rows = np.array([index.setdefault(t, len(index)) for t in (*a, *b)], np.int64)
    codes, counts = shingle_codes(list(index))
    known, number = np.unique(codes, return_inverse=True)
    held = np.zeros((len(index), max(64, -(-len(known) // 64) * 64)), np.uint8)
    held[np.repeat(np.arange(len(index)), counts), number] = 1
    bits = np.packbits(held, axis=1).view(np.uint64)
    sizes = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    x, y = rows[: len(a)], rows[len(a) :]
    return sizes[x], sizes[y], np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)


def verify_pairs(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose sets of substrings have at least the given Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _bounded(batch):
                a, b, ta, tb = (batch.column(k).slice(lo, hi - lo) for k in range(4))
                na, nb, both = common_counts(ta.to_pylist(), tb.to_pylist())
                score = both / np.maximum(1, na + nb - both)
                keep = pa.array(score >= similarity)
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(score).filter(keep)], names=["a", "b", "similarity"])

    left = reps.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = reps.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, similarity double")


def _bounded(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``VERIFY_PAIRS`` pairs and about ``VERIFY_BYTES`` bytes of texts, one pair at least."""
    size = np.diff(text_bytes(batch.column(2))[1]) + np.diff(text_bytes(batch.column(3))[1])
    ends = np.concatenate([[0], np.cumsum(size)])
    for lo, hi in row_chunks(ends, VERIFY_BYTES):
        for at in range(lo, hi, VERIFY_PAIRS):
            yield at, min(hi, at + VERIFY_PAIRS)


def exact_links(reps: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of all texts with at least the similarity, without odds: the exact pairs by rare substrings.

    Its cost grows faster than that of the tables; it is there for results that must not lose one link in thousands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, SKETCH_BYTES):
                codes, counts = shingle_codes(part.column(1).to_pylist())
                row = np.repeat(np.arange(part.num_rows), counts)
                order = np.lexsort((codes, row))
                codes, row = codes[order].view(np.int64), row[order]
                new = np.ones(len(codes), bool)
                new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes[new]))], names=["id", "shingles"])

    sets = reps.select(F.col("rep").cast("long").alias("id"), "text").mapInArrow(run, "id bigint, shingles array<bigint>").where("size(shingles) > 0")
    return exact_pairs(Classes(members=None, sets=materialize(sets, "sets")), similarity)


def near_duplicates(df: DataFrame, id_col: str = "id", text: str = "claim", similarity: float = 0.6, radius: int = RADIUS, blocks: int = BLOCKS, folded: bool = False, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) between distinct folded texts, a < b, and the members (id, rep) of each text.

    A text stands for all ids that have it, by the smallest.  Texts without letters and digits, null
    texts and null ids take no part; texts shorter than three characters have no substring and link to
    none; an id may come more than once and with several texts.  An empty table gives empty tables.
    ``exact`` takes exact_links in place of the tables: no odds, at a higher cost.
    """
    reps, members = distinct_texts(df, id_col, F.col(f"`{text}`") if folded else fold(F.col(f"`{text}`")))
    if exact:
        return exact_links(reps, similarity), members
    pairs = candidate_pairs(reps, similarity, radius, blocks)
    return verify_pairs(pairs, reps, similarity), members


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of ids (id_a < id_b): of linked texts, and of the copies of one text."""
    ma = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    mb = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(ma, "a").join(mb, "b").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    within = ma.join(mb.withColumnRenamed("b", "a"), "a").where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(within).distinct()


def group_near_duplicates(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each id: its text's class, the group of texts linked directly or through others, the text's links.

    ``group_id`` is the smallest class of the group; ``n_links`` counts other texts, not copies.
    """
    links = materialize(links, "links")
    roots = components(links)
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    known = roots.withColumnRenamed("node", "rep").join(ends, "rep")
    return members.join(known, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
