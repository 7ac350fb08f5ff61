"""Near-duplicate texts: hashed character shingles, MinHash signatures, banded look-up, and an exact baseline.

A text in lower case becomes the set of hashes of its k-character windows over UTF-16 units.  Its signature
is the smallest value of each of ``bands * rows`` linear hash functions over the set; texts that agree in all
rows of some band are candidates; a candidate is kept if the share of equal signature places, or the exact Jaccard
similarity of the sets, reaches the threshold.

Texts with equal sets stand as one class, by their smallest id, so that copies are never paired with one
another: links are between classes, and a membership table names each id's class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.arrow import parts, ranges
from gristmill.functions.hashing import JavaRandom, units
from gristmill.operators import blocks
from gristmill.operators.collide import binary_rows, colliding_pairs
from gristmill.session import materialize

PRIME = (1 << 31) - 1
_MAX = np.int64((1 << 63) - 1)
#: Bytes of text hashed at once in a task, and sets hashed to signatures or bitmaps at once.
BATCH_BYTES, BATCH_SETS = 1 << 21, 500
#: Copies (24 bytes each) that are broadcast at most.
MOST_COPIES = 400_000
#: 64-bit words of a set's parity bitmap, a power of two.
PARITY_WORDS = 8


@dataclass(frozen=True)
class Params:
    """Shingle length, bands, rows of a band, threshold, and the seed of the hash functions."""

    k: int = 3
    bands: int = 20
    rows: int = 5
    threshold: float = 0.5
    seed: int = 42

    @cached_property
    def functions(self) -> list[tuple[int, int]]:
        """(a, b) of each hash function, drawn in turn."""
        draw = JavaRandom(self.seed)
        return [(1 + abs(draw.long()) % (PRIME - 1), abs(draw.long()) % PRIME) for _ in range(self.bands * self.rows)]


def shingle_hashes(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct window hashes of each text, one text after the other, and the number of each.

    h = h * 31 + unit over the k units, modulo 2**64 as a signed number.
    """
    u, counts = units([None if t is None else t.lower() for t in texts])
    many = np.maximum(counts - k + 1, 0)
    ends = np.cumsum(many)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(counts) - counts) - (ends - many), many)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = h * np.uint64(31) + u[at + j]
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), many)
    if len(h) and int(h.max()) < 1 << 31:
        # Row and hash in one number: numbers are sorted many times faster than by two keys.
        x = row << np.uint64(31) | h
        x.sort()
        x = x[np.append(True, x[1:] != x[:-1])]
        return (x & np.uint64((1 << 31) - 1)).view(np.int64), np.bincount((x >> np.uint64(31)).view(np.int64), minlength=len(texts)).astype(np.int64)
    h, row = h.view(np.int64), row.view(np.int64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(texts)).astype(np.int64)


def min_hashes(hashes: np.ndarray, counts: np.ndarray, functions: list[tuple[int, int]]) -> np.ndarray:
    """Signatures, one row for each text; places of an empty set hold 2**31 - 1.

    (a * (h without sign bit) + b) is taken modulo 2**64 as a signed number, its remainder by 2**31 - 1 has
    the number's sign: for long shingles places may be negative.
    """
    out = np.full((len(counts), len(functions)), PRIME, np.int64)
    some = counts > 0
    if not some.any():
        return out
    if 0 <= int(hashes.min()) and int(hashes.max()) < 1 << 31:
        return _low_hashes(hashes, counts, functions, out)
    starts = (np.cumsum(counts) - counts)[some]
    # Texts share most of their shingles: each function is computed once for each different one.
    known, number = np.unique(hashes, return_inverse=True)
    x = (known & _MAX).view(np.uint64)
    for i, (a, b) in enumerate(functions):
        v = np.fmod((x * np.uint64(a) + np.uint64(b)).view(np.int64), np.int64(PRIME))
        out[some, i] = np.minimum.reduceat(v.astype(np.int32)[number], starts)
    return out


def _linear(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """a * x + b modulo 2**31 - 1 of numbers below 2**31, without division: upper bits are added to the lower ones."""
    low, shift = np.uint64(PRIME), np.uint64(31)
    v = x * np.uint64(a) + np.uint64(b)
    v = (v & low) + (v >> shift)
    v = (v & low) + (v >> shift)
    v[v >= low] -= low
    return v.view(np.int64)


def _low_hashes(hashes: np.ndarray, counts: np.ndarray, functions: list[tuple[int, int]], out: np.ndarray) -> np.ndarray:
    """min_hashes of hashes below 2**31, by an index from each different one to its texts.

    The least value of a text is nearly always among the lowest 32nd of all values, so only the texts of those hashes
    are visited; a text that has none of them is computed from all of its own.
    """
    x = np.sort(hashes.view(np.uint64) << np.uint64(32) | np.repeat(np.arange(len(counts), dtype=np.uint64), counts))
    text, x = (x & np.uint64(0xFFFFFFFF)).astype(np.int64), x >> np.uint64(32)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    known, many, begin = x[first], np.diff(np.append(first, len(x))), np.cumsum(counts) - counts
    own = np.flatnonzero(counts)
    for i, (a, b) in enumerate(functions):
        v = _linear(known, a, b)
        low = np.flatnonzero(v <= PRIME >> 5)
        col = np.full(len(counts), PRIME, np.int64)
        np.minimum.at(col, text[ranges(first[low], many[low])], np.repeat(v[low], many[low]))
        rest = own[col[own] == PRIME]
        if len(rest):
            n = counts[rest]
            col[rest] = np.minimum.reduceat(_linear(hashes[ranges(begin[rest], n)].view(np.uint64), a, b), np.cumsum(n) - n)
        out[:, i] = col
    return out


def shingle_sets(df: DataFrame, id_col: str, text: str, k: int = 3) -> DataFrame:
    """(id, shingles): the sorted distinct window hashes; an empty array for null and short texts."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, BATCH_BYTES):
                h, counts = shingle_hashes(part.column(1).to_pylist(), k)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(h))], names=["id", "shingles"])

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, f"id {kind}, shingles array<bigint>")


def signatures(sets: DataFrame, params: Params) -> DataFrame:
    """(id, sig) of (id, shingles)."""
    kind = sets.schema["id"].dataType.simpleString()
    functions = params.functions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_SETS):
                part = batch.slice(lo, BATCH_SETS)
                lists = part.column(1)
                h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
                sig = min_hashes(h, np.diff(lists.offsets.to_numpy()), functions)
                offsets = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * np.int32(sig.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))], names=["id", "sig"])

    return sets.select("id", "shingles").mapInArrow(run, f"id {kind}, sig array<bigint>")


def set_digests(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each set: sums of its members mixed in two ways; (0, 0) for the empty set."""
    out = np.zeros((len(counts), 2), np.uint64)
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        for k, (odd, add) in enumerate(((0x9E3779B97F4A7C15, 0x632BE59BD9B4E019), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))):
            out[some, k] = np.add.reduceat(mixed(hashes.view(np.uint64) * np.uint64(odd) + np.uint64(add)), starts)
    return out.view(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with every bit spread over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(df: DataFrame, id_col: str, text: str, params: Params = Params(), with_sets: bool = False, with_signatures: bool = True) -> DataFrame:
    """(id, d1, d2, sig) of each text with an id, in one pass: the digest of its shingle set and its signature.

    ``with_sets`` adds the set itself as ``shingles``, which is many times the text's size.
    """
    kind = df.schema[id_col].dataType.simpleString()
    functions = params.functions if with_signatures else []
    names = ["id", "d1", "d2", *(["sig"] if with_signatures else []), *(["shingles"] if with_sets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, BATCH_BYTES):
                h, counts = shingle_hashes(part.column(1).to_pylist(), params.k)
                digest = set_digests(h, counts)
                cols = [part.column(0), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())]
                if with_signatures:
                    sig = min_hashes(h, counts, functions).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * np.int32(sig.shape[1])), pa.array(sig.ravel())))
                if with_sets:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(h)))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"id {kind}, d1 bigint, d2 bigint" + (", sig array<int>" if with_signatures else "") + (", shingles array<bigint>" if with_sets else "")
    return df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, schema)


@dataclass
class Classes:
    """Classes of equal shingle sets, each by its smallest id: (id, shingles) and (id, sig) of each, and (id, class_id) of all.

    ``sets`` is computed from the texts when it is read; ``sigs`` is there if it was made with the classes,
    for ``params``.  ``count`` is the number of classes, if it is known and no id is in two of them; ``whole`` has
    (id, sig, shingles), computed when it is read.
    """

    sets: DataFrame | None
    members: DataFrame | None
    sigs: DataFrame | None = None
    params: Params | None = None
    count: int | None = None
    whole: DataFrame | None = None
    written: dict[tuple[str, ...], DataFrame] = field(default_factory=dict)

    def blocks(self, *what: str) -> DataFrame:
        """Blocks with "bands", "sig" or "shingles" of the classes, written once; blocks that have more serve as well."""
        for names, made in self.written.items():
            if set(what) <= set(names):
                return made
        rows = self.sets if what == ("shingles",) else self.whole if "shingles" in what else self.sigs
        self.written[what] = blocks.write_blocks(rows, self.count, partial(band_hashes, params=self.params) if "bands" in what else None, "sig" in what)
        return self.written[what]


def group_sketches(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, class_id) and heads (id, d1, d2, sig) of a table of sketches.

    Ids are reduced to one for each digest before they are joined with it; a digest with very many ids
    is split by the join's skew handling.
    """
    heads = materialize(found.groupBy("d1", "d2").agg(F.min("id").alias("class_id")), "heads")
    members = found.select("id", "d1", "d2").join(heads, ["d1", "d2"]).select("id", "class_id").distinct()
    if "sig" not in found.columns:
        return members, heads.select(F.col("class_id").alias("id"), "d1", "d2", F.lit(None).cast("array<int>").alias("sig"))
    # Signatures travel once, to their digest; of repeated rows of a head one is kept there.
    own = found.join(heads, ["d1", "d2"]).where("id = class_id").dropDuplicates(["d1", "d2"]).select("id", "d1", "d2", "sig")
    return members, materialize(own, "signatures")


def classes(df: DataFrame, id_col: str, text: str, k: int = 3, params: Params | None = None, stored: bool = True) -> Classes:
    """Groups ids by the 128-bit digest of their shingle set; with ``params`` (whose k counts), signatures are made too.

    If not ``stored``, signatures are computed when they are read, which should be once.

    Null and short texts all have the empty set and are one class.  A null id takes no part; an id with
    several texts is in several classes.
    """
    p = params or Params(k=k)
    found = materialize(sketches(df, id_col, text, p, with_signatures=False), "sketches")
    by_id = found.groupBy("d1", "d2", "id").agg(F.count("*").alias("n"))
    heads = materialize(by_id.groupBy("d1", "d2").agg(F.min("id").alias("class_id"), F.max("n").alias("n")), "heads")
    members = found.select("id", "d1", "d2").join(heads, ["d1", "d2"]).select("id", "class_id").distinct()
    # Copies are few beside their sketches: the sketches stay where they are made, unless copies are many.
    copies = materialize(found.join(heads, ["d1", "d2"]).where("id <> class_id").select("id", "d1", "d2").distinct(), "copies")
    told = heads.agg(F.count("*").alias("heads"), F.countDistinct("class_id").alias("ids"), F.max("n").alias("n")).first()
    few = copies.count() <= MOST_COPIES
    own = F.broadcast(copies) if few else copies

    def of_heads(**what: bool) -> DataFrame:
        made = sketches(df, id_col, text, p, **what).join(own, ["id", "d1", "d2"], "left_anti")
        return made if (told["n"] or 0) <= 1 else made.dropDuplicates(["id", "d1", "d2"])

    sets = of_heads(with_sets=True, with_signatures=False).select("id", "shingles")
    sigs = of_heads().select("id", "sig") if params else None
    whole = of_heads(with_sets=True).select("id", "sig", "shingles") if params else None
    return Classes(sets, members, materialize(sigs, "signatures") if params and stored else sigs, params, told["heads"] if told["heads"] == told["ids"] else None, whole)


def bit_planes(sig: np.ndarray) -> np.ndarray:
    """Two bits of each place of signatures, as two rows of 64-bit words one after the other; equal places have equal bits."""
    m = mixed(sig.astype(np.int64).view(np.uint64))
    fill = -sig.shape[1] % 64
    planes = [np.packbits(np.pad(((m >> np.uint64(k)) & np.uint64(1)).astype(np.uint8), ((0, 0), (0, fill))), axis=1).view(np.int64) for k in range(2)]
    return np.column_stack(planes)


def may_agree(load: np.ndarray, i: np.ndarray, j: np.ndarray, places: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Drops only pairs whose bit planes show that fewer places agree than the threshold asks for."""
    words = load.shape[1] // 2
    differ = np.zeros(len(i), np.int64)
    most = places - threshold * places + 1e-9
    for k in range(words):
        off = (load[:, k][i] ^ load[:, k][j]) | (load[:, words + k][i] ^ load[:, words + k][j])
        differ += np.bitwise_count(off.view(np.uint64))
        near = differ <= most
        if not near.all():
            i, j, differ = i[near], j[near], differ[near]
    return i, j


def band_hashes(sig: np.ndarray, params: Params) -> np.ndarray:
    """A 64-bit hash of each band's number and rows: one row for each signature."""
    rows = np.ascontiguousarray(sig, np.int64).reshape(len(sig), params.bands, params.rows).view(np.uint64)
    h = np.broadcast_to(mixed(np.arange(params.bands, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)), rows.shape[:2])
    for r in range(params.rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return np.ascontiguousarray(h).view(np.int64)


def _key_lists(sig: np.ndarray, params: Params) -> pa.ListArray:
    ends = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * np.int32(params.bands))
    return pa.ListArray.from_arrays(ends, pa.array(band_hashes(sig, params).ravel()))


def band_keys(sigs: DataFrame, params: Params, load: bool = False, planes: bool = False) -> DataFrame:
    """(id, key), or (load, key) as colliding_pairs takes it: a 64-bit hash of each band's number and rows.

    Two different bands of values have one key with a chance of 2**-64.  ``planes`` adds bit_planes to the load.
    """
    kind = sigs.schema["id"].dataType.simpleString()
    name, kind = ("load", "binary") if load else ("id", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_SETS):
                part = batch.slice(lo, BATCH_SETS)
                n = part.num_rows
                sig = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, params.bands * params.rows)
                own = part.column(0)
                if load:
                    ids = own.to_numpy(zero_copy_only=False).astype(np.int64)[:, None]
                    own = binary_rows(np.column_stack([ids, bit_planes(sig)]) if planes else ids)
                yield pa.RecordBatch.from_arrays([own, _key_lists(sig, params)], names=[name, "keys"])

    return sigs.select("id", "sig").mapInArrow(run, f"{name} {kind}, keys array<bigint>").select(name, F.explode("keys").alias("key"))


def candidates(sigs: DataFrame, params: Params, threshold: float | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of BIGINT ids that share a band.

    With ``threshold``, pairs are left out of which two bits of each place already tell that the share of equal
    places is below it; none that reaches it is lost.
    """
    if threshold is None:
        return colliding_pairs(band_keys(sigs, params, load=True))
    places = params.bands * params.rows
    return colliding_pairs(band_keys(sigs, params, True, True), 2 * -(-places // 64), lambda load, i, j: may_agree(load, i, j, places, threshold))


def near_candidates(sets: DataFrame, params: Params) -> DataFrame:
    """candidates of (id, shingles), without the pairs whose sizes or parity bitmaps rule out the exact threshold: none that reaches it is lost."""
    functions = params.functions
    t = params.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_SETS):
                part = batch.slice(lo, BATCH_SETS)
                h, counts = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), np.diff(part.column(1).offsets.to_numpy()).astype(np.int64)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                load = binary_rows(np.column_stack([ids, counts, parity_words(h, counts)]))
                yield pa.RecordBatch.from_arrays([load, _key_lists(min_hashes(h, counts, functions), params)], names=["load", "keys"])

    def admit(load: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        na, nb = load[:, 0][i], load[:, 0][j]
        keep = np.minimum(na, nb) >= np.maximum(na, nb) * t - 1e-9
        i, j, both = i[keep], j[keep], (na + nb)[keep]
        return alike_in_bits(load, 1, i, j, both * (1 - t) / (1 + t) + 1e-9)

    keys = sets.select("id", "shingles").mapInArrow(run, "load binary, keys array<bigint>").select("load", F.explode("keys").alias("key"))
    return colliding_pairs(keys, 1 + PARITY_WORDS, admit)


def estimated(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def exact(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _scored(pairs: DataFrame, by_id: DataFrame, column: str, score, threshold: float) -> DataFrame:
    left, right = by_id.select(F.col("id").alias("a"), F.col(column).alias("x")), by_id.select(F.col("id").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", score(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= threshold)


def lsh_pairs(groups: Classes, params: Params = Params(), verify: str = "estimated") -> DataFrame:
    """(a, b, similarity) of candidate classes, by the signatures' estimate or ``verify='exact'``."""
    if verify not in ("estimated", "exact"):
        raise ValueError("verify is 'estimated' or 'exact'")
    if verify == "exact":
        sets = materialize(groups.sets, "sets")
        return _scored(near_candidates(sets, params), sets, "shingles", exact, params.threshold)
    sigs = groups.sigs if groups.params == params else materialize(signatures(groups.sets, params), "signatures")
    return _scored(candidates(sigs, params, params.threshold), sigs, "sig", estimated, params.threshold)


def dense_candidates(groups: Classes, params: Params) -> DataFrame:
    """candidates, by blocks: for long texts, of which a large share of all pairs share a band."""
    if groups.count is None or groups.params != params:
        return candidates(groups.sigs if groups.params == params else signatures(groups.sets, params), params)
    return blocks.block_pairs(groups.blocks("bands"), blocks.shared_bands, scored=False)


def _agreeing(one: blocks.Block, two: blocks.Block, i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, share of equal places) of the pairs that reach the threshold; two bits of each place rule most out."""
    pa, pb = (x.once("planes", lambda x=x: bit_planes(x.sig)) for x in (one, two))
    words, places = pa.shape[1] // 2, one.sig.shape[1]
    most = places - threshold * places + 1e-9
    for lo in range(0, len(i), 4096):
        a, b = i[lo : lo + 4096], j[lo : lo + 4096]
        off = pa[a] ^ pb[b]
        near = np.bitwise_count((off[:, :words] | off[:, words:]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= most
        a, b = a[near], b[near]
        share = (one.sig[a] == two.sig[b]).sum(axis=1) / places
        keep = share >= threshold
        yield a[keep], b[keep], share[keep]


def dense_lsh_pairs(groups: Classes, params: Params, verify: str = "estimated") -> DataFrame:
    """lsh_pairs, by blocks: for long texts, of which a large share of all pairs share a band."""
    if groups.count is None or groups.params != params or verify not in ("estimated", "exact"):
        return lsh_pairs(groups, params, verify)

    def compare(one: blocks.Block, two: blocks.Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, j in blocks.shared_bands(one, two):
            if verify == "estimated":
                yield from _agreeing(one, two, i, j, params.threshold)
            else:
                yield from blocks.similar(one, two, i, j, params.threshold)

    return blocks.block_pairs(groups.blocks("bands", "sig" if verify == "estimated" else "shingles"), compare)


def parity_words(hashes: np.ndarray, counts: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """Bitmaps of sets, each member toggling one bit: two sets differ in as many members, at least, as their bitmaps in bits."""
    n, bits = len(counts), 64 * words
    x = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.repeat(np.arange(n), counts) * bits + ((x ^ (x >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, words)


def alike_in_bits(load: np.ndarray, first: int, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows, those whose parity words, in columns from ``first`` on, differ in at most so many bits."""
    differ = np.zeros(len(i), np.int64)
    for k in range(first, load.shape[1]):
        # Of a signed number, bitwise_count would count the absolute value.
        differ += np.bitwise_count((load[:, k][i] ^ load[:, k][j]).view(np.uint64))
        near = differ <= most
        if not near.all():
            i, j, differ, most = i[near], j[near], differ[near], most[near]
    return i, j


def _may_reach(load: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Drops only pairs that another member gives, or whose sets can't have the similarity.

    Rows are (size, place of the member, whether the place is in the shorter prefix, parity words ...).
    """
    size, place, short = load[:, 0], load[:, 1], load[:, 2] > 0
    na, nb = size[i], size[j]
    keep = np.minimum(na, nb) >= np.maximum(na, nb) * threshold - 1e-9
    # Of a pair, the smaller set needs only the shorter prefix; of two of one size, either.
    keep &= (short[i] & (na <= nb)) | (short[j] & (nb <= na))
    i, j, na, nb = i[keep], j[keep], na[keep], nb[keep]
    # What the two can still share after the places already passed.
    ra, rb = place[i], place[j]
    rest = np.minimum(na - ra, nb - rb) + np.minimum(ra, rb)
    both = na + nb
    keep = rest * (1 + threshold) >= both * threshold - 1e-9
    return alike_in_bits(load, 3, i[keep], j[keep], both[keep] * (1 - threshold) / (1 + threshold) + 1e-9)


def exact_pairs(groups: Classes, threshold: float = 0.5, dense: bool = False) -> DataFrame:
    """(a, b, similarity) of all classes (BIGINT ids) with at least the given exact similarity.

    The same result as comparing all with all, without doing so: two sets this similar share one of the
    rarest members of each, as many as the threshold leaves room for.  Members are ranked by how many sets hold
    them; each set is listed under its prefix of rarest members.  Pairs under one member are dropped if
    their sizes, the places of the member or their parity bitmaps rule the threshold out; what is left is
    compared.  It is the exact baseline: at low thresholds prefixes hold common members, and the pairs to be
    ruled out grow with the square of the sets that hold them.  With ``dense``, for long or many texts, all pairs
    are judged by products of their bitmaps as matrices, block by block, if no id is in two classes.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0, and 1 at most")
    if dense and groups.count is not None:
        return blocks.block_pairs(groups.blocks("shingles"), lambda one, two: blocks.all_similar(one, two, threshold))
    sets = materialize(groups.sets, "sets")
    long = sets.select(F.col("id").cast("long").alias("id"), F.explode("shingles").alias("s"))
    counts = long.groupBy("s").agg(F.count("*").alias("df"))
    ranked = long.join(counts, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("members"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_SETS):
                part = batch.slice(lo, BATCH_SETS)
                ids, n = part.column(0).to_numpy(), np.diff(part.column(1).offsets.to_numpy()).astype(np.int64)
                df, s = (np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in part.column(1).flatten().flatten())
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + 1
                prefix, half = (n - np.ceil(n * share - 1e-9).astype(np.int64) + 1 for share in (threshold, 2 * threshold / (1 + threshold)))
                # A member of one set only has no partner; it counts for the others' places.
                own = np.flatnonzero((place <= prefix[row]) & (df > 1))
                row, place = row[own], place[own]
                load = np.column_stack([ids[row], n[row], place, place <= half[row], parity_words(s, n)[row]])
                yield pa.RecordBatch.from_arrays([pa.array(s[own]), binary_rows(load.astype(np.int64))], names=["key", "load"])

    entries = ranked.mapInArrow(prefixes, "key bigint, load binary")
    pairs = colliding_pairs(entries, 3 + PARITY_WORDS, lambda load, i, j: _may_reach(load, i, j, threshold))
    return _scored(pairs, sets, "shingles", exact, threshold)


def similar_to(queries: DataFrame, sigs: DataFrame, params: Params = Params(), verified: bool = True) -> DataFrame:
    """(q, id, similarity) of indexed signatures similar to each query's; all candidates if not ``verified``.

    ``queries`` and ``sigs`` are (id, sig); queries aren't added to the index, and one that is in it finds itself.
    """
    q, t = band_keys(queries, params), band_keys(sigs, params)
    hits = q.withColumnRenamed("id", "q").join(t, "key").select("q", "id").distinct()
    left, right = queries.select(F.col("id").alias("q"), F.col("sig").alias("x")), sigs.select("id", F.col("sig").alias("y"))
    scored = hits.join(left, "q").join(right, "id").select("q", "id", estimated(F.col("x"), F.col("y")).alias("similarity"))
    return scored.where(F.col("similarity") >= params.threshold) if verified else scored


def quality(found: DataFrame, true: DataFrame) -> DataFrame:
    """(found, true, both, recall, precision) of two tables of pairs (a, b); recall of nothing and precision of nothing are 1."""
    f, t = found.select("a", "b", F.lit(1).alias("f")), true.select("a", "b", F.lit(1).alias("t"))
    n = f.join(t, ["a", "b"], "full").agg(F.count("f").alias("found"), F.count("t").alias("true"), F.sum(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("both"))
    share = lambda whole: F.when(F.col(whole) == 0, 1.0).otherwise(F.col("both") / F.col(whole))
    return n.select("found", "true", F.coalesce("both", F.lit(0)).cast("long").alias("both"), share("true").alias("recall"), share("found").alias("precision"))


class SignatureIndex:
    """A growing index of texts at ``path``: their sketches, appended as they come; texts aren't kept.

    ``add`` costs as much as the texts it adds.  Queries aren't added; each call sees what has been added
    before it.  Ids are BIGINT and the caller's; texts under one id twice are two entries.
    """

    def __init__(self, spark: SparkSession, path: str, params: Params = Params()):
        self.spark, self.path, self.params = spark, path, params
        self._schema = "id bigint, d1 bigint, d2 bigint, sig array<int>"
        spark.createDataFrame([], self._schema).write.mode("append").parquet(path)

    def add(self, texts: DataFrame, id_col: str = "id", text: str = "text") -> None:
        own = texts.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
        sketches(own, "id", "t", self.params).write.mode("append").parquet(self.path)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)

    def size(self) -> int:
        return self.entries().count()

    def signature(self, id: int) -> list[int] | None:
        """One entry's signature: a filter that is pushed to the files."""
        row = self.entries().where(F.col("id") == id).select("sig").first()
        return None if row is None else list(row[0])

    def signatures(self, ids: DataFrame) -> DataFrame:
        """(id, sig) of all the ids (column id) that are there."""
        return self.entries().join(ids.select("id").distinct(), "id", "left_semi").select("id", "sig")

    def _asked(self, texts: DataFrame, id_col: str, text: str) -> DataFrame:
        return sketches(texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t")), "id", "t", self.params).select("id", "sig")

    def candidates_of(self, texts: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
        """(q, id): entries that share a band with each query text, not verified."""
        q = band_keys(self._asked(texts, id_col, text), self.params).withColumnRenamed("id", "q")
        return q.join(band_keys(self.entries(), self.params), "key").select("q", "id").distinct()

    def similar_to(self, texts: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
        """(q, id, similarity) of the candidates whose estimated similarity reaches the threshold."""
        return similar_to(self._asked(texts, id_col, text), self.entries().select("id", "sig"), self.params)

    def classes(self) -> Classes:
        members, heads = group_sketches(self.entries())
        return Classes(None, members, heads.select("id", "sig"), self.params)

    def duplicates(self) -> DataFrame:
        """(a, b, similarity) of all classes of entries, as lsh_pairs."""
        return lsh_pairs(self.classes(), self.params)
