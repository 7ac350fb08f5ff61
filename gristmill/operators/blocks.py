"""Similar pairs of texts by blocks: some thousand texts are one value, written once, and any two blocks meet without a shuffle.

Where a large share of all pairs are candidates (long texts that hold the same common shingles), their number grows with the
square of the texts, and entries or pairs that are shuffled don't fit on any disk.  Here only the blocks are on disk, as often
as there are texts; each pair of texts is in one pair of blocks, so that pairs are found once and leave the task as they are.
"""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrow import ranges
from gristmill.session import register_written, shared_dir

#: Texts of a block with signatures, of one without, and bytes of its raw columns, at most; blocks that a table has, if it has texts enough.
ROWS, SET_ROWS, BYTES, LEAST_BLOCKS = 6400, 16384, 48 << 20, 12
#: Texts whose pairs are judged by one matrix product, pairs that are looked at in one step, and decoded blocks kept by a task.
TILE, STEP, KEPT = 1024, 1 << 16, 2
#: Bytes of matrices that a decoded block keeps.
HELD = 32 << 20
#: Bits of a block's sets as places of a vocabulary, at most; larger ones are compared member by member.
DENSE = 1 << 28
#: Bits of the longest parity bitmap.
BITS = 4096
#: Pairs that are held before their sets are compared.
PAIRS = 1 << 17
#: Bits of a count, by the counts that one 32-bit float holds exactly.
WIDTHS = {3: 8, 2: 12, 1: 23}


def write_blocks(rows: DataFrame, count: int, hashes: Callable[[np.ndarray], np.ndarray] | None = None, keep_sig: bool = True) -> DataFrame:
    """(block, data) of (id BIGINT) with sig, shingles or both; ``count`` is about the number of rows.

    ``hashes`` gives the keys of the bands of signatures, which may then be left out.

    A block is a file of its own, and some files are a partition: the product of the table with itself has tasks enough.
    """
    names = [c for c in ("sig", "shingles") if c in rows.columns]
    most = min(ROWS if "sig" in names else SET_ROWS, max(64, -(-count // LEAST_BLOCKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held, n, size, block = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            data = encoded(pa.Table.from_batches(held).combine_chunks(), names, hashes, keep_sig)
            return pa.RecordBatch.from_arrays([pa.array([first + block], pa.int64()), pa.array([data], pa.binary())], names=["block", "data"])

        for batch in batches:
            step = max(1, min(256, most))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                if held and (n + part.num_rows > most or size + part.nbytes > BYTES):
                    yield flush()
                    held, n, size, block = [], 0, 0, block + 1
                held.append(part)
                n, size = n + part.num_rows, size + part.nbytes
        if held:
            yield flush()

    spark = rows.sparkSession
    path = register_written(f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}")
    rows.select(F.col("id").cast("long").alias("id"), *names).mapInArrow(run, "block bigint, data binary").write.option("maxRecordsPerFile", 1).parquet(path)
    read = spark.read.schema("block bigint, data binary")
    files = sorted(read.parquet(path).inputFiles())
    groups = [files[k::24] for k in range(min(24, len(files)))]
    return reduce(DataFrame.unionAll, [read.parquet(*g) for g in groups]) if groups else read.parquet(path)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()).astype(np.int64)


def encoded(table: pa.Table, names: list[str], hashes: Callable[[np.ndarray], np.ndarray] | None = None, keep_sig: bool = True) -> bytes:
    """A block's texts by the size of their sets; members are places in the block's own vocabulary, as differences.

    The keys of each band are sorted, with the texts that have them.
    """
    out: dict = {"ids": table.column("id").to_numpy().astype(np.int64)}
    order = np.arange(table.num_rows)
    if "shingles" in names:
        h, counts = _lists(table.column("shingles"))
        order = np.argsort(counts, kind="stable")
        h, counts = h[ranges((np.cumsum(counts) - counts)[order], counts[order])], counts[order]
        vocabulary = np.sort(h)
        vocabulary = vocabulary[np.append(True, vocabulary[1:] != vocabulary[:-1])] if len(h) else vocabulary
        at = np.searchsorted(vocabulary, h).astype(np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32)
        at[1:] -= at[:-1].copy()
        out |= {"sizes": counts, "vocabulary": vocabulary, "kind": at.dtype.str, "many": at.nbytes, "members": pa.compress(at.tobytes(), "zstd", asbytes=True)}
    if "sig" in names:
        sig, _ = _lists(table.column("sig"))
        sig = sig.astype(np.int32).reshape(table.num_rows, -1)[order]
        if hashes is not None:
            keys = np.ascontiguousarray(np.concatenate([hashes(sig[lo : lo + 512]) for lo in range(0, len(sig), 512)]).T)
            place = np.argsort(keys, axis=1)
            out["bands"] = np.take_along_axis(keys, place, axis=1), place.astype(np.int32 if len(sig) > 1 << 16 else np.uint16)
        if keep_sig:
            out["sig"] = sig
    return pickle.dumps(out | {"ids": out["ids"][order]}, 5)


class Block:
    """A decoded block; what a comparison needs is made when it first does."""

    def __init__(self, data: bytes):
        x = pickle.loads(data)
        self.ids, self.sig, self.bands = x["ids"], x.get("sig"), x.get("bands")
        self.n = len(self.ids)
        if "members" in x:
            self.sizes, self.vocabulary = x["sizes"], x["vocabulary"]
            steps = np.frombuffer(pa.decompress(x["members"], x["many"], "zstd", asbytes=True), x["kind"])
            self.members = np.cumsum(steps, dtype=steps.dtype)
            self.starts = np.cumsum(self.sizes) - self.sizes
        self.made: dict = {}

    def once(self, key, make):
        if key not in self.made:
            self.made[key] = make()
        return self.made[key]

    def bit_of(self, bits: int) -> np.ndarray:
        """A bit for each member of the vocabulary."""
        x = self.vocabulary.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (((x ^ (x >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)

    def parity(self, bits: int = BITS) -> np.ndarray:
        """Bitmaps, each member toggling one bit: two sets differ in as many members, at least, as their bitmaps in bits."""

        def make() -> np.ndarray:
            bit = self.bit_of(BITS)
            word, mask = bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64)
            out = np.zeros(self.n * BITS // 64, np.uint64)
            for lo in range(0, self.n, 512):
                hi = min(lo + 512, self.n)
                own = self.members[self.starts[lo] : self.starts[hi - 1] + self.sizes[hi - 1]]
                np.bitwise_xor.at(out, np.repeat(np.arange(lo, hi) * (BITS // 64), self.sizes[lo:hi]) + word[own], mask[own])
            return out.reshape(self.n, -1)

        def folded() -> np.ndarray:
            words = self.parity()
            while words.shape[1] * 64 > bits:
                half = words.shape[1] // 2
                words = words[:, :half] ^ words[:, half:]
            return np.ascontiguousarray(words)

        return self.once(f"parity {bits}", make if bits == BITS else folded)

    def tile(self, first: int, bits: int, share: float) -> Tile:
        """The parity bitmaps of some texts, for products."""

        def make() -> Tile:
            sizes = self.sizes[first : first + TILE]
            own = self.members[self.starts[first] : self.starts[first] + int(sizes.sum())]
            at = np.repeat(np.arange(len(sizes)) * bits, sizes) + self.once(f"bit {bits}", lambda: self.bit_of(bits))[own]
            return Tile((np.bincount(at, minlength=len(sizes) * bits) & 1).astype(np.uint8).reshape(-1, bits), sizes, share)

        held = [k for k in self.made if isinstance(k, tuple)]
        if sum(self.made[k].nbytes for k in held) > HELD:
            for k in held:
                del self.made[k]
        return self.once((first, bits, share), make)


class Tile:
    """Bitmaps of some texts: of two texts that may be similar, the bits that both have are as many, at least, as the sum of their ``least``."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, share: float):
        ones = flat.sum(axis=1, dtype=np.int64)
        self.flat, self.n, self.most = flat, len(flat), int(ones.max())
        self.least = np.floor((ones - share * sizes) / 2 - 1e-9).astype(np.int64)
        self.made: dict = {}

    @property
    def nbytes(self) -> int:
        return self.flat.nbytes + sum(x.nbytes for x in self.made.values())

    def left(self) -> np.ndarray:
        if 0 not in self.made:
            self.made[0] = np.hstack([self.flat, -self.least[:, None], np.ones((self.n, 1))]).astype(np.float32)
        return self.made[0]

    def right(self, fields: int) -> np.ndarray:
        """Some texts in one row: a product has the counts of all of them, side by side, and the highest bit of each tells whether it is enough."""
        if fields not in self.made:
            rows, width = -(-self.n // fields), WIDTHS[fields]
            fill = rows * fields - self.n
            flat = np.pad(self.flat, ((0, fill), (0, 0))).reshape(fields, rows, -1)
            least = np.pad(self.least, (0, fill), constant_values=self.least.max()).reshape(fields, rows)
            unit = [1 << (width * f) for f in range(fields)]
            packed = sum(flat[f].astype(np.float32) * np.float32(unit[f]) for f in range(fields))
            start = sum(((1 << (width - 1)) - least[f]) * unit[f] for f in range(fields))
            self.made[fields] = np.hstack([packed, np.full((rows, 1), sum(unit)), start[:, None]]).astype(np.float32)
        return self.made[fields]

    def fields(self, other: Tile) -> int:
        """As many counts in one number as keep to their own bits, in any order of summation."""
        low, high = self.least.max(), self.least.min()
        for fields, width in WIDTHS.items():
            half = 1 << (width - 1)
            if max(low, 0) + max(other.least.max(), 0) <= half and min(self.most, other.most) - other.least.min() - min(high, 0) < half:
                return fields
        return 1

    def near(self, other: Tile) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of the pairs with one of another tile that the bitmaps don't rule out; ``i`` ascends.

        All sums are of whole numbers below 2**24, which 32-bit floats hold exactly.
        """
        fields = self.fields(other)
        width, right = WIDTHS[fields], other.right(fields)
        found = (self.left() @ right.T).astype(np.int32).ravel()
        found &= sum(1 << (width * f + width - 1) for f in range(fields))
        at = np.flatnonzero(found != 0)
        i, row, found = at // len(right), at % len(right), found[at]
        own = [np.flatnonzero(found >> (width * f + width - 1) & 1) for f in range(fields)]
        i, j = np.concatenate([i[o] for o in own]), np.concatenate([row[o] + f * len(right) for f, o in enumerate(own)])
        real = np.flatnonzero(j < other.n)
        real = real[np.argsort(i[real], kind="stable")]
        return i[real], j[real]


def _within(one: Block, two: Block, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Drops only pairs whose sizes or longest bitmaps rule the similarity out."""
    na, nb = one.sizes[i], two.sizes[j]
    keep = np.minimum(na, nb) >= np.maximum(na, nb) * threshold - 1e-9
    i, j, both = i[keep], j[keep], (na + nb)[keep]
    bits = BITS
    while bits > 256 and bits > 2 * (one.sizes.mean() + two.sizes.mean()):
        bits //= 2
    a, b, near = one.parity(bits), two.parity(bits), np.zeros(len(i), bool)
    for lo in range(0, len(i), 4096):
        at = slice(lo, lo + 4096)
        near[at] = np.add.reduce(np.bitwise_count(a.take(i[at], 0) ^ b.take(j[at], 0)), axis=1, dtype=np.uint16) <= both[at] * (1 - threshold) / (1 + threshold) + 1e-9
    return i[near], j[near]


def _dense(block: Block, place: np.ndarray, width: int) -> np.ndarray:
    """A bit for each place that a set has a member at; several members at one place leave any bit there."""
    words = -(-width // 64)
    out, word, mask = np.zeros(block.n * words, np.uint64), place >> 6, np.uint64(1) << (place & 63).astype(np.uint64)
    for lo in range(0, block.n, 512):
        hi = min(lo + 512, block.n)
        own = block.members[block.starts[lo] : block.starts[hi - 1] + block.sizes[hi - 1]]
        np.bitwise_xor.at(out, np.repeat(np.arange(lo, hi) * words, block.sizes[lo:hi]) + word[own], mask[own])
    return out.reshape(block.n, words)


def similar(one: Block, two: Block, i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, exact similarity) of the pairs that reach the threshold; ``i`` ascends."""
    yield from _compared(one, two, *_within(one, two, i, j, threshold), threshold)


def _compared(one: Block, two: Block, i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if not len(i):
        return
    # Places of the second vocabulary in the first; what isn't there falls on a place of its own, which no text holds.
    width = len(one.vocabulary) + 1
    place = np.searchsorted(one.vocabulary, two.vocabulary)
    there = place < len(one.vocabulary)
    there[there] = one.vocabulary[place[there]] == two.vocabulary[there]
    place[~there] = width - 1
    if max(one.n, two.n) * width <= DENSE and 4 * len(i) > one.n + two.n:
        if two.made.get("for") is not one:
            two.made |= {"for": one, "mapped": _dense(two, place, width)}
        a, b = one.once("dense", lambda: _dense(one, np.arange(width), width)), two.made["mapped"]
        for lo in range(0, len(i), 512):
            p, q = i[lo : lo + 512], j[lo : lo + 512]
            both = np.bitwise_count(a[p] & b[q]).sum(axis=1, dtype=np.int64)
            similarity = both / np.maximum(one.sizes[p] + two.sizes[q] - both, 1)
            keep = similarity >= threshold
            yield p[keep], q[keep], similarity[keep]
        return
    ends = np.cumsum(two.sizes[j])
    lo = 0
    while lo < len(i):
        # Some texts of the first block at once, and half a million members of the second's.
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 19), "right"))
        own, first = np.unique(i[lo : max(hi, lo + 1)], return_index=True)
        most = max(1, min(64, (8 << 20) // width))
        hi = lo + int(first[most]) if len(own) > most else max(hi, lo + 1)
        own = own[:most]
        held = np.zeros((len(own), width), np.uint8)
        held[np.repeat(np.arange(len(own)), one.sizes[own]), one.members[ranges(one.starts[own], one.sizes[own])]] = 1
        a, b = i[lo:hi], j[lo:hi]
        nb = two.sizes[b]
        at = np.repeat(np.searchsorted(own, a) * width, nb) + place[two.members[ranges(two.starts[b], nb)]]
        sums = np.append(0, np.cumsum(held.ravel()[at], dtype=np.int64))
        upto = np.cumsum(nb)
        both = sums[upto] - sums[upto - nb]
        whole = one.sizes[a] + nb - both
        similarity = both / np.maximum(whole, 1)
        keep = similarity >= threshold
        yield a[keep], b[keep], similarity[keep]
        lo = hi


def _bits(size: float, threshold: float) -> int:
    """Bits that tell most sets of this size apart which have a tenth of their members in common.

    Nearly three deviations below the mean, some pairs in a thousand are left.
    """
    may = 2 * size * (1 - threshold) / (1 + threshold)
    for bits in range(64, BITS, 64):
        if bits / 2 * (1 - np.exp(-3.6 * size / bits)) - 1.4 * np.sqrt(bits) >= may:
            return bits
    return BITS


def all_similar(one: Block, two: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of all pairs that reach the threshold, of one block with another or with itself (i < j)."""
    same = one is two
    share = (1 - threshold) / (1 + threshold)
    held, many = [], 0
    for p in range(0, one.n, TILE):
        na = one.sizes[p : p + TILE]
        for q in range(p if same else 0, two.n, TILE):
            nb = two.sizes[q : q + TILE]
            if na[-1] < nb[0] * threshold - 1e-9 or nb[-1] < na[0] * threshold - 1e-9:
                continue
            bits = _bits((na.mean() + nb.mean()) / 2, threshold)
            i, j = one.tile(p, bits, share).near(two.tile(q, bits, share))
            i, j = i + p, j + q
            if same and p == q:
                i, j = i[i < j], j[i < j]
            held.append(_within(one, two, i, j, threshold))
            many += len(held[-1][0])
            if many > PAIRS:
                yield from _all_compared(one, two, held, threshold)
                held, many = [], 0
    if many:
        yield from _all_compared(one, two, held, threshold)


def _all_compared(one: Block, two: Block, held: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    i, j = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(i, kind="stable")
    return _compared(one, two, i[order], j[order], threshold)


def shared_bands(one: Block, two: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs that share a band, each once."""
    (ka, oa), (kb, ob) = one.bands, two.bands
    hit = np.zeros(one.n * two.n, bool)
    for band in range(len(ka)):
        lo = np.searchsorted(kb[band], ka[band], "left")
        many = np.searchsorted(kb[band], ka[band], "right") - lo
        some = np.flatnonzero(many)
        ends = np.cumsum(many[some])
        at = 0
        while at < len(some):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
            s = some[at:end]
            hit[np.repeat(oa[band][s].astype(np.int64) * two.n, many[s]) + ob[band][ranges(lo[s], many[s])]] = True
            at = end
    for p in range(0, one.n, 512):
        at = np.flatnonzero(hit[p * two.n : (p + 512) * two.n])
        i, j = at // two.n + p, at % two.n
        if one is two:
            i, j = i[i < j], j[i < j]
        yield i, j


def block_pairs(blocks: DataFrame, compare, scored: bool = True) -> DataFrame:
    """(a, b, similarity), or (a, b), of what ``compare`` yields, as (i, j) and similarities, for any two blocks and each with itself.

    Ids are those of one text each.
    """
    left, right = blocks.select(F.col("block").alias("p"), F.col("data").alias("x")), blocks.select(F.col("block").alias("q"), F.col("data").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, Block] = OrderedDict()

        def block(key: int, data: pa.Scalar) -> Block:
            if key not in kept:
                kept[key] = Block(data.as_py())
                while len(kept) > KEPT:
                    kept.popitem(last=False)
            kept.move_to_end(key)
            return kept[key]

        for batch in batches:
            for r in range(batch.num_rows):
                p, q = batch.column(0)[r].as_py(), batch.column(2)[r].as_py()
                one = block(p, batch.column(1)[r])
                two = one if p == q else block(q, batch.column(3)[r])
                for i, j, *rest in compare(one, two):
                    a, b = one.ids[i], two.ids[j]
                    for lo in range(0, len(a), STEP):
                        at = slice(lo, lo + STEP)
                        cols = [pa.array(np.minimum(a[at], b[at])), pa.array(np.maximum(a[at], b[at])), *(pa.array(c[at]) for c in rest)]
                        yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "similarity"][: len(cols)])
            del batch
            pa.default_memory_pool().release_unused()

    return left.crossJoin(right).where("p <= q").mapInArrow(run, "a bigint, b bigint" + ", similarity double" * scored)
