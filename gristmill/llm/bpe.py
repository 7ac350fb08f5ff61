"""Byte-level BPE by dynamic programming over byte prefixes, vectorised with numpy.

For every byte prefix of a piece there is exactly one token that can stand last in the prefix's
encoding.  Storing that token for each prefix gives the whole encoding by walking back from the end,
lets a text be extended without touching earlier prefixes, and lets an edit be re-encoded from the
last piece before it.  A token ``t`` ending at byte ``i`` is the valid one if the pair
(last token of the prefix before ``t``, ``t``) is stable, that is, if running the merges over the two
tokens' bytes would give exactly these two tokens again.

Nothing here depends on Spark; :mod:`gristmill.llm.tokens` runs it over a corpus.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

LETTER, NUMBER, BLANK, SPACE, OTHER = 1, 2, 3, 4, 0
#: Bytes of text handled at once; a bound on memory, without effect on the ids.
CHUNK_BYTES = 1 << 19
#: Pieces longer than this are keyed by their bytes, shorter ones by two 64-bit hashes.
LONG_PIECE = 256
#: Pieces whose ids a worker keeps; the store is emptied when it is full.
KEPT_PIECES = 400_000
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_NO_RANK = np.int64(1 << 40)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers' files are: $TOKENIZERS_DIR, else the installed package."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, the blank, other white space, or anything else."""
    table = np.zeros(0x110000, np.uint8)
    of = {"L": LETTER, "N": NUMBER}
    # The planes 4 to 13 are unassigned, 15 and 16 for private use.
    for cp in [*range(0x40000), *range(0xE0000, 0xE1000)]:
        if c := of.get(unicodedata.category(chr(cp))[0]):
            table[cp] = c
    # Code points with the property White_Space.
    table[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    table[32] = BLANK
    return table


_power_store: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of ``base`` modulo 2**64."""
    kept = _power_store.get(int(base))
    if kept is None or len(kept) < n:
        size = max(n, 1 << 12)
        kept = np.full(size, base, np.uint64)
        kept[0] = 1
        np.cumprod(kept, out=kept)
        if size <= 1 << 22:
            _power_store[int(base)] = kept
    return kept[:n]


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class _Hashes:
    """Hashes of any slice of a byte array, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, base: np.uint64):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, n), out=self.sums[1:])
        self.back = _powers(_inverse(base), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def split_pieces(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut UTF-8 bytes into pieces before the merges.

    ``rows`` holds the byte offset of each row's start and, last, the end.  Returns the start bytes of
    all pieces and, for each row, the number of the first piece at or after the row's start.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(lead)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    b = data[lead].astype(np.int32)
    cp = b.copy()
    if (many := np.flatnonzero(b >= 0x80)).size:
        wide = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        at, first = lead[many], b[many]
        c1, c2, c3 = wide[at + 1] & 63, wide[at + 2] & 63, wide[at + 3] & 63
        cp[many] = np.where(first < 0xE0, (first & 31) << 6 | c1, np.where(first < 0xF0, (first & 15) << 12 | c1 << 6 | c2, (first & 7) << 18 | c1 << 12 | c2 << 6 | c3))
    kind = _classes()[np.minimum(cp, 0x10FFFF)]
    blank, white = kind == BLANK, kind >= BLANK
    group = np.where(white, BLANK, kind)
    row_start = np.zeros(n + 1, bool)
    row_start[np.searchsorted(lead, rows)] = True
    start = np.ones(n, bool)
    start[1:] = group[1:] != group[:-1]
    start |= row_start[:n]
    # The last of some white space before something else is cut off; if it's a blank, it joins what follows.
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~row_start[1:n])
    start[last] = True
    start[last + 1] = ~blank[last]
    quote = np.flatnonzero((cp == 39) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[~row_start[quote + 1]]
    if quote.size:
        one = cp[quote + 1]
        follows = (quote + 2 < n) & ~row_start[np.minimum(quote + 2, n)]
        two = np.where(follows, cp[np.minimum(quote + 2, n - 1)], 0)
        # The endings cut off after an apostrophe.
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(short, 1, np.where(long, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        ends = quote + 1 + size
        start[ends[ends < n]] = True
    pieces = lead[start]
    return pieces, np.searchsorted(pieces, rows)


class Bpe:
    """Tables of a byte-level BPE vocabulary (a tokenizers JSON file), and encoding with them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # Byte-level vocabularies write each byte as a printable character: itself where it has one, else 256 and on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(plain))}
        vocab: dict[str, int] = model["vocab"]
        n = max(vocab.values()) + 1
        self.tokens: list[bytes] = [b""] * n
        for word, i in vocab.items():
            if all(c in shown for c in word):
                self.tokens[i] = bytes(shown[c] for c in word)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        #: Merge rank of a token, -1 for single bytes; a merged token's rank is that of its merge.
        self.rank = np.full(n, -1, np.int64)
        pairs = []
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            pairs.append(x * n + y)
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        self.n = n
        keys = np.array(pairs, np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], np.arange(len(keys))[order]
        self.byte_id = np.full(256, -1, np.int64)
        for i, t in enumerate(self.tokens):
            if len(t) == 1:
                self.byte_id[t[0]] = i
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        long = [i for i, t in enumerate(self.tokens) if len(t) > 1]
        flat = np.frombuffer(b"".join(self.tokens[i] for i in long), np.uint8)
        ends = np.cumsum(self.length[long])
        starts = ends - self.length[long]
        #: Bytes of all longer tokens, and where each begins.
        self.flat, self.flat_at = flat, np.zeros(n, np.int64)
        self.flat_at[long] = starts
        h = _Hashes(flat, _P1).of(starts, ends) ^ (self.length[long].astype(np.uint64) << np.uint64(56))
        order = np.argsort(h)
        self.token_hash, self.token_of = h[order], np.array(long, np.int64)[order]
        assert (np.diff(self.token_hash) != 0).all(), "token hashes collide"
        # Which lengths a token can have that ends in given two bytes (and in three, folded to 20 bits).
        self.max_len = int(self.length.max())
        self.lens2, self.lens3 = np.zeros(1 << 16, np.uint64), np.zeros(1 << 20, np.uint64)
        for i in long:
            t = self.tokens[i]
            bit = np.uint64(1 << min(len(t), 63))
            self.lens2[t[-1] << 8 | t[-2]] |= bit
            if len(t) > 2:
                self.lens3[self._three(t[-1], t[-2], t[-3])] |= bit
        self._find_slots()

    @staticmethod
    def _three(a, b, c):
        return (a << 12 ^ b << 6 ^ c * 5) & 0xFFFFF

    def _find_slots(self) -> None:
        """Open hash tables for merges and tokens: one probe answers most look-ups."""
        self.slots = []
        for keys in (self.pair_keys.astype(np.uint64), self.token_hash):
            bits = 19
            table = np.full(1 << bits, -1, np.int32)
            slot = (keys * _P2) >> np.uint64(64 - bits)
            rest = np.arange(len(keys))
            while rest.size:
                table[slot[rest]] = np.where(table[slot[rest]] < 0, rest, table[slot[rest]])
                rest = rest[table[slot[rest]] != rest]
                slot[rest] = (slot[rest] + np.uint64(1)) & np.uint64((1 << bits) - 1)
            self.slots.append((table, bits, keys))

    def _look(self, which: int, keys: np.ndarray) -> np.ndarray:
        """Position of each key in its sorted table, or -1."""
        table, bits, own = self.slots[which]
        keys = keys.astype(np.uint64, copy=False)
        slot = ((keys * _P2) >> np.uint64(64 - bits)).astype(np.int64)
        out = table[slot].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (own[out] != keys))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & ((1 << bits) - 1)
            out[open_] = table[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (own[out[open_]] != keys[open_])]
        return out

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens ``a`` and ``b``, side by side, are left as they are by the merges.

        Follows both tokens back in time: the right edge of ``a`` and the left edge of ``b`` are undone,
        later merge first.  A merge across the border that would have come before the next merge of
        either side breaks the pair; at equal rank the left of two places is merged first.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        px, py = np.full(len(a), _NO_RANK), np.full(len(a), _NO_RANK)
        while at.size:
            found = self._look(0, x * self.n + y)
            m = np.where(found >= 0, self.pair_ranks[found], _NO_RANK)
            bad = (m < px) & (m <= py) & (m < _NO_RANK)
            ok[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            at, x, y, px, py, rx, ry = at[go], x[go], y[go], px[go], py[go], rx[go], ry[go]
            undo_x = rx > ry
            px, py = np.where(undo_x, rx, px), np.where(undo_x, py, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def _matches(self, data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (end, token) with a token of two bytes or more that ends there, longest first at each end.

        ``inside``: bytes of the same piece up to and with this one.
        """
        n = len(data)
        wide = data.astype(np.int64)
        one, two = np.roll(wide, 1), np.roll(wide, 2)
        mask = self.lens2[wide << 8 | one]
        mask &= np.where(inside > 2, self.lens3[self._three(wide, one, two)] | np.uint64(4), np.uint64(4))
        mask[inside < 2] = 0
        hashes = _Hashes(data, _P1)
        ends, tokens = [], []
        for size in range(min(self.max_len, int(inside.max(initial=0))), 1, -1):
            at = np.flatnonzero((mask >> np.uint64(min(size, 63)) & np.uint64(1)).astype(bool) & (inside >= size))
            if at.size:
                h = hashes.of(at + 1 - size, at + 1) ^ np.uint64((size << 56) & (2**64 - 1))
                found = self._look(1, h)
                hit = found >= 0
                at, token = at[hit], self.token_of[found[hit]]
                # Equal hashes aren't yet equal bytes.
                same = (data[at[:, None] + np.arange(1 - size, 1)] == self.flat[self.flat_at[token][:, None] + np.arange(size)]).all(axis=1)
                ends.append(at[same])
                tokens.append(token[same])
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, token = np.concatenate(ends), np.concatenate(tokens)
        order = np.argsort(end, kind="stable")
        return end[order], token[order]

    def prefix_table(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each byte, the last token of the encoding of its piece up to and with that byte."""
        n = len(data)
        last = np.full(n, -1, np.int64)
        if n == 0:
            return last
        sizes = np.diff(np.append(starts, n))
        inside = np.arange(n) - np.repeat(starts, sizes) + 1
        end, token = self._matches(data, inside)
        first = np.searchsorted(end, np.arange(n + 1))
        many = np.diff(first)
        # Bytes of equal place in their pieces are worked on together, as each needs those before it only.
        order = np.argsort(inside, kind="stable")
        cuts = np.searchsorted(inside[order], np.arange(1, int(sizes.max()) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            todo, nth = order[lo:hi], 0
            while todo.size:
                more = many[todo] > nth
                cand = np.where(more, token[np.minimum(first[todo] + nth, max(len(token) - 1, 0))] if len(token) else -1, self.byte_id[data[todo]])
                if (lost := cand < 0).any():
                    raise ValueError(f"the vocabulary has no token for byte {int(data[todo[lost][0]])}")
                size = self.length[cand]
                whole = size == inside[todo]
                good = whole.copy()
                if (part := np.flatnonzero(~whole)).size:
                    good[part] = self.stable(last[todo[part] - size[part]], cand[part])
                last[todo[good]] = cand[good]
                if (~good & ~more).any():
                    raise ValueError("no token can end at some byte; the merges aren't those of a byte-level BPE")
                todo, nth = todo[~good], nth + 1
        return last

    def trace(self, last: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces from their prefix table, one after the other, and the number of each."""
        n = len(last)
        ends = np.append(starts[1:], n)
        used = np.zeros(n, bool)
        at, low = ends - 1, starts
        while at.size:
            used[at] = True
            at = at - self.length[last[at]]
            go = at >= low
            at, low = at[go], low[go]
        counts = np.add.reduceat(used.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        return last[used].astype(np.int32), counts


@lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """This process's encoder, so that one Python worker's tasks share the pieces it keeps."""
    return Encoder(load(path))


class Encoder:
    """Encodes rows of UTF-8 bytes; keeps the ids of pieces it has seen."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self._clear()

    def _clear(self) -> None:
        self.known: dict = {}
        self.pool, self.filled = np.zeros(1 << 16, np.int32), 0
        #: Of each kept piece: where its ids are in the pool, how many, and its second hash.
        self.at, self.count, self.check = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint64)

    def _add(self, keys: list, data: np.ndarray, starts: np.ndarray, checks: np.ndarray) -> None:
        ids, counts = self.bpe.trace(self.bpe.prefix_table(data, starts), starts)
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.int32))
        self.pool[self.filled : self.filled + len(ids)] = ids
        offsets = self.filled + np.cumsum(counts) - counts
        self.filled += len(ids)
        base = len(self.known)
        top = base + len(keys)
        self.known.update(zip(keys, range(base, top)))
        for name, values in (("at", offsets), ("count", counts), ("check", checks)):
            own = getattr(self, name)
            while top > len(own):
                own = np.append(own, np.zeros_like(own))
            own[base:top] = values
            setattr(self, name, own)

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the number of ids of each row."""
        pieces, row_at = split_pieces(data, rows)
        n = len(pieces)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(rows) - 1, np.int64)
        if len(self.known) > KEPT_PIECES:
            self._clear()
        ends = np.append(pieces[1:], rows[-1])
        size = ends - pieces
        key = _Hashes(data, _P1).of(pieces, ends)
        check = _Hashes(data, _P2).of(pieces, ends) ^ size.astype(np.uint64)
        code, uniq = pd.factorize(key)
        rep = np.empty(len(uniq), np.int64)
        rep[code[::-1]] = np.arange(n - 1, -1, -1)
        keys: list = uniq.tolist()
        if (long := np.flatnonzero(size > LONG_PIECE)).size:
            raw: dict = {}
            for p in long.tolist():
                k = data[pieces[p] : ends[p]].tobytes()
                code[p] = c = raw.setdefault(k, len(keys) + len(raw))
                if c - len(keys) == len(rep) - len(uniq):
                    rep = np.append(rep, p)
            keys += list(raw)
        place = np.array([self.known.get(k, -1) for k in keys], np.int64)
        if (new := np.flatnonzero(place < 0)).size:
            p = rep[new]
            self._add([keys[i] for i in new.tolist()], *_gather(data, pieces[p], size[p]), check[p])
            place[new] = np.arange(len(self.known) - len(new), len(self.known))
        which = place[code]
        short = size <= LONG_PIECE
        if ((self.check[which] != check) & short).any():  # two pieces of one hash: encode this chunk without the store
            _, first, code = np.unique(np.stack([key, check]), axis=1, return_index=True, return_inverse=True)
            ids, counts = self.bpe.trace(self.bpe.prefix_table(*(got := _gather(data, pieces[first], size[first]))), got[1])
            at, count, pool, which = np.cumsum(counts) - counts, counts, ids, code.ravel()
        else:
            at, count, pool = self.at, self.count, self.pool
        many = count[which]
        total = np.concatenate([[0], np.cumsum(many)])
        ids = pool[np.arange(total[-1]) + np.repeat(at[which] - total[:-1], many)]
        return ids, np.diff(total[row_at])


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``data``, one after the other, and where each starts."""
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)], ends - sizes


def safe_cuts(data: np.ndarray, limit: int) -> list[int]:
    """Places to cut one long text into chunks so that each is encoded as within the whole.

    A cut stands before a blank between two ASCII letters, where a piece always starts; without one a
    chunk grows beyond the limit.
    """
    if len(data) <= limit:
        return [0, len(data)]
    alpha = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    good = np.flatnonzero((data[1:-1] == 32) & alpha[:-2] & alpha[2:]) + 1
    cuts, at = [0], limit
    while (k := np.searchsorted(good, at)) < len(good):
        cuts.append(int(good[k]))
        at = cuts[-1] + limit
    return [*cuts, len(data)]


class EditableText:
    """A text with its ids, kept exact under appends and edits.

    Each piece holds its prefix table; an append or an edit cuts and encodes again from three pieces
    before the change, and keeps all pieces after it from where both cuts agree.
    """

    def __init__(self, bpe: Bpe, text: str = ""):
        self.bpe, self.data, self.starts, self.last = bpe, b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.encoded_bytes = 0
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.data), len(self.data), text)

    def replace(self, start: int, end: int, text: str) -> None:
        """Put ``text`` in the place of the bytes from ``start`` up to ``end`` (both at character borders)."""
        new = self.data[:start] + text.encode() + self.data[end:]
        data = np.frombuffer(new, np.uint8)
        first = max(0, int(np.searchsorted(self.starts, start, "right")) - 3)
        low = int(self.starts[first]) if first < len(self.starts) else 0
        shift = len(new) - len(self.data)
        # The rest is cut in windows until a start falls on one of the old starts well behind the change.
        fresh, stop, old = [], len(new), len(self.starts)
        span = 256 + len(text.encode())
        while True:
            hi = min(len(new), low + span)
            while hi < len(new) and (new[hi] & 0xC0) == 0x80:
                hi += 1
            cut, _ = split_pieces(data[low:hi], np.array([0, hi - low]))
            cut = cut + low
            if hi == len(new):
                fresh = cut
                break
            both = np.intersect1d(cut[:-4] if len(cut) > 4 else cut[:0], self.starts[self.starts > end] + shift)
            both = both[both >= start + len(text.encode()) + 1]
            if both.size:
                stop = int(both[-1])
                fresh, old = cut[cut < stop], int(np.searchsorted(self.starts, stop - shift))
                break
            span *= 2
        head = self.last[:low]
        tail = self.last[stop - shift :] if stop < len(new) else self.last[:0]
        part = data[low:stop]
        self.encoded_bytes = len(part)
        mid = self.bpe.prefix_table(part, fresh - low) if len(part) else self.last[:0]
        self.starts = np.concatenate([self.starts[:first], fresh, self.starts[old:] + shift]).astype(np.int64)
        self.last, self.data = np.concatenate([head, mid, tail]), new

    @property
    def ids(self) -> list[int]:
        return self.bpe.trace(self.last, self.starts)[0].tolist() if len(self.last) else []
