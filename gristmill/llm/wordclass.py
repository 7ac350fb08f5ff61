"""Function words and word classes of texts, and a trigram model over them, vectorised with numpy.

A text becomes a sequence of symbols: a function word is its own symbol, any other word its class
(script, length, case, digits, repeated within the last words or not), any sign the class of the sign.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from gristmill.llm import bpe

# Frequent function words of the languages of the corpus.
FUNCTION_WORDS = {
    "en": "the of and in to a is was were with for by that on as at from be are an or which this these it not no than had has have after before between under only when whether through we our they their its did does do may can could here there most other one two into both neither nor against how what but if so because while although whereas",
    "de": "der die das und zu den von mit des ist im nicht ein eine einer einem dem für auf als bei nach sich wurde wurden war waren sind zwischen ohne durch aus zur zum es ob wie werden kann noch meist hatten dies wir oder aber nur alle weitere frühere bevor ließ konnte hat sehr mehr",
    "fr": "le la les un une d l du et dans par que qui est sont sur au aux ont été avec pas pour il elle n qu a après sans ce cette ces se son sa plus bout avant chez ou mais leur nous ont donc était lors tous",
    "ru": "и в не на с что по как из при для от к был была были мы он она они это этом без ли ни его об после до между где но за через выше ниже все пока один оказался нужны раньше который когда также более есть ещё",
}
SIGNS = ".,;:!?()[]{}\"'#|/\\•*-–_=<>%+&@$€~^`"
WORD_KINDS = ["latin short", "latin long", "Latin", "CAPS", "cyrillic", "Cyrillic", "other script", "code", "number", "measure", "address"]
#: A word counts as repeated if it stood among so many words before it.
REPEAT_WITHIN = 12
#: Letters from which a plain word is a long one.
LONG_WORD = 10


def _words() -> list[str]:
    return list(dict.fromkeys(w for words in FUNCTION_WORDS.values() for w in words.split()))


WORDS = _words()
PAD, LINE, OTHER_SIGN = 0, 1, 2
_SIGN0 = 3
_KIND0 = _SIGN0 + len(SIGNS)
_REP0 = _KIND0 + len(WORD_KINDS)
#: A word that stands among the two before it.
ECHO = _REP0 + len(WORD_KINDS)
_WORD0 = ECHO + 1
SYMBOLS = _WORD0 + len(WORDS)
_ENDS = np.array([_SIGN0 + SIGNS.index(c) for c in ".!?"])
_MULT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case, kind of character, sign symbol."""
    size = 0x30000
    lower = np.arange(size, dtype=np.uint32)
    kind = bpe._classes()[:size].copy()  # 1 letter, 2 number, 3 and 4 white space
    import unicodedata

    for cp in range(size):
        c = chr(cp)
        if kind[cp] == bpe.LETTER:
            low = c.lower()
            if len(low) == 1 and ord(low) != cp:
                lower[cp] = ord(low)
        elif kind[cp] == bpe.OTHER and cp > 127 and unicodedata.category(c) in ("Mn", "Mc", "Cf"):
            kind[cp] = 6 if unicodedata.category(c) != "Cf" else 7
    kind[[ord(c) for c in "-'’–.,/_"]] = 8
    sign = np.full(size, OTHER_SIGN, np.uint16)
    for k, c in enumerate(SIGNS):
        sign[ord(c)] = _SIGN0 + k
    for c, as_ in (("“", '"'), ("”", '"'), ("„", '"'), ("«", '"'), ("»", '"'), ("’", "'"), ("—", "–"), ("…", "."), ("。", "."), ("·", "•")):
        sign[ord(c)] = _SIGN0 + SIGNS.index(as_)
    return lower, kind, sign


@lru_cache(1)
def _word_ids() -> tuple[np.ndarray, np.ndarray]:
    h = np.array([_hash_word(w) for w in WORDS], np.uint64)
    order = np.argsort(h)
    return h[order], order + _WORD0


def _hash_word(w: str) -> np.uint64:
    out = 0
    for c in w:
        out = (out * int(_MULT) + ord(c) + 1) & (2**64 - 1)
    return np.uint64(out)


def symbols(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of UTF-8 rows, the characters each stands for (white space left out), and each row's first."""
    lower, kinds, signs = _tables()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(lead)
    empty = np.zeros(0, np.int64)
    if n == 0:
        return empty.astype(np.uint16), empty, np.zeros(len(rows), np.int64)
    b = data[lead].astype(np.int32)
    cp = b.copy()
    if (many := np.flatnonzero(b >= 0x80)).size:
        wide = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        at, first = lead[many], b[many]
        c1, c2, c3 = wide[at + 1] & 63, wide[at + 2] & 63, wide[at + 3] & 63
        cp[many] = np.where(first < 0xE0, (first & 31) << 6 | c1, np.where(first < 0xF0, (first & 15) << 12 | c1 << 6 | c2, (first & 7) << 18 | c1 << 12 | c2 << 6 | c3))
    cp[cp >= len(kinds)] = 0xFFFD
    kind = kinds[cp]
    row_at = np.searchsorted(lead, rows)
    cut = np.zeros(n + 1, bool)
    cut[row_at] = True
    alnum = (kind == bpe.LETTER) | (kind == bpe.NUMBER) | (kind == 6)
    inner = np.zeros(n, bool)
    if n > 2:
        joiner = kind >= 7
        inner[1:-1] = joiner[1:-1] & alnum[:-2] & alnum[2:] & ~cut[1 : n - 1] & ~cut[2:n]
    word = alnum | inner
    white = (kind == bpe.BLANK) | (kind == bpe.SPACE)
    newline = (cp == 10) | (cp == 13)
    sign = ~word & ~white & (kind != 7)
    prev_same = np.zeros(n, bool)
    prev_same[1:] = ~cut[1:n]
    start = np.zeros(n, bool)
    start |= word
    start[1:] &= ~(word[1:] & word[:-1] & prev_same[1:])
    rep = np.zeros(n, bool)
    rep[1:] = sign[1:] & (cp[1:] == cp[:-1]) & prev_same[1:]
    start |= sign & ~rep
    # Of white space only its line breaks are a symbol, one for each stretch.
    line = newline.copy()
    line[1:] &= ~(newline[:-1] & prev_same[1:])
    start |= line
    at = np.flatnonzero(start)
    m = len(at)
    if m == 0:
        return empty.astype(np.uint16), empty, np.zeros(len(rows), np.int64)
    end = np.append(at[1:], n)
    out = np.empty(m, np.uint16)
    is_word = word[at]
    out[~is_word] = np.where(newline[at[~is_word]], LINE, signs[cp[at[~is_word]]])
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    solid = count(~white & (kind != 7))
    chars = solid[end] - solid[at]
    w = at[is_word]
    wend = np.append(at[1:], n)[is_word]
    body = count(word)
    wlen = body[wend] - body[w]
    wend = w + wlen
    low = lower[cp]
    upper = (low != cp) & (kind == bpe.LETTER)
    letter = kind == bpe.LETTER
    dots = np.zeros(n, bool)
    if n > 4:
        dots[2:-2] = inner[2:-2] & (cp[2:-2] == 46) & letter[1:-3] & letter[3:-1] & letter[:-4] & letter[4:]
    # What a word's characters are, summed in fields of one number: letters, digits, capitals, Cyrillic, Latin, dots.
    place = _runs(w, wlen)
    edges = np.cumsum(wlen) - wlen
    cps, is_letter = cp[place], letter[place]
    fields = (is_letter, kind[place] == bpe.NUMBER, upper[place], (cps >= 0x400) & (cps < 0x530), is_letter & (cps < 0x250), dots[place])
    nl, nd, nu, nc, na, ndots = (np.add.reduceat(f.astype(np.int32), edges) if len(w) else np.zeros(0, np.int32) for f in fields)
    kind_of = np.full(len(w), WORD_KINDS.index("other script"), np.int64)
    plain = nl > 0
    latin_word, cyr_word = plain & (na * 2 > nl), plain & (nc * 2 > nl)
    first_up = upper[w]
    kind_of[latin_word & (wlen < LONG_WORD)] = 0
    kind_of[latin_word & (wlen >= LONG_WORD)] = 1
    kind_of[latin_word & first_up] = 2
    kind_of[latin_word & (nu * 2 > nl) & (nl > 1)] = 3
    kind_of[cyr_word] = np.where(first_up[cyr_word], 5, 4)
    kind_of[(nd > 0) & plain & first_up] = 7
    kind_of[(nd > 0) & plain & ~first_up] = 9
    kind_of[(nd > 0) & ~plain] = 8
    kind_of[ndots > 0] = 10
    # Polynomial hashes of the lower-case words.
    power = bpe._powers(_MULT, int(wlen.max(initial=1)) + 1)
    flat = np.repeat(wend - 1, wlen) - place
    h = np.zeros(len(w), np.uint64)
    if len(w):
        vals = (low[place].astype(np.uint64) + np.uint64(1)) * power[flat]
        h = np.add.reduceat(vals, edges)
    known, ids = _word_ids()
    k = np.minimum(np.searchsorted(known, h), len(known) - 1)
    func = known[k] == h
    row_of = np.searchsorted(row_at, w, "right")
    # The row goes into the key, so that repeats don't reach over rows.
    key = h ^ (row_of.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    gap = np.full(len(w), REPEAT_WITHIN + 1)
    if len(w) > 1:
        gap[order[1:]] = np.where(key[order][1:] == key[order][:-1], np.diff(order), REPEAT_WITHIN + 1)
    near = (gap <= REPEAT_WITHIN) & (kind_of != 8)
    out[is_word] = np.where(func, ids[k], np.where(near & (gap <= 2), ECHO, np.where(near, _REP0, _KIND0) + kind_of))
    return out, chars, np.searchsorted(at, row_at)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def segments(sym: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """First symbol of each segment: rows are cut after line breaks and sentence ends, if ``least`` symbols long."""
    m = len(sym)
    if m == 0:
        return np.zeros(0, np.int64)
    cut = np.zeros(m + 1, bool)
    cut[1:] = np.isin(sym, _ENDS) | (sym == LINE)
    row = np.zeros(m + 1, bool)
    row[first] = True
    places = np.flatnonzero((cut | row)[:m])
    if not len(places) or places[0] != 0:
        places = np.concatenate([[0], places])
    # Short segments go together with the next ones of their row, by running length.
    size = np.diff(np.append(places, m))
    is_row = row[places]
    is_row[0] = True
    group = np.cumsum(is_row) - 1
    run = np.cumsum(size) - size
    base = run[is_row][group]
    keep = is_row | ((size >= least) | (np.append([least], size[:-1]) >= least)) | ((run - base) // least != np.append([0], (run - base)[:-1]) // least)
    return places[keep]


def context(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code of each symbol with the two before it in its row."""
    s = sym.astype(np.int64)
    one, two = np.roll(s, 1), np.roll(s, 2)
    for k in (0, 1):
        f = first + k
        f = f[f < len(s)]
        two[f] = PAD
    f = first[first < len(s)]
    one[f] = PAD
    return (two * SYMBOLS + one) * SYMBOLS + s


def bits(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of every trigram (a dense table of eighths of a bit, as bytes) from trigram counts, by Witten-Bell smoothing."""
    a, bc = codes // (SYMBOLS * SYMBOLS), codes % (SYMBOLS * SYMBOLS)
    b, c = bc // SYMBOLS, bc % SYMBOLS
    n = counts.astype(np.float64)
    uni = np.bincount(c, n, SYMBOLS)
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * SYMBOLS)
    two = np.bincount(bc, n, SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS)
    kinds, total = (two > 0).sum(1), two.sum(1)
    p2 = (two + (kinds + 1)[:, None] * p1) / (total + kinds + 1)[:, None]
    ab = a * SYMBOLS + b
    total3, kinds3 = np.bincount(ab, n, SYMBOLS * SYMBOLS), np.bincount(ab, minlength=SYMBOLS * SYMBOLS)
    out = np.empty((SYMBOLS * SYMBOLS, SYMBOLS), np.uint8)
    seen: dict = {}
    order = np.argsort(ab, kind="stable")
    edges = np.flatnonzero(np.diff(np.append(-1, ab[order])))
    for lo, hi in zip(edges, np.append(edges[1:], len(order))):
        seen[int(ab[order[lo]])] = order[lo:hi]
    quant = lambda p: np.minimum(255, np.round(-8 * np.log2(p))).astype(np.uint8)
    plain = quant(p2)
    for x in range(SYMBOLS):
        out[x * SYMBOLS : (x + 1) * SYMBOLS] = plain
    for k, at in seen.items():
        p = (kinds3[k] + 1) * p2[k % SYMBOLS]
        p[c[at]] += n[at]
        out[k] = quant(p / (total3[k] + kinds3[k] + 1))
    return out.ravel()
