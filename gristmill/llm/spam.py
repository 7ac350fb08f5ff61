"""Keyword-stuffed pages, link lists and product lists, told from prose by a word-class trigram model."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrow import row_chunks, text_bytes
from gristmill.llm import bpe
from gristmill.llm import wordclass as wc
from gristmill.session import materialize

#: Symbols from which a sentence or line is scored on its own; shorter ones go together.
LEAST_SYMBOLS = 6
#: A segment isn't prose if its bits a symbol are further from the model's mean on prose than so many standard
#: errors of a mean over as many symbols, and by so many bits at least.
SIGMAS, LEAST_GAP = 3.5, 1.0
#: Measured share of characters outside prose from which a page is spam: above one half, as a part of true prose scores high too.
SPAM_SHARE = 0.6
#: Words up to which a first segment is taken for a title, which isn't spam.
TITLE_WORDS, TITLE_REPEATS = 14, 2
_ODD = np.array([wc._SIGN0 + wc.SIGNS.index(c) for c in "#|/•*_"] + [wc._KIND0 + 10])
_LAYOUT = re.compile(r"</?(?:br|p|i|b|em|strong|sub|sup|span|div)\b[^<>]*>", re.I)
_SENTENCE_END = np.array([wc._SIGN0 + wc.SIGNS.index(c) for c in ".?"])


@dataclass
class Model:
    """Eighths of a bit of each trigram of symbols, and mean and standard deviation of a symbol's bits in prose."""

    table: np.ndarray
    mean: float
    sd: float


def _segments(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seg = wc.segments(sym, first, LEAST_SYMBOLS)
    return seg, np.diff(np.append(seg, len(sym))), np.searchsorted(first, seg, "right") - 1


def prose_segments(sym: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which symbols belong to sentences that the model is trained on.

    A seed is a sentence with function words among its words, without links or list signs and with few
    repeated words.  Of texts at least half of which is seeds, all plain sentences are used.
    """
    seg, size, row = _segments(sym, first)
    if not len(seg):
        return np.zeros(0, bool)
    total = lambda mask: np.add.reduceat(mask.astype(np.int32), seg)
    func, word = total(sym >= wc._WORD0), total(sym >= wc._KIND0)
    again = total((sym >= wc._REP0) & (sym < wc._WORD0))
    odd = total(np.isin(sym, _ODD))
    end = seg + size - 1
    last = np.where((sym[end] == wc.LINE) & (size > 1), sym[np.maximum(end - 1, 0)], sym[end])
    plain = np.isin(last, _SENTENCE_END) & (odd == 0)
    seed = plain & (word >= 6) & (func >= 2) & (func * 6 >= word) & (again * 4 <= word)
    weight = np.add.reduceat(chars, seg)
    n = len(first)
    share = np.bincount(row, weight * seed, n) / np.maximum(np.bincount(row, weight, n), 1)
    return np.repeat(plain & (word >= 3) & (share[row] >= 0.5), size)


def spam_shares(sym: np.ndarray, chars: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Share of the characters of each row in segments of abnormal perplexity; its title is none."""
    n = len(first)
    seg, size, row = _segments(sym, first)
    if not len(seg):
        return np.zeros(n)
    total = np.add.reduceat(model.table[wc.context(sym, first)].astype(np.float64), seg) / 8
    word = np.add.reduceat((sym >= wc._KIND0).astype(np.int32), seg)
    again = np.add.reduceat(((sym >= wc._REP0) & (sym < wc._WORD0)).astype(np.int32), seg)
    title = np.isin(seg, first) & (word <= TITLE_WORDS) & (again <= TITLE_REPEATS)
    weight = np.add.reduceat(chars, seg)
    gap, limit = np.abs(total / size - model.mean), lambda n: np.maximum(LEAST_GAP, SIGMAS * model.sd / np.sqrt(n))
    off = gap > limit(size)
    # A short segment says little; with the ones before and after it, it may say enough.
    three_bits, three_size = total.copy(), size.copy()
    for a, b in ((np.s_[1:], np.s_[:-1]), (np.s_[:-1], np.s_[1:])):
        same = row[a] == row[b]
        three_bits[a] += total[b] * same
        three_size[a] += size[b] * same
    off |= (gap > LEAST_GAP) & (np.abs(three_bits / three_size - model.mean) > limit(three_size))
    return np.bincount(row, weight * (off & ~title), n) / np.maximum(np.bincount(row, weight, n), 1)


def plain_text(column: pa.Array) -> pa.Array:
    """Texts with character references replaced and without tags of mere layout; links stay."""
    marked = pc.fill_null(pc.or_(pc.match_substring(column, "&"), pc.match_substring(column, "<")), False)
    if not pc.any(marked).as_py():
        return column
    clean = [_LAYOUT.sub(" ", html.unescape(t)) for t in column.filter(marked).to_pylist()]
    return pc.replace_with_mask(column, marked, pa.array(clean, column.type))


def _word_classes(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Each row's symbols, in numbers of two bytes, and the characters of each, in numbers of four."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, rows = text_bytes(plain_text(batch.column(1)))
            for lo, hi in row_chunks(rows, bpe.CHUNK_BYTES):
                sym, chars, first = wc.symbols(data[rows[lo] : rows[hi]], rows[lo : hi + 1] - rows[lo])
                keep = prose_segments(sym, chars, first[:-1])
                codes, counts = np.unique(wc.context(sym, first[:-1])[keep], return_counts=True) if keep.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                both = [sym.astype("<u2"), chars.astype("<u4")]
                cols = [pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((first * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())]) for x in both]
                # The chunk's trigram counts ride on its first row.
                lists = [pa.ListArray.from_arrays(pa.array([0] + [len(codes)] * (hi - lo), pa.int32()), pa.array(x.astype(np.int64))) for x in (codes, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols, *lists], names=["id", "sym", "chars", "codes", "counts"])

    schema = f"id {kind}, sym binary, chars binary, codes array<bigint>, counts array<bigint>"
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, schema)


def model_of(codes: np.ndarray, counts: np.ndarray) -> Model:
    table = wc.bits(codes, counts)
    own, n = table[codes] / 8.0, max(1, counts.sum())
    mean = float((own * counts).sum() / n)
    return Model(table, mean, float(np.sqrt(((own - mean) ** 2 * counts).sum() / n)))


def train_prose(classes: DataFrame) -> Model:
    """The model from the counts of all texts; at most one number for each trigram of symbols reaches the driver."""
    pairs = classes.where("size(codes) > 0").select(F.explode(F.arrays_zip("codes", "counts")).alias("p"))
    got = pairs.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.counts").alias("n")).toPandas()
    return model_of(got["code"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


def score_spam(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spam_share) of each row: the share of its text that isn't prose by the model.

    Texts become sequences of function words and word classes; a trigram model over them is trained on
    the prose sentences of all texts; a sentence or line whose bits a symbol are far above or below those
    of prose isn't prose.  The classes are written once to the shared folder, then counted and scored.
    Null, empty and blank texts and mere titles score 0.  Repeated rows are scored each; a table
    without prose is scored by the untrained model, an empty table gives an empty table.
    """
    classes = materialize(_word_classes(df, id_col, text), "classes")
    shared = df.sparkSession.sparkContext.broadcast(train_prose(classes))  # SYMBOLS ** 3 bytes whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            _, rows = text_bytes(batch.column(1))
            for lo, hi in row_chunks(rows, bpe.CHUNK_BYTES):
                part = batch.slice(lo, hi - lo)
                sym, ends = text_bytes(part.column(1))
                chars, _ = text_bytes(part.column(2))
                share = spam_shares(sym.view("<u2"), chars.view("<u4").astype(np.int64), ends[:-1] // 2, model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(share)], names=[id_col, "spam_share"])

    kind = classes.schema["id"].dataType.simpleString()
    return classes.select("id", "sym", "chars").mapInArrow(run, f"`{id_col}` {kind}, spam_share double")


def find_spam(df: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = SPAM_SHARE) -> DataFrame:
    """Ids of rows most of whose text is keywords, search phrases, links or lists; see score_spam."""
    return score_spam(df, id_col, text).where(F.col("spam_share") > share).select(id_col)
