"""Loading CSV records and setting apart, with a reason, those that can't be loaded."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A record whose quotes are in order: fields are quoted as a whole, inner quotes doubled, or hold no quote.
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
_QUOTED_WELL = re.compile(f"{_FIELD}(?:,{_FIELD})*")
_DIGITS = re.compile("[0-9]+")
_NUMBERS = re.compile(r"\[ *(?:[0-9]+ *(?:, *[0-9]+ *)*)?\]")
_BAD_CHAR = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f�]")
_BIGINT = 1 << 63


class BadValue(ValueError):
    """A field that its constructor refuses."""


def assemble(line: str) -> tuple[str, tuple[str, str] | None]:
    """The record as one line: line breaks within it become two characters that it doesn't hold.

    CR and LF at the very end belong to no field.  The reader would end a record, or refuse it, at a
    line break outside quotes, but such a break is part of its field here.
    """
    body = line.rstrip("\r\n")
    if "\n" not in body and "\r" not in body:
        return body, None
    free = (c for c in map(chr, range(0xE000, 0xF8FF)) if c not in body)
    lf, cr = next(free), next(free)
    return body.replace("\n", lf).replace("\r", cr), (lf, cr)


def parse(line: str) -> list[str]:
    """The fields of one record by the strict CSV reader; csv.Error if its quoting is broken."""
    body, marks = assemble(line)
    fields = next(csv.reader([body], strict=True), None) or [""]
    if '"' in body and not _QUOTED_WELL.fullmatch(body):
        raise csv.Error("a quote within a field that isn't quoted")
    if marks:
        fields = [f.replace(marks[0], "\n").replace(marks[1], "\r") for f in fields]
    return fields


def _int(text: str) -> int | None:
    digits = text.lstrip("0") or "0"
    value = int(digits) if len(digits) < 20 else _BIGINT
    return value if value < _BIGINT else None


def whole_number(text: str) -> int | None:
    text = text.strip(" ")
    if not _DIGITS.fullmatch(text):
        raise BadValue(text)
    return _int(text)


def whole_number_or_empty(text: str) -> int | None:
    return whole_number(text) if text.strip(" ") else None


def sentence(text: str) -> str:
    if _BAD_CHAR.search(text) or not any(c.isalpha() for c in text):
        raise BadValue(text)
    return text.strip(" ")


def number_list(text: str) -> list[int | None]:
    text = text.strip(" ")
    if not _NUMBERS.fullmatch(text):
        raise BadValue(text)
    return [_int(x) for x in _DIGITS.findall(text)]


def one_of(labels: frozenset[str]) -> Callable[[str], str | None]:
    def label(text: str) -> str | None:
        text = text.strip(" ")
        if text and text not in labels:
            raise BadValue(text)
        return text or None

    return label


#: A record's fields: name, type, constructor.
Fields = list[tuple[str, T.DataType, Callable]]


def claim_fields(labels: list[str]) -> Fields:
    """The six columns of the claims feed."""
    return [
        ("id", T.LongType(), whole_number),
        ("claim", T.StringType(), sentence),
        ("evidence_doc_id", T.LongType(), whole_number_or_empty),
        ("evidence_label", T.StringType(), one_of(frozenset(labels))),
        ("evidence_sentences", T.ArrayType(T.LongType()), number_list),
        ("cited_doc_ids", T.ArrayType(T.LongType()), number_list),
    ]


def load_record(line: str | None, fields: Fields) -> tuple[str | None, list]:
    """Reason, or None, and values of a record; structure is judged before any value."""
    nothing = [None] * len(fields)
    if line is None:
        return "columns", nothing
    try:
        got = parse(line)
    except csv.Error:
        return "quoting", nothing
    if len(got) != len(fields):
        return "columns", nothing
    try:
        return None, [make(text) for text, (_, _, make) in zip(got, fields)]
    except BadValue:
        return "value", nothing


def too_large(line: str, values: list, fields: Fields) -> str | None:
    """The names of a loaded record's fields in which a number exceeds BIGINT, separated by commas, or None."""
    lost = [k for k, v in enumerate(values) if isinstance(v, list) and None in v or v is None and isinstance(fields[k][1], T.LongType)]
    if lost:
        got = parse(line)
        lost = [k for k in lost if got[k].strip(" ")]
    return ",".join(fields[k][0] for k in lost) or None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, nth, line): the records of CSV files, each assembled from its physical lines.

    A line break within quotes belongs to the record.  Whether a block of a file begins within quotes is known
    from the number of quotes in the blocks before it, which are counted first, so all blocks are read in
    parallel; only records that cross a block's end are put together by a shuffle.  ``start`` is the offset of
    the block in which the record begins and ``nth`` its place there.  A quote that is never closed
    runs to the end of its file, as one record.  One bit for each block reaches the tasks.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "start").agg(quotes.alias("quotes")).withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    within = spark.sparkContext.broadcast({(r.file, r.start) for r in blocks.where("odd").select("file", "start").toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "start", "nth", "line", "begun", "ended"]
        block, nth, held, begun = None, 0, [], True

        for batch in batches:
            rows = []
            for line, file, start in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != block:
                    if held:
                        rows.append((*block, nth, "\n".join(held), begun, False))
                    block, nth, held, begun = (file, start), 0, [], True
                    quoted = block in within.value
                    begun = not quoted
                held.append(line)
                quoted ^= bool(line.count('"') & 1)
                if not quoted:
                    rows.append((*block, nth, "\n".join(held), begun, True))
                    nth, held, begun = nth + 1, [], True
            yield _records(rows, names)
        if held:
            yield _records([(*block, nth, "\n".join(held), begun, False)], names)

    parts = lines.mapInArrow(run, "file string, start bigint, nth bigint, line string, begun boolean, ended boolean")
    whole = parts.where("begun and ended").select("file", "start", "nth", "line")
    # The pieces of records across blocks, at most two of each block, in order: a piece that begins one opens a group.
    order = Window.partitionBy("file").orderBy("start", "nth")
    pieces = parts.where("not (begun and ended)").withColumn("record", F.sum(F.col("begun").cast("int")).over(order))
    joined = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "nth", "line"))).alias("p"))
    crossing = joined.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["nth"].alias("nth"), F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("line"))
    return whole.unionByName(crossing)


def _records(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def load_records(df: DataFrame, fields: Fields, line: str = "line", keep: list[str] | None = None, want: str = "all", beyond: str | None = None) -> DataFrame:
    """The columns ``keep``, the reason why a record failed or null, and its typed fields (null if it failed).

    ``want`` is 'all', 'loaded' (without reason) or 'failed' (without fields).  With ``beyond``, a column of that
    name holds the names of the fields in which a number exceeds BIGINT, in order, or null.  Reasons: 'quoting',
    'columns' (not as many as ``fields``), 'value'; the first that holds.  A narrow map over Arrow
    batches: each record is parsed once where it is read.  A null line has no columns; an empty one has
    one.  Numbers beyond BIGINT are valid and load as null.  Repeated records are loaded each; fields of
    any length are parsed; columns kept must not be named like a field or 'reason'.
    """
    keep = ["line_no"] if keep is None else list(keep)
    names = [] if want == "failed" else [n for n, _, _ in fields]
    extra = [beyond] if beyond and names else []
    out = [*keep, *([] if want == "loaded" else ["reason"]), *names, *extra]
    if len(set(map(str.lower, out))) < len(out):
        raise ValueError("a column to be kept is named like a field")
    schema = T.StructType([*(df.schema[c] for c in keep), *([] if want == "loaded" else [T.StructField("reason", T.StringType())]), *(T.StructField(n, t) for n, t, _ in fields if n in names), *(T.StructField(n, T.StringType()) for n in extra)])
    kinds = {T.LongType: pa.int64(), T.StringType: pa.string(), T.ArrayType: pa.list_(pa.int64())}
    types = [kinds[type(t)] for _, t, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            done = [load_record(x, fields) for x in batch.column(len(keep)).to_pylist()]
            mask = pa.array([want == "all" or (r is None) == (want == "loaded") for r, _ in done], pa.bool_())
            cols = [batch.column(k) for k in range(len(keep))]
            if want != "loaded":
                cols.append(pa.array([r for r, _ in done], pa.string()))
            if names:
                cols += [pa.array([v[k] for _, v in done], types[k]) for k in range(len(fields))]
            if extra:
                cols.append(pa.array([too_large(line, v, fields) if r is None else None for line, (r, v) in zip(batch.column(len(keep)).to_pylist(), done)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=out).filter(mask)

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{line}`").cast("string").alias("__line")).mapInArrow(run, schema)
