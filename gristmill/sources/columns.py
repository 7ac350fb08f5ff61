"""Named columns of CSV files with a header."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.text import trim_blank


class MissingColumn(ValueError):
    """The file's header lacks a column."""


def parse_line(line: str) -> list[str]:
    """Fields of one line: commas outside quotes cut; a quote may open within a field; '""' inside quotes is one quote.

    An open quote ends with the line.
    """
    fields, out, quoted, k = [], [], False, 0
    while k < len(line):
        c = line[k]
        if c == '"' and quoted and line[k + 1 : k + 2] == '"':
            out.append(c)
            k += 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            fields.append("".join(out))
            out = []
        else:
            out.append(c)
        k += 1
    return [*fields, "".join(out)]


def _bare(text: str) -> str:
    return text.strip("".join(map(chr, range(33))))


def column_index(header: list[str], name: str) -> int:
    """Place of a column, whatever its case and outer blanks; -1 if it isn't there."""
    wanted = _bare(name).lower()
    return next((k for k, h in enumerate(header) if _bare(h).lower() == wanted), -1)


def parse_lines(df: DataFrame, line: str, out: str = "fields") -> DataFrame:
    """``df`` with an array of the fields of each line, by parse_line; null for null."""
    if out in df.columns:
        raise ValueError(f"there is a column {out!r} already")
    at = df.columns.index(line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [None if x is None else parse_line(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.string()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))]))


def read_columns(spark: SparkSession, path: str, key: str, value: str | None = None, strict: bool = True) -> DataFrame:
    """(key, value), or (key), of a CSV file or folder of files with one header: trimmed, rows with an empty key left out.

    The first line of each file is its header, and only that: a later line that repeats it is data.
    ``strict`` parses each line as parse_line does: lines too short for the wanted columns are left out,
    empty values are ''.  Without it Spark's CSV reader is used, which is faster on wide files and differs
    in two ways: a quote within a field is text, and a missing value counts as ''.  A record is one
    line.  A file without lines gives no rows, an unknown column raises MissingColumn.
    """
    lines = spark.read.text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    first = lines.where("start = 0").first()
    names = ["key"] + (["value"] if value is not None else [])
    schema = ", ".join(f"{n} string" for n in names)
    if first is None:
        return spark.createDataFrame([], schema)
    header = parse_line(first[0].removeprefix("\ufeff"))
    places = [column_index(header, n) for n in ([key] if value is None else [key, value])]
    for n, k in zip((key, value), places):
        if k < 0:
            raise MissingColumn(f"no column {n!r}")
    if strict:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begun: set[int] = set()  # files whose first line this task has seen; a split's lines come in order
            for batch in batches:
                rows = []
                for line, file, start in zip(*(c.to_pylist() for c in batch.columns)):
                    if start == 0 and file not in begun:
                        begun.add(file)
                        continue
                    got = parse_line(line)
                    if len(got) > max(places) and (k := _bare(got[places[0]])):
                        rows.append((k, *(_bare(got[p]) for p in places[1:])))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(len(names))], names=names)

        return lines.mapInArrow(run, schema)
    fields = ", ".join(f"c{k} string" for k in range(len(header)))
    raw = spark.read.csv(path, header=True, schema=fields, escape='"', enforceSchema=True)
    cols = [trim_blank(F.col(f"c{k}")).alias(n) for k, n in zip(places, names)]
    return raw.select(*cols).where("key <> ''").select("key", *(F.coalesce(n, F.lit("")).alias(n) for n in names[1:]))


def csv_line(*values: Column) -> Column:
    """One line of CSV: every value in quotes, inner quotes doubled, null as an empty value, line breaks as blanks."""
    return F.concat_ws(",", *(F.concat(F.lit('"'), F.regexp_replace(F.replace(F.coalesce(v.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), "[\r\n]", " "), F.lit('"')) for v in values))


def document_text(title: Column, body: Column) -> Column:
    """Title, a blank and body; null parts count as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))
