"""Several values packed in one field: one row for each value, with its position."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs that may separate values.
CANDIDATES = [",", ";", "|", "/", "\t", "\n", "\r", " ", ":", "&", "+", "-", ".", "_", "*", "#"]
#: Least score of a delimiter: where it stands, more pieces are values than not.
LEAST_SCORE = 0.5
# A text in quotes; a straight quote is doubled inside.  Where no closing quote follows, the last doubled one closes,
# as if its second half stood alone.  Repetitions are possessive, which Java matches without recursion, whatever
# the length.
_STRAIGHT = r"""Q[^Q]*+(?:QQ[^Q]*+)*+Q|Q[\s\S]*Q(?=Q[^Q]*\z)"""
_QUOTED = "|".join((_STRAIGHT.replace("Q", '"'), _STRAIGHT.replace("Q", "'"), "“[^”]*+”"))
_QUOTES = "\"'“”"
_BRACKETS = r"\[\](){}"


@dataclass(frozen=True)
class Field:
    """A packed column; ``quoted``: texts in quotes are values too, else only runs of digits are."""

    name: str
    quoted: bool = False


def _bare(value: Column, field: Field) -> Column:
    """The value without outer brackets and with each quoted text as one letter (or without quotes)."""
    inner = F.regexp_replace(value, _QUOTED, "Q") if field.quoted else F.regexp_replace(value, f"[{_QUOTES}]", "")
    return F.regexp_replace(inner, f"[{_BRACKETS}]", "")


def infer_delimiters(df: DataFrame, fields: list[Field], source: str | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """(source, field, delimiter, rows, consistency, regularity, score, accepted) of each candidate that occurs.

    For each source (each field, or each field of each value of ``source``) a candidate is judged by splitting
    the rows in which it is the only candidate (blanks beside it don't count), over the whole table.
    ``regularity`` is the mean share of a row's pieces that are of one type, a number or a quoted text;
    ``consistency`` the share of rows in which there are as many pieces as numbers and quoted texts, so that
    the sign stands between values and nowhere else.  The score is their mean.  A candidate that never
    stands alone is judged by the rows in which it stands with others, split at all of them.
    """
    where = F.lit("") if source is None else F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows = df.select(where.alias("source"), F.explode(F.array(*(F.struct(F.lit(f.name).alias("field"), _bare(F.col(f"`{f.name}`"), f).alias("v")) for f in fields))).alias("x"))
    rows = rows.where("x.v is not null").select("source", "x.field", F.regexp_replace("x.v", r"^\s+|\s+\z", "").alias("v"))
    every = "[" + "".join(re.escape(c) for c in CANDIDATES) + "]"

    # Step by step, so that each text is matched once for each candidate in it.
    long = rows.where(F.col("v").rlike(every)).select("source", "field", "v", F.explode(F.filter(F.array(*map(F.lit, CANDIDATES)), lambda d: F.contains(F.col("v"), d))).alias("delimiter"))
    around = F.when(F.trim(F.translate("delimiter", "\t\n\r", "   ")) == "", F.concat(F.lit(r"\Q"), "delimiter", F.lit(r"\E+"))).otherwise(F.concat(F.lit(r"\s*\Q"), "delimiter", F.lit(r"\E\s*")))
    long = long.withColumn("tight", F.regexp_replace("v", around, F.col("delimiter")))
    long = long.withColumn("alone", ~F.replace("tight", F.col("delimiter"), F.lit("")).rlike(every))
    split = F.when(F.col("alone"), F.split("tight", F.concat(F.lit(r"\Q"), "delimiter", F.lit(r"\E")))).otherwise(F.split("v", F.lit(every)))
    long = long.withColumn("pieces", F.filter(split, lambda p: p != ""))
    good = F.size(F.filter("pieces", lambda p: p.rlike(r"^(?:[0-9]+|Q)\z")))
    values = F.size(F.regexp_extract_all(F.col("v"), F.lit("[0-9]+|Q"), F.lit(0)))
    long = long.select("source", "field", "delimiter", "alone", (good / F.greatest(F.size("pieces"), F.lit(1))).alias("r"), (values == F.size("pieces")).cast("double").alias("c"))
    by = long.groupBy("source", "field", "delimiter", "alone").agg(F.count("*").alias("rows"), F.avg("c").alias("consistency"), F.avg("r").alias("regularity"))
    best = by.groupBy("source", "field", "delimiter").agg(F.max(F.struct("alone", "rows", "consistency", "regularity")).alias("x")).select("source", "field", "delimiter", "x.rows", "x.consistency", "x.regularity")
    return best.withColumn("score", (F.col("consistency") + F.col("regularity")) / 2).withColumn("accepted", F.col("score") >= least)


def pieces_of(value: Column, field: Field, delimiters: list[str]) -> Column:
    """The field's pieces in order, as (item, clean): split at the delimiters outside quotes, without brackets and outer blanks.

    A piece is clean if it is a whole number or, in a field of quoted texts, one text in quotes, which comes out
    without them.  What is neither, as the row uses a sign that isn't among the delimiters, isn't clean.
    Blank pieces are none.
    """
    cut = "".join(re.escape(d) for d in delimiters)
    run = f"[^{cut}{_QUOTES}{_BRACKETS}]+"
    found = F.regexp_extract_all(value, F.lit(f"{_QUOTED}|{run}" if field.quoted else run), F.lit(0))

    def typed(p: Column) -> Column:
        plain = F.regexp_replace(p, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")
        item, clean = plain, plain.rlike(r"^[0-9]+\z")
        if field.quoted:
            first, body = F.substring(p, 1, 1), p.substr(F.lit(2), F.length(p) - 2)
            quoted = first.isin('"', "'", "“")
            item = F.when(first == '"', F.replace(body, F.lit('""'), F.lit('"'))).when(first == "'", F.replace(body, F.lit("''"), F.lit("'"))).when(first == "“", body).otherwise(plain)
            clean = quoted | clean
        return F.struct(item.alias("item"), clean.alias("clean"))

    return F.filter(F.transform(found, typed), lambda x: x["clean"] | (x["item"] != ""))


def searched(pieces: Column) -> Column:
    """The same with the runs of digits of each piece that isn't clean in its place."""
    digits = lambda x: F.transform(F.regexp_extract_all(x["item"], F.lit("[0-9]+"), F.lit(0)), lambda d: F.struct(d.alias("item"), F.lit(True).alias("clean")))
    return F.flatten(F.transform(pieces, lambda x: F.when(x["clean"], F.array(x)).otherwise(digits(x))))


def unpack(df: DataFrame, fields: list[Field], id_col: str = "id", order: str | None = None, source: str | None = None, delimiters: dict[str, list[str]] | None = None, unclean: str = "search") -> DataFrame:
    """(id, field, pos, item): one row for each value of each field, positions from 1.

    Delimiters are inferred for each source over the whole table (or given for each field), then each row is
    split at them outside quotes; what stands between two of them is one piece, whatever it holds.  Pieces that
    are no value, as their row uses a sign that isn't a delimiter, are searched for numbers; with
    ``unclean='flag'`` they come out as they are, with a null position and false in a further column ``clean``,
    and only what the split gave is a value.  Nulls, blank values and empty lists give no row; repeated
    values keep their positions.  Of several rows of one id the first by ``order`` counts; without ``order``,
    equal rows count once and each different row of an id is unpacked.  Rows without an id come out
    with a null id.  Only as many delimiters as there are sources and candidates reach the driver; there may
    be at most 10,000 sources.
    """
    if unclean not in ("search", "flag"):
        raise ValueError("unclean is 'search' or 'flag'")
    by: dict[tuple[str, str], list[str]] = {}
    if delimiters is None:
        found = infer_delimiters(df, fields, source).where("accepted").select("source", "field", "delimiter").limit(10_000 * len(fields) * len(CANDIDATES) + 1).collect()
        for r in sorted(found):
            by.setdefault((r.source, r.field), []).append(r.delimiter)
        if len({s for s, _ in by}) > 10_000:
            raise ValueError("too many sources")
    else:
        by, source = {("", f): list(d) for f, d in delimiters.items()}, None
    cols = [F.col(f"`{f.name}`") for f in fields]
    rows = df.select(F.col(f"`{id_col}`").alias("id"), (F.lit("") if source is None else F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("__source"), *cols, *([F.col(order).alias("__order")] if order else []))
    if order:
        first = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("__order", "__source", *cols)).alias("x")).select("id", "x.__source", *(F.col(f"x.`{f.name}`").alias(f.name) for f in fields))
        rows = first.unionByName(rows.where("id is null").drop("__order"))
    else:
        rows = rows.distinct()
    parts = []
    for f, c in zip(fields, cols):
        sets: dict[tuple[str, ...], list[str]] = {}
        for s in {s for s, _ in by} or {""}:
            sets.setdefault(tuple(by.get((s, f.name), [])), []).append(s)
        most = max(sets, key=lambda k: len(sets[k]))
        got = pieces_of(c, f, list(most))
        for k, names in sets.items():
            if k != most:
                got = F.when(F.col("__source").isin(names), pieces_of(c, f, list(k))).otherwise(got)
        parts.append(F.struct(F.lit(f.name).alias("field"), (searched(got) if unclean == "search" else got).alias("items")))
    long = rows.select("id", F.explode(F.array(*parts)).alias("x"))
    nth = lambda items, name: items.select("id", "x.field", F.posexplode(name).alias("p", "v")).select("id", "field", (F.col("p") + 1).cast("long").alias("pos"), "v.item", "v.clean")
    if unclean == "search":
        return nth(long, "x.items").drop("clean")
    # Values first, with their positions; pieces that are none take no position.
    values = nth(long, F.filter("x.items", lambda v: v["clean"]))
    rest = nth(long, F.filter("x.items", lambda v: ~v["clean"])).withColumn("pos", F.lit(None).cast("long"))
    return values.unionByName(rest)
