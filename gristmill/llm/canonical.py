"""Records that are the same but for formatting, by bottom-up hashes of their structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import ALNUM, fold
from gristmill.session import materialize

# Names that begin the fields of a labelled record.
FIELD_NAMES = ["population", "exposure", "comparator", "outcome", "direction"]
SEPARATORS = "[;|]"


def field_texts(text: Column, names: list[str] | None = None, separators: str = SEPARATORS) -> Column:
    """The fields of a labelled record as an array, else null.

    A record is labelled if it has two or more parts with a letter or digit and each begins, after any
    other signs, with a field's name, optional white space and ':' or '='.
    """
    one_of = "|".join(names or FIELD_NAMES)
    parts = F.filter(F.split(text, separators), lambda p: p.rlike(ALNUM))
    named = F.forall(parts, lambda p: p.rlike(rf"^[^\p{{L}}\p{{N}}]*(?i:{one_of})[\s\p{{Z}}]*[:=]"))
    return F.when((F.size(parts) >= 2) & named, parts)


def digests(df: DataFrame, id_col: str, text: Column, names: list[str] | None = None) -> DataFrame:
    """(id, root, canon): the root digest of each record's structure, and the normal form that it stands for.

    A labelled record is a node: its folded fields are leaves, and the leaves' digests are sorted, as the
    order of fields doesn't count, and hashed again.  Any other record is one leaf, its folded text.
    ``canon`` holds the normalised leaves, for the full comparison; the kind of root is part of it.  Of
    several texts of one id the smallest counts.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("t")).where("id is not null and t is not null").groupBy("id").agg(F.min("t").alias("t"))
    rows = rows.select("id", fold(F.col("t")).alias("flat"), field_texts(F.col("t"), names).alias("parts")).where("flat <> ''")
    node = F.col("parts").isNotNull()
    canon = F.when(node, F.concat(F.array(F.lit("node")), F.array_sort(F.transform("parts", fold)))).otherwise(F.array(F.lit("leaf"), F.col("flat")))
    rows = rows.select("id", canon.alias("canon"))
    below = F.transform(F.slice("canon", 2, F.size("canon") - 1), lambda x: F.md5(x.cast("binary")))
    return rows.select("id", F.md5(F.concat_ws("", F.element_at("canon", 1), F.array_sort(below)).cast("binary")).alias("root"), "canon")


def same_records(df: DataFrame, id_col: str = "id", text: str = "claim", names: list[str] | None = None) -> DataFrame:
    """(id, keep_id) of every record that has a letter or digit; keep_id is the smallest id of its group.

    Records are the same if their root digests are equal and so are their normal forms: labelled records by
    their folded fields in any order, each as often, all others by their folded text.  A labelled record
    and one that has lost a separator, and with it a field, aren't the same, though their letters are.
    Records are reduced by digest and form before the shuffle, so a form with very many copies is one row
    of each task; digests that two forms share are told apart by the forms.  An id that comes more than
    once counts once; null and blank texts take no part; an empty table gives an empty table.
    """
    rows = materialize(digests(df, id_col, F.col(f"`{text}`"), names), "digests")
    forms = rows.groupBy("root", "canon").agg(F.min("id").alias("keep_id"))
    groups = materialize(forms.groupBy("root").agg(F.min("keep_id").alias("keep_id"), F.count("*").alias("forms")), "groups")
    alone = rows.select("id", "root").join(groups.where("forms = 1"), "root").select("id", "keep_id")
    clash = groups.where("forms > 1").select("root")
    apart = rows.join(clash, "root", "left_semi").join(forms.join(clash, "root", "left_semi"), ["root", "canon"]).select("id", "keep_id")
    return alone.unionByName(apart)


def collapse(df: DataFrame, id_col: str = "id", text: str = "claim", names: list[str] | None = None) -> DataFrame:
    """(keep_id, n_copies): one row for each group of same records and how many ids it has."""
    return same_records(df, id_col, text, names).groupBy("keep_id").agg(F.count("*").alias("n_copies"))
