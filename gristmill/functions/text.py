"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A letter or digit of any script.
ALNUM = r"[\p{L}\p{N}]"


def fold(text: Column) -> Column:
    """Lower case, only letters and digits left; a point or comma directly between two digits 0-9 is kept.

    Null gives null; a text without letters and digits gives ''.
    """
    return F.regexp_replace(F.lower(text), r"(?<![0-9])[.,]|[.,](?![0-9])|[^\p{L}\p{N}.,]", "")


def trim_blank(text: Column) -> Column:
    """Without the characters up to U+0020 at both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def same_name(category: Column) -> Column:
    """A category in upper case without outer white space."""
    return F.upper(F.regexp_replace(category, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
