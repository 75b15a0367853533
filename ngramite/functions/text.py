"""Words and n-gram keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as C's isspace has it; the wildcard and the context in front of a text.
SPACE = r"[\x20\x09-\x0D]+"
WILD, START = "<*>", "<NA>"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def key(*parts: Column | str) -> Column:
    """Words and wildcards as one n-gram key."""
    return F.concat_ws(" ", *(F.lit(WILD) if isinstance(p, str) and p == WILD else p for p in parts))
