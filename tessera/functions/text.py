"""String expressions with the definitions of the test data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: "Blank" is a space, a tab or a line feed.
BLANKS = " \t\n"


def trimmed(c: Column | str) -> Column:
    """Without blanks at both ends."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def name_or_null(c: Column | str) -> Column:
    """The trimmed value; null where nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))
