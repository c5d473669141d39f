"""Joins in which a few keys hold a large share of all rows.

More than one in ``SHARE`` rows makes a key hot, so there are fewer than
``SHARE`` of them whatever the data: the driver may know them by name.  Only
their rows are spread over salts, and only their partners are copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key of more than one in so many rows is hot; into how many parts its rows are spread.
SHARE, SALTS = 64, 16


def hot_keys(rows: DataFrame, key: str, n: int | None = None) -> list:
    """The hot keys of ``rows`` (``n`` of them, if that is known); nulls are none."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    n = rows.count() if n is None else n
    return [r[0] for r in counts.filter(F.col("rows") * SHARE > n).select(key).collect()]


def salt_of(key: Column, hot: list, by: Column) -> Column:
    """The salt of a row of the side with hot keys: 0 unless its key is hot."""
    return F.when(key.isin(hot), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0) if hot else F.lit(0)


def salts_of(key: Column, hot: list) -> Column:
    """The salts of a row of the other side: all of them where its key is hot."""
    one = F.array(F.lit(0))
    return F.explode(F.when(key.isin(hot), F.array(*[F.lit(i) for i in range(SALTS)])).otherwise(one) if hot else one)


def spread_join(rows: DataFrame, partners: DataFrame, key: str, hot: list, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``partners`` on ``key``, whose hot keys in ``rows`` are known; ``by`` tells rows of a key apart."""
    if not hot:
        return rows.join(partners, key, how)
    left = rows.withColumn("_salt", salt_of(F.col(key), hot, F.col(by)))
    return left.join(partners.withColumn("_salt", salts_of(F.col(key), hot)), [key, "_salt"], how).drop("_salt")
