"""References to records that do not exist, now or at the time of the reference.

Parents (key, begin, end) and children (key, time) are brought into one long
form, tagged, and grouped by parent table and key.  Groups without a parent
flag are *missing*.  The others need the time: within a key the children see
the latest end among the parents that began before them.

A key may hold a third of all rows, so a key is never one task: rows are
spread over (key, day).  Per day the parents are reduced to one row by an
ordinary two-step aggregate; the running maximum over the days of a key is
tiny and is joined back, so that only rows of one key *and* one day meet in
one sort.  Where one day of a key is hot itself (a bulk load, or references
without a time, which have a day of their own), its references are spread over
salts, and the day's parents, one for each begin, are copied under these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.skew import SHARE, salt_of, salts_of
from tessera.sources.tables import stage

_FOREVER = "9999-12-31 00:00:00"
_NO_DAY = "0001-01-01"


def parent_rows(df: DataFrame, parent_tbl: str, key: Column, begin: Column, end: Column) -> DataFrame:
    """Lives of parent keys in long form; rows with a null key are none."""
    until = F.coalesce(end.cast("timestamp_ntz"), F.lit(_FOREVER).cast("timestamp_ntz"))
    return df.select(
        F.lit(parent_tbl).alias("parent_tbl"),
        key.alias("key"),
        begin.cast("timestamp_ntz").alias("t"),
        until.alias("until"),
        F.lit(True).alias("is_parent"),
        F.lit(None).cast("string").alias("tbl"),
        F.lit(None).cast("bigint").alias("row_id"),
        F.lit(None).cast("string").alias("field"),
    ).filter(F.col("key").isNotNull())


def child_rows(df: DataFrame, parent_tbl: str, tbl: str, row_id: Column, field: str, key: Column, at: Column) -> DataFrame:
    """References in long form; null keys refer to nothing and are left out."""
    return df.select(
        F.lit(parent_tbl).alias("parent_tbl"),
        key.alias("key"),
        at.cast("timestamp_ntz").alias("t"),
        F.lit(None).cast("timestamp_ntz").alias("until"),
        F.lit(False).alias("is_parent"),
        F.lit(tbl).alias("tbl"),
        row_id.cast("bigint").alias("row_id"),
        F.lit(field).alias("field"),
    ).filter(F.col("key").isNotNull())


def orphan_references(parents: Sequence[DataFrame], children: Sequence[DataFrame]) -> DataFrame:
    """Children whose parent is missing, deleted or late.

    Columns: tbl, row_id, field, kind, period (yyyy-MM, or ``none`` where the
    reference has no time).

    * missing: the key has no parent row at all;
    * deleted: no parent row is alive at the reference's time, one began before;
    * late: all parent rows begin later.

    Only *missing* is possible for a null time.  A parent row without a begin
    gives its key existence but never a life; one that ends before it begins
    began but never lives.  Begins count as before references of the same
    instant.  Repeated child rows are judged one by one; empty inputs give an
    empty result.
    """
    lives, refs = parents[0], children[0]
    for more in parents[1:]:
        lives = lives.unionByName(more)
    for more in children[1:]:
        refs = refs.unionByName(more)
    # of parents that begin together only the one that ends last counts
    lives = lives.groupBy("parent_tbl", "key", "t", "is_parent", "tbl", "row_id", "field").agg(F.max("until").alias("until"))
    day = F.coalesce(F.to_date("t"), F.lit(_NO_DAY).cast("date"))
    long = refs.unionByName(lives).withColumn("day", day)

    spread = ["parent_tbl", "key", "day"]
    per_day = stage(
        long.groupBy(*spread).agg(
            F.max(F.when(F.col("is_parent") & F.col("t").isNotNull(), F.col("until"))).alias("day_until"),
            F.max("is_parent").alias("has_parent"),
            F.count_if(~F.col("is_parent")).alias("n"),
        ),
        "days",
    )
    group = F.xxhash64(*spread)
    total = per_day.agg(F.sum("n")).first()[0] or 0
    hot = [r.g for r in per_day.filter(F.col("n") * SHARE > total).select(group.alias("g")).collect()]  # fewer than SHARE
    salts = salts_of(group, hot)
    days = Window.partitionBy("parent_tbl", "key").orderBy("day")
    before = days.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("parent_tbl", "key")
    carried = per_day.select(
        *spread,
        F.max("day_until").over(before).alias("carried_until"),
        F.max("has_parent").over(whole).alias("known"),
    ).withColumn("salt", salts)

    refs, lives = refs.withColumn("day", day), lives.withColumn("day", day)
    long = refs.withColumn("salt", salt_of(group, hot, F.col("row_id"))).unionByName(lives.withColumn("salt", salts))
    in_day = Window.partitionBy(*spread, "salt").orderBy(F.col("t").asc_nulls_first(), F.col("is_parent").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = long.withColumn("seen_until", F.max(F.when(F.col("t").isNotNull(), F.col("until"))).over(in_day)).filter(~F.col("is_parent"))

    c, s = carried.alias("c"), seen.alias("s")
    same = (F.col("s.parent_tbl") == F.col("c.parent_tbl")) & (F.col("s.key") == F.col("c.key")) & (F.col("s.day") == F.col("c.day")) & (F.col("s.salt") == F.col("c.salt"))
    latest = F.greatest(F.col("c.carried_until"), F.col("s.seen_until"))
    kind = (
        F.when(~F.col("c.known"), F.lit("missing"))
        .when(F.col("s.t").isNull(), F.lit(None))
        .when(latest.isNull(), F.lit("late"))
        .when(latest <= F.col("s.t"), F.lit("deleted"))
    )
    return (
        s.join(c, same)
        .select("s.tbl", "s.row_id", "s.field", kind.alias("kind"), F.coalesce(F.date_format("s.t", "yyyy-MM"), F.lit("none")).alias("period"))
        .filter(F.col("kind").isNotNull())
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, field, kind and period."""
    return orphans.groupBy("tbl", "field", "kind", "period").agg(F.count(F.lit(1)).alias("n"))
