"""All similar pairs between set-valued records by banded minwise hashing.

Equal sets are one class: only class representatives are hashed, compared and
verified, so a group of copies costs one set.  The primary result is pairs of
classes beside the membership of records in classes; ``similar_sets`` expands
it to pairs of records.

A class signature is some bands of some minimum hashes each, derived from the
threshold (``bands_for``): a pair at the threshold shares no band with
probability ``MISS`` at most, more similar ones with less.  Classes that share
a band bucket are candidates, each pair once, and are verified exactly.  In
the join of buckets a pair must pass two exact bounds first: its sizes allow
the threshold, and so do its bitmaps, one bit an item, which differ in no more
bits than the sets do in items.

A bucket of more than ``BUCKET`` classes would make too many pairs.  Its
classes meet through an exact way instead, which is prefix filtering and not
minwise hashing: sets that reach the threshold must share one of the first
|x| - ceil(t |x|) + 1 items in a common order, rarest first.  Items and
classes with many rows are cut into parts of ``PART`` rows, and parts meet
parts, so that no task has a whole group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.ship import ship
from tessera.sources.tables import drop, stage

#: Probability that a pair at the threshold is no candidate, bands at most (where the threshold allows), classes of a bucket that is joined on its key alone.
MISS, MOST_BANDS, BUCKET = 1e-4, 40, 200
#: Rows of a part of a large group.
PART = 4096


def bands_for(threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows a band, for few false candidates, for which ``MOST_BANDS`` bands suffice; one row needs as many as it takes."""
    need = lambda rows: math.ceil(math.log(miss) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
    rows = 1
    while rows < 16 and need(rows + 1) <= MOST_BANDS:
        rows += 1
    return need(rows), rows


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def signatures(hashes: pa.Array, kinds: pa.Array, bands: int, rows: int) -> pa.Array:
    """The band hashes of each set from the 64-bit hashes of its items (one at least) and of its kind."""
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    values = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    lengths = hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty((len(lengths), bands), np.uint64)
    if len(lengths):
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        seeds = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        kind = kinds.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for b in range(bands):
            key = _mixed(kind + np.uint64(b))
            for r in range(rows):
                key = _mixed(key * np.uint64(31) + np.minimum.reduceat(_mixed(values ^ seeds[b * rows + r]), first))
            out[:, b] = key
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * bands), pa.array(out.reshape(-1).view(np.int64)))


def _bands(bands: int, rows: int):
    @F.arrow_udf("array<bigint>")
    def run(hashes: pa.Array, kinds: pa.Array) -> pa.Array:
        return signatures(hashes, kinds, bands, rows)

    return run


def _near(threshold: float) -> Column:
    """Whether sizes and bitmaps of a pair allow the threshold: never false for a pair that reaches it."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    most_shared = (n_a + n_b - F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")))) / 2
    return (n_a >= n_b * threshold - 1e-9) & (n_b >= n_a * threshold - 1e-9) & (most_shared >= (n_a + n_b) * (threshold / (1 + threshold)) - 1e-9)


def _pairs(left: DataFrame, right: DataFrame, on: list[str], near: Column, *more: str) -> DataFrame:
    a = left.select(*on, *[F.col(c).alias(f"{c}_a") for c in ("cls", "n", "bits", *more)])
    b = right.select(*on, *[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "bits", *more)])
    return a.join(b, on).filter((F.col("cls_a") < F.col("cls_b")) & near).select("cls_a", "cls_b").distinct()


@dataclass
class SimilarClasses:
    """``members``: (cls, set_name, id), each record once; ``pairs``: (cls_a, cls_b, shared, similarity) of different sets; ``classes``: (cls, set_name, items, n)."""

    members: DataFrame
    pairs: DataFrame
    classes: DataFrame


def similar_classes(sets: DataFrame, threshold: float = 0.6, least_items: int = 4) -> SimilarClasses:
    """Classes of equal sets and the pairs of classes that reach the threshold.

    ``sets`` has set_name, id and items (array<string>), one row per set; only
    sets of the same set_name are compared, so two tables are joined by giving
    them one name and keeping the pairs across.

    * Null items and repeated items count as absent; a null set is empty.
    * Sets of fewer than ``least_items`` items (at least one), and null ids, belong to no class.
    * Pairs of exactly the threshold belong to the result; it must be above 0 and at most 1.
    * A row given twice is one member.
    * No sets: no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    ship()
    clean = sets.select("set_name", "id", F.array_sort(F.array_distinct(F.array_compact(F.coalesce("items", F.array().cast("array<string>"))))).alias("items"))
    clean = clean.filter(F.col("id").isNotNull() & (F.size("items") >= max(least_items, 1)))
    keyed = stage(clean.withColumn("cls", F.unhex(F.md5(F.concat_ws("\x1f", "set_name", F.to_json("items"))))), "sets")
    members = keyed.select("cls", "set_name", "id").distinct()

    bands, rows = bands_for(threshold)
    hashes = F.transform("items", lambda x: F.xxhash64(x))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))
    bits = F.aggregate(F.col("_h"), F.lit(0).cast("bigint"), lambda s, h: s.bitwiseOR(bit(h)))
    classes = keyed.dropDuplicates(["cls"]).select("cls", "set_name", "items", F.size("items").alias("n"), hashes.alias("_h"))
    classes = stage(classes.select("cls", "set_name", "items", "n", bits.alias("bits"), _bands(bands, rows)("_h", F.xxhash64("set_name")).alias("bands")), "classes")

    in_bucket = F.count(F.lit(1)).over(Window.partitionBy("bucket"))
    buckets = classes.select(F.explode("bands").alias("bucket"), "cls", "n", "bits").withColumn("in_bucket", in_bucket).filter("in_bucket > 1")
    buckets = stage(buckets, "buckets")
    few = buckets.filter(F.col("in_bucket") <= BUCKET)
    candidates = _pairs(few, few, ["bucket"], _near(threshold))
    crowded = buckets.filter(F.col("in_bucket") > BUCKET)
    if not crowded.isEmpty():
        candidates = candidates.union(_by_prefix(classes, crowded.select("cls").distinct(), threshold)).distinct()

    left = classes.select(F.col("cls").alias("cls_a"), F.col("set_name").alias("name_a"), F.col("items").alias("items_a"), F.col("n").alias("n_a"))
    right = classes.select(F.col("cls").alias("cls_b"), F.col("set_name").alias("name_b"), F.col("items").alias("items_b"), F.col("n").alias("n_b"))
    verified = (
        stage(candidates, "candidates")
        .join(left, "cls_a")
        .join(right, "cls_b")
        .withColumn("shared", F.size(F.array_intersect("items_a", "items_b")).cast("bigint"))
        .withColumn("similarity", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))
        .filter((F.col("similarity") >= threshold) & (F.col("name_a") == F.col("name_b")))
        .select("cls_a", "cls_b", "shared", "similarity")
    )
    return SimilarClasses(members, verified, classes.select("cls", "set_name", "items", "n"))


def _parts(n: Column) -> Column:
    return F.ceil(n / PART).cast("int")


def _part(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(7)), parts).cast("int")


def _by_prefix(classes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(cls_a, cls_b): candidates among ``members``, none missed; a common item's classes meet part by part."""
    of = classes.join(members, "cls", "left_semi").select("cls", "set_name", "n", "bits", F.explode("items").alias("item"))
    often = of.groupBy("set_name", "item").agg(F.count(F.lit(1)).alias("often"))
    ranked = of.join(often, ["set_name", "item"]).withColumn("nth", F.row_number().over(Window.partitionBy("cls").orderBy("often", "item")))
    first = ranked.filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)
    first = first.select("cls", "n", "bits", "set_name", "item", (F.col("n") - F.col("nth")).alias("after"), _parts(F.col("often")).alias("parts"))
    left = first.withColumn("part", _part("cls", F.col("parts")))
    right = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # where an item is the first common one, no more than what follows it can be common too
    near = _near(threshold) & (1 + F.least("after_a", "after_b") >= (F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9)
    return _pairs(left, right, ["set_name", "item", "part"], near, "after")


def similar_sets(sets: DataFrame, threshold: float = 0.6, least_items: int = 4) -> DataFrame:
    """(set_name, id_a, id_b, shared, similarity) with id_a < id_b by bytes: all pairs of records.

    What ``similar_classes`` says about nulls, repeated and empty input holds.
    An id is never its own partner.  Copies make as many pairs as they are: of
    two classes, or within one, parts of ``PART`` records meet.
    """
    found = similar_classes(sets, threshold, least_items)
    size = found.members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    parts = stage(size.select("cls", "copies", _parts(F.col("copies")).alias("parts")), "copies")
    ids = stage(found.members.join(parts, "cls").select("cls", "set_name", "id", "copies", "parts", _part("id", F.col("parts")).alias("part")), "ids")

    def beside(pairs: DataFrame, end: str) -> DataFrame:
        """Each pair with the records of one end, in as many rows to the join as that class has parts."""
        large = parts.filter("parts > 1").select(F.col("cls").alias(f"cls_{end}"), "parts")
        cut = pairs.join(large, f"cls_{end}", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return cut.join(ids.select(F.col("cls").alias(f"cls_{end}"), "part", "set_name", F.col("id").alias(end)), [f"cls_{end}", "part"]).drop("part", f"cls_{end}")

    across = beside(beside(found.pairs, "a").drop("set_name"), "b")
    copied = ids.filter("copies > 1")
    a = copied.select("cls", "set_name", F.col("id").alias("a"), F.col("part").alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    b = copied.select("cls", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.col("part").alias("q"))
    inside = a.join(b, ["cls", "p", "q"]).filter("a < b").join(found.classes.select("cls", F.col("n").cast("bigint").alias("shared")), "cls").withColumn("similarity", F.lit(1.0))
    out = ["set_name", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "shared", "similarity"]
    return across.filter("a <> b").select(*out).union(inside.select(*out))
