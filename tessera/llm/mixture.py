"""Mix sources to target shares of tokens by Poisson replication.

Each record gets a hash-seeded uniform number; inverting a Poisson
distribution there, cut at the source's cap, gives its number of copies.  The
number is the whole 64-bit hash, read as a distance from 1: that distance is a
floating point number, so a rate of one in 10^15 is as exact as one of a half,
and a source may be any number of times larger than what it must give.

The mean of each source is set so that its tokens meet its target.  A closed
form of the expected tokens gives the first guess; then the tokens that a few
means around it would really draw are counted over all records, and the means
close in on the target until it is met to ``TOLERANCE`` or between two
records.  A count is one aggregate over three narrow columns; a large source
needs one, as its tokens are close to the expected ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import trimmed
from tessera.sources.tables import stage

#: Share of the largest feasible total that is drawn; below 1, so that no mean is infinite.
UTILISATION = 0.95
#: A source's tokens may differ from its target by so much of it; means that are tried at once; width below which a mean is as good as known.
TOLERANCE, TRIED, NARROW = 1e-4, 15, 1e-9


def source_key(c: Column | str) -> Column:
    """A source's name trimmed and in lower case."""
    return F.lower(trimmed(c))


def distance(seed: int, key: str) -> Column:
    """A record's uniform number as its distance from 1, above 0 and at most 1."""
    half = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), F.col(key)), F.lit(1))
    return (half.cast("double") + 0.5) * F.lit(2.0**-63)


def tails(mean: float, cap: int) -> list[float]:
    """The probabilities of at least 1, 2, ... cap under a Poisson distribution, each exact to its own size.

    A record has at least k copies where its distance from 1 is within the k-th.
    """
    if mean <= 0:
        return [0.0] * cap
    last = cap + int(mean + 12 * math.sqrt(mean)) + 40
    above, out = 0.0, [0.0] * (cap + 1)
    for k in range(last, 0, -1):
        above += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        if k <= cap:
            out[k] = min(above, 1.0)
    return out[1:]


def mean_for(copies: float, cap: int) -> float:
    """The mean under which a record has so many copies on average, the cap included."""
    low = high = max(copies, 1e-300)  # a cap only lowers the average
    while high < 40 + 2 * cap and sum(tails(high, cap)) < copies:
        high *= 2
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(tails(mid, cap)) < copies else (low, mid)
    return (low + high) / 2


def wanted(tokens: dict[str, int], targets: dict[str, tuple[float, int]], utilisation: float = UTILISATION, total: float | None = None) -> dict[str, float]:
    """The tokens that each source has to give.

    Sources without tokens can't contribute: the others share the total in
    proportion to their targets.  The total is ``utilisation`` of the largest
    for which no source needs more than its cap, or ``total`` where that is less.
    """
    live = {s: (p, m) for s, (p, m) in targets.items() if p > 0 and m > 0 and tokens.get(s, 0) > 0}
    if not live:
        return {}
    whole = sum(p for p, _ in live.values())
    most = utilisation * min(m * tokens[s] / (p / whole) for s, (p, m) in live.items())
    most = most if total is None else min(most, total)
    return {s: p / whole * most for s, (p, _) in live.items()}


def means(
    want: dict[str, float], sums: dict[str, tuple[int, float]], caps: dict[str, int], drawn: Callable[[dict[str, list[float]]], dict[str, list[int]]]
) -> dict[str, float]:
    """The mean of each source at which its records really draw what is wanted.

    ``sums`` has the tokens of a source and the sum of their squares, ``drawn``
    counts the tokens that each of some means draws from each of some sources.
    A source is done as well when the means around its target are ``NARROW``:
    then only a record lies between them.
    """
    low, high, best, grid = {}, {}, {}, {}
    for s, w in want.items():
        tokens, squares = sums[s]
        spread = min(0.5, 5 * math.sqrt(squares / tokens / w))  # five standard deviations
        steps = [1 + spread * (2 * i / (TRIED - 1) - 1) for i in range(TRIED)]
        low[s], high[s] = 0.0, 40.0 + 2 * caps[s]
        grid[s] = sorted({mean_for(w * x / tokens, caps[s]) for x in steps})
    while grid:
        got = drawn(grid)
        for s, tried in list(grid.items()):
            for m, n in zip(tried, got[s], strict=True):
                if s not in best or abs(n - want[s]) < best[s][0]:
                    best[s] = (abs(n - want[s]), m)
                if n < want[s]:
                    low[s] = max(low[s], m)
                else:
                    high[s] = min(high[s], m)
            width = high[s] - low[s]
            if best[s][0] <= TOLERANCE * want[s] or width <= NARROW * high[s]:
                del grid[s]
            else:
                grid[s] = [low[s] + width * i / (TRIED + 1) for i in range(1, TRIED + 1)]
    return {s: m for s, (_, m) in best.items()}


def _copies(all_tails: Column) -> Column:
    return F.size(F.filter(all_tails, lambda t: F.col("distance") <= t))


def mixture(
    records: DataFrame, targets: DataFrame, key: str, source: Column, size: Column, seed: int = 17, utilisation: float = UTILISATION, total: float | None = None
) -> DataFrame:
    """(key, source, n_tokens, copy_no, position_key): the mixture in a global random order.

    ``targets`` has source, target_share and max_repeats, one row per source: a
    list that the driver holds.  ``key`` names the records' id column, ``total``
    the wanted number of tokens (none: as many as the caps allow, times
    ``utilisation``).

    * A record with a null or unlisted source takes no part and its size is
      never computed; nor does a source with a null, zero or negative share or
      cap.
    * A record of size 0 may be drawn and adds nothing; a null size counts as 0.
    * Rows with the same key get the same number of copies.
    * No records or no targets: an empty mixture.

    The order is that of a hash of seed, key and copy: the range partitioning
    on it is even whatever the sources are.
    """
    spark = records.sparkSession
    named = targets.select(source_key("source").alias("s"), "target_share", "max_repeats").filter("s IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    listed = {r.s: (r.target_share, r.max_repeats) for r in named.collect()}  # the list of targets

    def beside(values: dict[str, list], kind: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(list(values.items()), f"_source string, _tails {kind}"))  # as long as the list of targets

    here = source_key(source) == F.col("_source")
    kept = records.join(beside({s: [] for s in listed}, "array<double>").select("_source"), here, "left_semi")
    sized = stage(
        kept.select(F.col(key).alias("key"), source_key(source).alias("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("n_tokens"), distance(seed, key).alias("distance")),
        "sized",
    )
    of = sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("squares"))
    sums = {r.source: (r.n, r.squares) for r in of.collect()}  # one row a listed source
    caps = {s: m for s, (_, m) in listed.items()}

    def drawn(grid: dict[str, list[float]]) -> dict[str, list[int]]:
        tried = max(map(len, grid.values()))
        table = beside({s: [tails(m, caps[s]) for m in tried_] for s, tried_ in grid.items()}, "array<array<double>>")
        counts = [F.sum(F.col("n_tokens") * _copies(F.get("_tails", F.lit(i)))).alias(f"n{i}") for i in range(tried)]
        rows = sized.join(table, F.col("source") == F.col("_source")).groupBy("source").agg(*counts).collect()  # one row a listed source
        return {r.source: [r[f"n{i}"] for i in range(len(grid[r.source]))] for r in rows}

    want = wanted({s: n for s, (n, *_) in sums.items()}, listed, utilisation, total)
    chosen = {s: tails(m, caps[s]) for s, m in means(want, sums, caps, drawn).items()}
    return (
        sized.join(beside(chosen, "array<double>"), F.col("source") == F.col("_source"))
        .withColumn("copies", _copies(F.col("_tails")))
        .filter("copies > 0")
        .select("key", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"))
        .withColumn("position_key", F.xxhash64(F.lit(seed + 1), "key", "copy_no"))
        .orderBy("position_key", "key", "copy_no")
        .withColumnRenamed("key", key)
    )


def shares(mixed: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Per listed source its target and what it really got.

    Columns: source, target_share, max_repeats, actual_share, n_tokens,
    n_copies, n_records, most_copies.  A source that gave nothing has zeros.
    """
    per_record = mixed.groupBy("source", key).agg(F.count(F.lit(1)).alias("c"), F.sum("n_tokens").alias("t"))
    got = per_record.groupBy("source").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("r"), F.max("c").alias("m"))
    got = got.withColumn("whole", F.sum("t").over(Window.partitionBy(F.lit(0))))  # one row a listed source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return (
        targets.select(source_key("source").alias("source"), "target_share", "max_repeats")
        .join(got, "source", "left")
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce(F.col("t") / F.nullif("whole", F.lit(0)), F.lit(0.0)).alias("actual_share"),
            zero("t").alias("n_tokens"),
            zero("c").alias("n_copies"),
            zero("r").alias("n_records"),
            zero("m").alias("most_copies"),
        )
    )
