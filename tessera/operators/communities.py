"""Communities by modularity, without ever holding the graph in one place.

Local moving in the manner of Louvain, synchronous and deterministic: in each
round every node learns the weights of its links to the neighbouring
communities and picks the best gain in modularity, ties by name.  Only nodes
of one half (by a hash of node and round) may move, which keeps neighbours
from swapping for ever.  A round that doesn't raise the modularity isn't
taken; after several such rounds the communities become nodes and the next
level starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import drop, stage

ROUNDS, STALE, LEVELS = 16, 3, 6


def modularity(edges: DataFrame, member: DataFrame) -> float:
    """Modularity of (id, community) over undirected edges; parallel edges and self-loops count."""
    e = edges.select("src", "dst", F.lit(1.0).alias("w"))
    return _modularity(_weights(e), member)


def _weights(e: DataFrame) -> DataFrame:
    """Undirected weights (a, b, w) with a <= b."""
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))


def _modularity(w: DataFrame, member: DataFrame) -> float:
    a, b = member.select(F.col("id").alias("a"), F.col("community").alias("ca")), member.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    ends = w.join(a, "a").join(b, "b")
    inside = F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)
    both = F.explode(F.array(F.struct(F.col("ca").alias("c"), "w", inside.alias("i")), F.struct(F.col("cb").alias("c"), "w", F.lit(0.0).alias("i"))))
    each = ends.select(both.alias("x")).groupBy("x.c").agg(F.sum("x.w").alias("d"), F.sum("x.i").alias("i"))
    twice, within, squares = each.agg(F.sum("d"), F.sum("i"), F.sum(F.col("d") * F.col("d"))).first()
    return 2 * within / twice - squares / (twice * twice) if twice else 0.0


def communities(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, community) for every id, named by its least member; an isolate is its own.

    Edges with an end outside ``ids`` are ignored.
    """
    ids = ids.select("id").distinct()
    known = edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    w = stage(_weights(known.select("src", "dst", F.lit(1.0).alias("w"))), "weights")
    whole = w.agg(F.sum("w")).first()[0]
    member = stage(ids.withColumn("community", F.col("id")), "member")
    if not whole:
        return member
    top = member.select("id").withColumn("community", F.col("id"))
    for level in range(LEVELS):
        moved, gained = _local(w, stage(top, "level"), whole, level)
        if not gained:
            break
        member = stage(member.join(moved.toDF("community", "next"), "community").select("id", F.col("next").alias("community")), "member")
        c = moved.select(F.col("id").alias("a"), F.col("community").alias("src"))
        d = moved.select(F.col("id").alias("b"), F.col("community").alias("dst"))
        w = stage(_weights(w.join(c, "a").join(d, "b").select("src", "dst", "w")), "weights")
        top = moved.select(F.col("community").alias("id")).distinct().withColumn("community", F.col("id"))
    least = member.groupBy("community").agg(F.min("id").alias("name"))
    return member.join(least, "community").select("id", F.col("name").alias("community"))


def _local(w: DataFrame, start: DataFrame, whole: float, level: int) -> tuple[DataFrame, bool]:
    links = stage(w.filter("a <> b").select(F.col("a").alias("id"), F.col("b").alias("to"), "w").unionAll(w.filter("a <> b").select(F.col("b").alias("id"), F.col("a").alias("to"), "w")), "links")
    both = w.select(F.col("a").alias("id"), "w").unionAll(w.select(F.col("b").alias("id"), "w"))
    degree = stage(both.groupBy("id").agg(F.sum("w").alias("k")), "degree")
    best, score, stale, gained = start, _modularity(w, start), 0, False
    now = start
    for r in range(ROUNDS):
        at = now.join(degree, "id")
        size = at.groupBy("community").agg(F.sum("k").alias("tot"))
        seen = links.join(now.toDF("to", "c"), "to").groupBy("id", "c").agg(F.sum("w").alias("kin"))
        options = at.join(seen, "id").join(size.toDF("c", "tot"), "c")
        own = F.col("c") == F.col("community")
        gain = F.col("kin") - F.col("k") * (F.col("tot") - F.when(own, F.col("k")).otherwise(0.0)) / (2 * whole)
        ranked = options.withColumn("gain", gain)
        stay = ranked.groupBy("id").agg(F.max(F.when(own, F.col("gain"))).alias("stay"))
        nth = F.row_number().over(Window.partitionBy("id").orderBy(F.col("gain").desc(), "c"))
        first = ranked.withColumn("nth", nth).filter("nth = 1").select("id", "c", "gain")
        alone = at.join(size, "community").select("id", (-F.col("k") * (F.col("tot") - F.col("k")) / (2 * whole)).alias("alone"))
        turn = F.pmod(F.xxhash64("id", F.lit(level), F.lit(r)), F.lit(2)) == 0
        better = F.col("gain") > F.coalesce("stay", "alone") + 1e-12
        moves = first.join(stay, "id", "left").join(alone, "id").filter(better & turn).select("id", "c")
        new = stage(now.join(moves, "id", "left").select("id", F.coalesce("c", "community").alias("community")), "moved")
        q = _modularity(w, new)
        if q > score + 1e-9:
            best, score, stale, gained = new, q, 0, True
        else:
            stale += 1
        now = new
        if stale >= STALE:
            break
    drop(links, degree)
    return best, gained


def community_profiles(member: DataFrame, nodes: DataFrame, min_size: int = 3, keys: int = 5) -> DataFrame:
    """(community, name, size, repo_distribution, node_types, key_nodes), largest first.

    ``name`` is the most frequent repo, ties by name; members that are no
    nodes count under an empty repo and the type Unknown.
    """
    of = member.join(nodes.select("id", "repo", "node_type"), "id", "left").select("community", "id", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("node_type", F.lit("Unknown")).alias("node_type"))
    size = of.groupBy("community").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)

    def spread(column: str, name: str) -> DataFrame:
        counts = of.groupBy("community", column).agg(F.count(F.lit(1)).alias("n"))
        pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n"))))
        return counts.groupBy("community").agg(pairs.alias(name), F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(f"top_{column}"))

    nth = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    first = of.withColumn("nth", nth).filter(F.col("nth") <= keys).groupBy("community").agg(F.sort_array(F.collect_list("id")).alias("key_nodes"))
    return (
        size.join(spread("repo", "repo_distribution"), "community")
        .join(spread("node_type", "node_types"), "community")
        .join(first, "community")
        .select("community", F.col("top_repo").alias("name"), "size", "repo_distribution", "node_types", "key_nodes")
        .orderBy(F.col("size").desc(), "community")
    )
