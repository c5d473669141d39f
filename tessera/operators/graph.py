"""Graph operators on edges (src, dst, edge_type) and nodes (id, node_type, repo).

Traversals are loops over a frontier: each hop is one join with the edges,
written to the shared folder, so lineage stays short and a lost executor
costs one hop.  Depth is the least number of hops (breadth first), which
reaches at least everything that a depth-first walk with a global visited set
reaches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.paths import Held, walks
from tessera.schema import FLOW_TYPES, IMPACT_TYPES, WIDE_FLOW_TYPES
from tessera.sources.ship import ship
from tessera.sources.tables import drop, stage, together

#: Edges of a graph that each task may hold, as numbers: some 16 bytes each in a task, 160 on the driver while it collects them.
HELD_EDGES = 3_000_000
#: Pairs of source and node that walks by joins have on disk at a time.
WALKED_PAIRS = 20_000_000


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among ``nodes.id``: two semi joins in place of an OR."""
    ids = nodes.select("id").distinct()
    outgoing = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    incoming = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    return outgoing.unionByName(incoming)


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes.id``."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def graph_text(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(line): each edge that touches the nodes as ``src --[type]--> dst``."""
    return touching(edges, nodes).select(F.format_string("%s --[%s]--> %s", "src", "edge_type", "dst").alias("line"))


def trace_flow(edges: DataFrame, starts: DataFrame, max_depth: int = 5, types: Sequence[str] = FLOW_TYPES) -> DataFrame:
    """(id, depth): what is reached from ``starts.id`` within ``max_depth`` hops.

    Starts have depth 0, whether they are nodes or not; targets may dangle.
    """
    hops = stage(edges.filter(F.col("edge_type").isin(*types)).select("src", "dst").distinct(), "hops")
    seen = stage(starts.select("id", F.lit(0).alias("depth")).distinct(), "flow")
    frontier, parts = seen, [seen]
    for depth in range(1, max_depth + 1):
        reached = frontier.select(F.col("id").alias("src")).join(hops, "src").select(F.col("dst").alias("id")).distinct()
        frontier = stage(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "hop")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        seen = together(*parts)
    drop(hops)
    return seen


def trace_flow_with_entries(edges: DataFrame, nodes: DataFrame, mapped: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """``trace_flow`` over bindings too, with the screens and controllers that depend on it.

    Entries are mapped UI or Controller nodes outside the flow that depend on
    one of its nodes; they have depth -1 and come once.
    """
    flow = trace_flow(edges, starts, max_depth, WIDE_FLOW_TYPES)
    users = edges.filter("edge_type = 'depends_on'").join(flow.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    entries = (
        users.join(flow.select("id"), "id", "left_anti")
        .join(mapped.select("id"), "id", "left_semi")
        .join(nodes.filter(F.col("node_type").isin("UI", "Controller")).select("id"), "id", "left_semi")
    )
    return entries.select("id", F.lit(-1).alias("depth")).unionByName(flow)


def blast_radius(edges: DataFrame, start: str, max_depth: int = 4, types: Sequence[str] = IMPACT_TYPES) -> DataFrame:
    """(id, depth, via, path): what depends on ``start`` within ``max_depth`` hops, nearest first.

    ``via`` is the type of the edge by which a node was first reached, ``path``
    the names from ``start`` to it; of equally short ones the first by path,
    then type.  On a cycle the start itself appears, as what it affects.
    """
    back = stage(edges.filter(F.col("edge_type").isin(*types)).select("src", "dst", "edge_type").distinct(), "back")
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    seen, parts = None, []
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("id").alias("dst"), "path").join(back, "dst").select(F.col("src").alias("id"), F.col("edge_type").alias("via"), "path")
        if seen is not None:
            step = step.join(seen.select("id"), "id", "left_anti")
        best = step.groupBy("id").agg(F.min(F.struct("path", "via")).alias("m"))
        hop = stage(best.select("id", F.lit(depth).alias("depth"), F.col("m.via").alias("via"), F.concat("m.path", F.array("id")).alias("path")), "blast")
        parts.append(hop)
        seen = together(*parts)
        if hop.isEmpty():
            break
        frontier = hop.select("id", "path")
    drop(back)
    return seen


def blast_summary(affected: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_type, n): affected nodes per type; those that are no nodes are Unknown."""
    return affected.join(nodes.select("id", "node_type"), "id", "left").groupBy(F.coalesce("node_type", F.lit("Unknown")).alias("node_type")).agg(F.count(F.lit(1)).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): undirected; parallel edges count, a self-loop counts twice."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(edges: DataFrame, nodes: DataFrame, mapped: DataFrame, k: int = 10) -> DataFrame:
    """The k mapped nodes of highest degree among edges between mapped nodes, ties by name."""
    top = degrees(within(edges, mapped)).orderBy(F.col("degree").desc(), "id").limit(k)
    return top.join(nodes.select("id", "repo", "node_type"), "id", "left")


def repo_coupling(edges: DataFrame, nodes: DataFrame, least: int = 3, k: int = 10) -> DataFrame:
    """(repo_a, repo_b, n): the k unordered pairs of repos with most edges between them, at least ``least``.

    The top k are taken before ``least`` is applied; ties go by name.
    """
    repo = nodes.filter(F.coalesce("repo", F.lit("")) != "").select("id", "repo")
    both = edges.join(repo.toDF("src", "ra"), "src").join(repo.toDF("dst", "rb"), "dst").filter("ra <> rb")
    pairs = both.groupBy(F.least("ra", "rb").alias("repo_a"), F.greatest("ra", "rb").alias("repo_b")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.orderBy(F.col("n").desc(), "repo_a", "repo_b").limit(k).filter(F.col("n") >= least)


def graph_stats(edges: DataFrame, nodes: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row: nodes, edges between mapped nodes, repos of nodes (an absent one counts as the empty name)."""
    n = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.countDistinct(F.coalesce("repo", F.lit(""))).alias("repos"))
    e = within(edges, mapped).agg(F.count(F.lit(1)).alias("total_edges"))
    return n.withColumn("_k", F.lit(1)).join(e.withColumn("_k", F.lit(1)), "_k").drop("_k")


def similar_modules(edges: DataFrame, module: str, k: int = 5) -> DataFrame:
    """(module, score): modules whose use cases resemble those of ``module``; the k best, ties by name.

    Two use cases resemble each other when one, without a leading verb, is
    part of the other.  The score counts pairs of a use case of the module and
    an edge of the other.  The module's own use cases are one module's, so
    they are shipped to all tasks as one array.
    """
    # fixed value: the verbs
    cut = lambda c: F.regexp_replace(c, r"^(Get|Create|Delete|Update|Fetch)", "")
    uses = edges.filter((F.col("edge_type") == "binds") & F.col("dst").contains("UseCase")).select("src", "dst")
    mine = uses.filter(F.col("src") == module).select("dst").distinct().select(cut("dst").alias("s")).filter("s <> ''").groupBy().agg(F.collect_list("s").alias("own"))
    suffixes = mine.first()["own"]  # one module's use cases
    if not suffixes:
        return uses.limit(0).select(F.col("src").alias("module"), F.lit(0).cast("bigint").alias("score"))
    s = cut("dst")
    hits = F.size(F.filter(F.array(*map(F.lit, suffixes)), lambda t: s.contains(t) | t.contains(s)))
    scored = uses.filter((F.col("src") != module) & (s != "")).select(F.col("src").alias("module"), hits.cast("bigint").alias("h")).filter("h > 0")
    return scored.groupBy("module").agg(F.sum("h").alias("score")).orderBy(F.col("score").desc(), "module").limit(k)


def components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, component): connected components, named by their least id; an isolated id is its own.

    Labels take the least label among neighbours and then jump to the label of
    their label, so the number of rounds is about logarithmic in the diameter.
    """
    pairs = edges.select("src", "dst").filter("src <> dst")
    both = stage(pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "pairs")
    at = stage(ids.select("id").distinct().withColumn("component", F.col("id")), "cc")
    while True:
        heard = both.join(at.withColumnRenamed("id", "dst").withColumnRenamed("component", "c"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        near = at.join(heard, "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("label"))
        jump = near.select(F.col("id").alias("label"), F.col("label").alias("l2"))
        new = stage(near.join(jump, "label", "left").select("id", F.coalesce("l2", "label").alias("component")), "cc")
        settled = new.join(at.withColumnRenamed("component", "old"), "id").filter("component <> old").isEmpty()
        drop(at)
        at = new
        if settled:
            drop(both)
            return at


def pivots_for(n: int, error: float, risk: float = 0.05) -> int:
    """Sources of which no node's betweenness, as a share of all n(n - 1)/2 pairs, errs by more than ``error``, but for a ``risk`` (Hoeffding and a union bound)."""
    return min(n, math.ceil(math.log(2 * max(n, 1) / risk) / (2 * (error / 2) ** 2)))


def betweenness(edges: DataFrame, k: int | None = None, pivots: int | None = None) -> DataFrame:
    """(id, betweenness): unweighted, undirected; parallel edges are one.

    Forward: the numbers of shortest paths from every source, level by level.
    Backward: the dependencies, from the farthest level to the sources.  Up to
    ``HELD_EDGES`` edges each task holds the graph and walks from its share of
    the sources (``paths``).  Beyond that, and from pivots, each level is one
    join, so no task ever holds the graph; sources then walk in batches of at most
    ``WALKED_PAIRS`` pairs with nodes, whose files go before the next one, so disk
    stays in proportion to the graph.  The values are the same.  With ``k``
    only the k highest positive values, after rounding to two places, ties by name.

    Exact without ``pivots``, at a cost of nodes times edges.  With ``pivots``
    so many sources, drawn by a hash, stand for all (``pivots_for``): the cost is
    that many times the edges, and all sources give the exact values.
    """
    pairs = edges.select("src", "dst").filter("src <> dst")
    both = stage(pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "pairs")
    ids = stage(both.select(F.col("src").alias("v")).distinct(), "ids")
    if pivots is None and both.count() <= 2 * HELD_EDGES:
        return _highest(_held_betweenness(both, ids), k)
    n = ids.count()
    sources, scale, walking = ids, 1.0, n
    if pivots is not None:
        sources, walking = stage(ids.orderBy(F.xxhash64("v"), "v").limit(pivots), "sources"), min(pivots, n)
        scale = max(n, 1) / max(walking, 1)
    batches, total = max(1, math.ceil(walking * n / WALKED_PAIRS)), None
    for i in range(batches):
        new = _walked(both, sources.filter(F.pmod(F.xxhash64("v", F.lit(3)), F.lit(batches)) == i))
        if total is not None and new is not None:
            old = total, new
            new = stage(together(*old).groupBy("v").agg(F.sum("d").alias("d")), "walked", free=True)
            drop(*old)
        total = total if new is None else new
    if total is None:
        return _highest(ids.select(F.col("v").alias("id"), F.lit(0.0).alias("betweenness")), k)
    out = total.select("v", (F.col("d") / 2 * scale).alias("b"))
    return _highest(ids.join(out, "v", "left").select(F.col("v").alias("id"), F.coalesce("b", F.lit(0.0)).alias("betweenness")), k)


def _walked(both: DataFrame, sources: DataFrame) -> DataFrame | None:
    """(v, d): the sum over the sources of what each node carries of the paths from there, or nothing; levels by joins."""
    level = stage(sources.select(F.col("v").alias("s"), "v", F.lit(1.0).alias("paths")), "level")
    levels = [level]
    while True:
        # one hop from a level leads to that level, the one before it or the next
        far = levels[-1].withColumnRenamed("v", "src").join(both, "src").groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        seen = levels[-1].select("s", "v") if len(levels) == 1 else together(*levels[-2:]).select("s", "v")
        nxt = stage(far.join(seen, ["s", "v"], "left_anti"), "level", free=True)
        if nxt.isEmpty():
            drop(nxt)
            break
        levels.append(nxt)
    owed = levels[-1].select("s", "v", "paths", F.lit(0.0).alias("d"))
    parts = []
    for above in reversed(levels[:-1]):
        parts.append(owed)
        give = owed.select("s", F.col("v").alias("src"), ((1 + F.col("d")) / F.col("paths")).alias("g")).join(both, "src").select("s", F.col("dst").alias("v"), "g")
        got = give.join(above.select("s", "v"), ["s", "v"], "left_semi").groupBy("s", "v").agg(F.sum("g").alias("g"))
        owed = stage(above.join(got, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("g", F.lit(0.0))).alias("d")), "owed", free=True)
    parts = parts[1:]  # nothing is owed to the last level
    out = stage(together(*parts).groupBy("v").agg(F.sum("d").alias("d")), "walked", free=True) if parts else None
    drop(*levels, *parts, owed)
    return out


def _held_betweenness(both: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, betweenness) of ``both``, which has each edge in both directions, by walks over arrays."""
    ship()
    spark = both.sparkSession
    num = stage(ids.withColumn("num", F.monotonically_increasing_id()), "num")
    numbered = both.filter("src < dst").join(num.toDF("src", "a"), "src").join(num.toDF("dst", "b"), "dst").select("a", "b")
    found = numbered.toArrow()  # at most HELD_EDGES rows of two numbers
    held = Held(*(np.asarray(found.column(c).to_numpy(), np.int64) for c in ("a", "b")))
    if not len(held.names):
        return ids.select(F.col("v").alias("id"), F.lit(0.0).alias("betweenness"))
    chunks = max(1, min(len(held.core), 8 * spark.sparkContext.defaultParallelism))
    sums = spark.range(0, chunks, 1, chunks).mapInArrow(walks(spark.sparkContext.broadcast(held), chunks), "num bigint, b double").groupBy("num").agg(F.sum("b").alias("b"))
    return stage(num.join(sums, "num", "left").select(F.col("v").alias("id"), F.coalesce("b", F.lit(0.0)).alias("betweenness")), "between")


def _highest(out: DataFrame, k: int | None) -> DataFrame:
    if k is None:
        return out
    return out.withColumn("betweenness", F.round("betweenness", 2)).filter("betweenness > 0").orderBy(F.col("betweenness").desc(), "id").limit(k)


def entry_nodes(mapped: DataFrame, query: str, triggers: Sequence[tuple[str, Sequence[str]]], k: int = 3) -> DataFrame:
    """The first k mapped names that a trigger word of the query points to; each name once.

    A trigger is (word in the query, parts of names).
    """
    text = query.lower()
    parts = [p for word, names in triggers if word in text for p in names]
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.lower("id").contains(p)
    return mapped.filter(hit).select("id").distinct().orderBy("id").limit(k)


def priority(files: DataFrame, k: int = 6) -> DataFrame:
    """(path, rank): pages, screens and views first, then blocs and cubits, then the rest; distinct, the first k."""
    p = F.col("path")
    # fixed values: how names of screens and of controllers end
    level = F.when(p.contains("_page.dart") | p.contains("_screen.dart") | p.contains("_view.dart"), 0).when(p.contains("_bloc.dart") | p.contains("_cubit.dart"), 1).otherwise(2)
    best = files.filter(p.isNotNull()).groupBy("path").agg(F.min(F.struct(level.alias("level"), "pos")).alias("m")).orderBy("m", "path").limit(k)
    return best.select("path", F.row_number().over(Window.orderBy("m", "path")).alias("rank"))
