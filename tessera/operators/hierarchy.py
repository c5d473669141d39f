"""Parent-child links to full hierarchies by pointer doubling.

Every node starts with a pointer to its parent.  A round joins pointers with
pointers, so the distance doubles and the path segments are concatenated;
a tree of depth d is finished after log2(d) + 1 rounds, whatever its shape.
Nodes whose pointer has reached a root drop out of the joins, but for those
that an open node points at: the others are scanned, never shuffled again.
A round that finishes no node proves that the rest lies on loops or below them.

One ancestor may be the pointer of a third of all nodes: the few hot ones are
counted in each round, their pointer rows copied under salts, and the many
rows that point at them spread over these.

All joins are merges.  A staged table's files are far smaller than its rows
(paths repeat one another), so that by its files it would be broadcast, through
the driver, at sizes that the driver can't hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import hot_keys, salt_of, salts_of
from tessera.sources.tables import drop, stage, together


def chosen_parents(links: DataFrame) -> DataFrame:
    """(id, parent): of several parents the one of the smallest edge_id.

    ``links`` has parent, child, edge_id.  Equal edge ids go to the smaller
    parent name.
    """
    return (
        links.groupBy(F.col("child").alias("id"))
        .agg(F.min(F.struct("edge_id", "parent")).alias("first"))
        .select("id", F.col("first.parent").alias("parent"))
    )


def _follow(left: DataFrame, right: DataFrame, n: int, *columns):
    """Join each of the ``n`` rows of ``left`` with the pointer row of its ancestor."""
    hot = hot_keys(left, "anc", n)
    copies = right.withColumn("salt", salts_of(F.col("id"), hot)).alias("r")
    spread = left.withColumn("salt", salt_of(F.col("anc"), hot, F.col("id"))).alias("l")
    return spread.join(copies.hint("merge"), (F.col("l.anc") == F.col("r.id")) & (F.col("l.salt") == F.col("r.salt"))).select(*columns)


def hierarchies(links: DataFrame) -> DataFrame:
    """(id, root_id, depth, path) for each name that occurs in ``links``.

    ``links`` has the columns parent, child (non-null strings) and edge_id.
    ``path`` is the array of names from the root to the node.

    * a name without parent is a root: depth 0, path [id];
    * a name on a loop, self-loops included: depth -1, empty path;
    * a name below a loop: depth -2, empty path; both have the smallest name
      (by bytes) on that loop as root_id;
    * no links: no rows.  Repeated and parallel links change nothing.
    """
    parents = stage(chosen_parents(links), "parents")
    nothing = F.array().cast("array<string>")
    row = lambda anc, dist, below, ended: ["id", anc.alias("anc"), F.lit(dist).alias("dist"), below.alias("below"), F.lit(ended).alias("ended")]
    # below: the names from just under the ancestor down to the node
    roots = links.select(F.col("parent").alias("id")).distinct().join(parents.select("id").hint("merge"), "id", "left_anti")
    roots = stage(roots.select(*row(F.col("id"), 0, nothing, True)), "roots")
    open_ = stage(parents.select(*row(F.col("parent"), 1, F.array("id"), False)), "open")
    done, n_open = [roots], open_.count()
    while n_open:
        # of the finished names only those that an open one points at meet in the join
        needed = together(*done).filter("ended").join(open_.select(F.col("anc").alias("id")).distinct().hint("merge"), "id", "left_semi")
        hop = stage(
            _follow(
                open_,
                needed.unionByName(open_),
                n_open,
                F.col("l.id").alias("id"),
                F.col("r.anc").alias("anc"),
                (F.col("l.dist") + F.col("r.dist")).alias("dist"),
                F.concat("r.below", "l.below").alias("below"),
                F.col("r.ended").alias("ended"),
            ),
            "hop",
        )
        still = hop.filter("NOT ended").count()
        if still == n_open:
            drop(hop)
            break
        done.append(hop)
        open_, n_open = hop.filter("NOT ended"), still
    ended = together(*done).filter("ended")
    trees = ended.select("id", F.col("anc").alias("root_id"), F.col("dist").alias("depth"), F.concat(F.array("anc"), "below").alias("path"))
    if not n_open:
        drop(parents)
        return trees
    loops = _loops(open_.select("id").join(parents.hint("merge"), "id"), n_open)
    drop(parents)
    return trees.unionByName(loops)


def _loops(rest: DataFrame, n: int) -> DataFrame:
    """Rows for the names on and below loops; ``rest`` has id and parent.

    Pointers double, and the least name of the steps is carried along.  What
    pointers point at shrinks with every doubling until it is just the loops;
    once a doubling changes neither the number of these nor any least name, each
    least name on a loop is that of the whole loop (a window of m steps that
    equals its neighbours m steps on covers the loop).  So the rounds are
    logarithmic in the longest tail or loop, not in the number of names.
    """
    at = stage(rest.select("id", F.col("parent").alias("anc"), F.col("id").alias("low"), F.lit(True).alias("fresh")), "loop")
    ends = at.select("anc").distinct().count()
    while True:
        low = F.least("l.low", "r.low")
        new = stage(_follow(at, at, n, F.col("l.id").alias("id"), F.col("r.anc").alias("anc"), low.alias("low"), (low != F.col("l.low")).alias("fresh")), "loop")
        n_ends, fresh = new.agg(F.countDistinct("anc"), F.count_if("fresh")).first()
        drop(at)
        at = new
        if n_ends == ends and not fresh:
            break
        ends = n_ends
    on = at.select(F.col("anc").alias("id")).distinct().withColumn("on_loop", F.lit(True))
    found = _follow(at, at, n, F.col("l.id").alias("id"), F.col("r.low").alias("root_id"))
    rows = found.join(on.hint("merge"), "id", "left").select(
        "id",
        "root_id",
        F.when(F.col("on_loop"), -1).otherwise(-2).alias("depth"),
        F.array().cast("array<string>").alias("path"),
    )
    out = stage(rows, "loops")
    drop(at)
    return out


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant, distance): each node with all nodes below it.

    Follows from the paths: each name on a path has the last one below it.
    Names on and below loops have no path and no rows.
    """
    return (
        tree.filter(F.size("path") > 1)
        .select(F.col("id").alias("descendant"), F.col("depth"), F.posexplode("path").alias("pos", "id"))
        .filter(F.col("pos") < F.col("depth"))
        .select("id", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
    )
