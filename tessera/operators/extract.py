"""Source files to nodes, edges and file mapping.

Input everywhere: files with repo, path and content.  The canonical order is
that of (repo, path, position); where the data bring their own row order, its
column can be given instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dart
from tessera.functions.declarations import injected, top_level

_NONE = "array<string>"


def _strings() -> Column:
    return F.array().cast(_NONE)


def _is_part() -> Column:
    return dart.part_file(F.col("path"))


def declared_classes(files: DataFrame, parser: str = "regex") -> DataFrame:
    """The files with each of their classes: pos, name, base, line.

    ``parser`` is ``regex`` (classes only, inheriting ones first) or ``scan``
    (classes, mixins and extensions of the top level in their order).  Part
    files and null contents have none.
    """
    source = files.filter(~_is_part() & F.col("content").isNotNull())
    if parser == "scan":
        found = source.select("*", F.posexplode(top_level(F.col("content"))).alias("pos", "d"))
        return found.select("*", F.col("d.name").alias("name"), F.col("d.base").alias("base"), F.col("d.line").alias("line")).drop("d")
    found = source.select("*", F.posexplode(dart.declared(F.col("content"))).alias("pos", "d"))
    return found.select("*", F.col("d.name").alias("name"), F.col("d.base").alias("base")).drop("d").withColumn("line", dart.class_line(F.col("content"), F.col("name")))


def class_nodes(files: DataFrame, parser: str = "regex") -> DataFrame:
    """One row per declared class with everything the file says."""
    c = F.col("content")
    facts = {
        "methods": dart.methods(c),
        "events": dart.events(c),
        "api_paths": dart.api_paths(c),
        "route_paths": dart.route_paths(c),
        "error_types": dart.error_types(c),
    }
    kind = dart.node_type(F.col("name"), F.col("base"))
    rows = declared_classes(files, parser).withColumns(facts).withColumn("node_type", kind)
    return rows.select(
        F.col("name").alias("id"),
        "node_type",
        "repo",
        F.col("base").alias("base_class"),
        dart.summary(F.col("node_type"), F.col("base"), F.col("methods"), F.col("events"), F.col("api_paths")).alias("summary"),
        F.col("line").alias("start_line"),
        *facts,
        F.lit(None).cast(_NONE).alias("classes"),
        "path",
        "pos",
    )


def part_nodes(files: DataFrame) -> DataFrame:
    """One row per part file that declares events or states."""
    rows = files.filter(_is_part()).withColumn("classes", dart.part_classes(F.col("content"))).filter(F.size("classes") > 0)
    empty = [_strings().alias(x) for x in ("methods", "events", "api_paths", "route_paths", "error_types")]
    return rows.select(
        dart.part_id(F.col("path")).alias("id"),
        F.when(F.col("path").endswith("_event.dart"), "Event").otherwise("State").alias("node_type"),
        "repo",
        F.lit(None).cast("string").alias("base_class"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("int").alias("start_line"),
        *empty,
        "classes",
        "path",
        F.lit(0).alias("pos"),
    )


def main_classes(files: DataFrame, parser: str = "regex") -> DataFrame:
    """The files with their first class, to which all edges of a file belong."""
    if parser == "scan":
        return declared_classes(files, parser).filter("pos = 0").withColumnRenamed("name", "main").drop("base", "line", "pos")
    return files.filter(~_is_part()).withColumn("main", F.get(dart.declared(F.col("content")), F.lit(0))["name"]).filter("main IS NOT NULL")


def code_edges(files: DataFrame, parser: str = "regex") -> DataFrame:
    """depends_on, binds and routes_to edges of each file's first class, in order."""
    main = main_classes(files, parser)

    def of(kind: str, targets: Column, own: bool) -> DataFrame:
        rows = main.select("repo", "path", F.col("main").alias("src"), F.posexplode(targets).alias("pos", "dst"), F.lit(kind).alias("edge_type"))
        return rows if own else rows.filter("src <> dst")

    c = F.col("content")
    return of("depends_on", dart.looked_up(c), False).unionByName(of("binds", dart.bound(c), False)).unionByName(of("routes_to", dart.routed(c), True))


def part_edges(files: DataFrame) -> DataFrame:
    """has_part edges from the bloc that a part file's name suggests."""
    return part_nodes(files).select("repo", "path", dart.bloc_of(F.col("id")).alias("src"), F.lit(0).alias("pos"), F.col("id").alias("dst"), F.lit("has_part").alias("edge_type"))


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key; a key's rows need not fit one task: the ranks are cut before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def first_nodes(nodes: DataFrame, *order) -> DataFrame:
    """Nodes by class name: the first occurrence wins."""
    return first_per(nodes, ["id"], *(order or ("repo", "path", "pos")))


def last_mapping(mapping: DataFrame, *order) -> DataFrame:
    """File mapping by class name: the last occurrence wins; a missing line is 1."""
    order = order or ("repo", "path", "pos")
    back = [F.col(c).desc() if isinstance(c, str) else c for c in order]
    return first_per(mapping, ["id"], *back).withColumn("line", F.coalesce("line", F.lit(1)))


def distinct_edges(edges: DataFrame, *order) -> DataFrame:
    """Edges by (src, dst, edge_type): the first occurrence wins."""
    return first_per(edges, ["src", "dst", "edge_type"], *(order or ("repo", "path", "pos")))


def similar_to(edges: DataFrame, at_most: int = 3) -> DataFrame:
    """similar_to edges between modules that bind a common use case.

    src < dst by bytes; ``shared_usecases`` are the first ``at_most`` common
    ones by name.  A use case bound by many modules makes many pairs: that is
    the result's own size.
    """
    uses = edges.filter((F.col("edge_type") == "binds") & F.col("dst").contains("UseCase")).select("src", "dst").distinct()
    a, b = uses.toDF("src", "uc"), uses.toDF("dst", "uc")
    pairs = a.join(b, "uc").filter("src < dst").groupBy("src", "dst").agg(F.slice(F.sort_array(F.collect_list("uc")), 1, at_most).alias("shared_usecases"))
    return pairs.select("src", "dst", F.lit("similar_to").alias("edge_type"), "shared_usecases")


def knowledge_graph(files: DataFrame, parser: str = "regex") -> dict[str, DataFrame]:
    """nodes, edges and file_map of a tree of sources, without repeats."""
    found = class_nodes(files, parser).unionByName(part_nodes(files))
    mapping = found.select("id", "path", F.col("start_line").alias("line"), "repo", "pos")
    plain = distinct_edges(code_edges(files, parser).unionByName(part_edges(files))).select("src", "dst", "edge_type")
    edges = plain.unionByName(similar_to(plain), allowMissingColumns=True)
    return {"nodes": first_nodes(found).drop("path", "pos"), "edges": edges, "file_map": last_mapping(mapping).select("id", "path", "line")}


def script_graph(files: DataFrame) -> dict[str, DataFrame]:
    """The smaller graph of the script extractor: four node types, constructor dependencies."""
    classes = declared_classes(files, "scan")
    nodes = first_nodes(
        classes.select(F.col("name").alias("id"), dart.script_type(F.col("name"), F.col("base")).alias("node_type"), "repo", "path", "pos").filter("node_type IS NOT NULL")
    )
    edges = files.filter(F.col("content").isNotNull()).select("repo", "path", F.posexplode(injected(F.col("content"))).alias("pos", "d"))
    return {
        "nodes": nodes.select("id", "node_type", F.lit("script").alias("parser")),
        "edges": edges.select(F.col("d.owner").alias("src"), F.col("d.type").alias("dst"), F.lit("depends_on").alias("edge_type")),
        "file_map": nodes.select("id", "path"),
    }
