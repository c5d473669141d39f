"""The queries of the general problems, on the tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import name_or_null
from tessera.operators.hierarchy import descendants, hierarchies
from tessera.operators.orphans import child_rows, orphan_references, orphan_report, parent_rows
from tessera.sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    nodes, files = table(spark, d, "kg_nodes"), table(spark, d, "src_files")
    edges, mapping = table(spark, d, "kg_edges"), table(spark, d, "file_mapping")
    c = F.col
    return orphan_references(
        [
            parent_rows(nodes, "kg_nodes", c("id"), c("indexed_at"), c("deleted_at")),
            parent_rows(files, "src_files", c("path"), c("scanned_at"), c("deleted_at")),
        ],
        [
            child_rows(edges, "kg_nodes", "kg_edges", c("edge_id"), "dst", name_or_null("dst"), c("seen_at")),
            child_rows(mapping, "kg_nodes", "file_mapping", c("map_id"), "id", name_or_null("id"), c("mapped_at")),
            child_rows(mapping, "src_files", "file_mapping", c("map_id"), "path", name_or_null("path"), c("mapped_at")),
        ],
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def part_links(edges: DataFrame) -> DataFrame:
    """routes_to and has_part edges as (parent, child, edge_id)."""
    return (
        edges.filter(F.lower(name_or_null("edge_type")).isin("routes_to", "has_part"))
        .select(name_or_null("src").alias("parent"), name_or_null("dst").alias("child"), "edge_id")
        .filter(F.col("parent").isNotNull() & F.col("child").isNotNull())
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchies(part_links(table(spark, d, "kg_edges")))
    return tree.select("id", "root_id", F.col("depth").cast("int").alias("depth"), F.array_join("path", "/").alias("node_path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchies(part_links(table(spark, d, "kg_edges")))).withColumn("distance", F.col("distance").cast("int"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_descendants": p4_descendants}

_TRIM = "chr(32) || chr(9) || chr(10)"

_P3 = f"""
WITH refs AS (
  SELECT 'kg_edges' AS tbl, edge_id AS row_id, 'dst' AS field, 'kg_nodes' AS pt, nullif(trim(dst, {_TRIM}), '') AS k, seen_at AS t FROM kg_edges
  UNION ALL SELECT 'file_mapping', map_id, 'id', 'kg_nodes', nullif(trim(id, {_TRIM}), ''), mapped_at FROM file_mapping
  UNION ALL SELECT 'file_mapping', map_id, 'path', 'src_files', nullif(trim(path, {_TRIM}), ''), mapped_at FROM file_mapping
), lives AS (
  SELECT 'kg_nodes' AS pt, id AS k, indexed_at AS b, deleted_at AS e FROM kg_nodes
  UNION ALL SELECT 'src_files', path, scanned_at, deleted_at FROM src_files
), judged AS (
  SELECT r.tbl, r.row_id, r.field, r.t,
         count(l.pt) AS n_rows,
         count(*) FILTER (WHERE l.b <= r.t) AS n_begun,
         count(*) FILTER (WHERE l.b <= r.t AND (l.e IS NULL OR l.e > r.t)) AS n_alive
  FROM refs r LEFT JOIN lives l ON l.pt = r.pt AND l.k = r.k
  WHERE r.k IS NOT NULL
  GROUP BY r.tbl, r.row_id, r.field, r.t
), orphans AS (
  SELECT tbl, row_id, field,
         CASE WHEN n_rows = 0 THEN 'missing' WHEN t IS NULL THEN NULL
              WHEN n_begun = 0 THEN 'late' WHEN n_alive = 0 THEN 'deleted' END AS kind,
         coalesce(strftime(t, '%Y-%m'), 'none') AS period
  FROM judged
)
"""

_P4 = f"""
WITH RECURSIVE links AS (
  SELECT trim(src, {_TRIM}) AS parent, trim(dst, {_TRIM}) AS child, edge_id FROM kg_edges
  WHERE lower(trim(edge_type, {_TRIM})) IN ('routes_to', 'has_part')
    AND trim(src, {_TRIM}) <> '' AND trim(dst, {_TRIM}) <> ''
), parents AS (SELECT child AS id, arg_min(parent, edge_id) AS parent FROM links GROUP BY child),
names AS (SELECT parent AS id FROM links UNION SELECT child FROM links),
tree AS (
  SELECT n.id, n.id AS root_id, 0 AS depth, n.id AS node_path FROM names n WHERE n.id NOT IN (SELECT id FROM parents)
  UNION ALL
  SELECT p.id, t.root_id, t.depth + 1, t.node_path || '/' || p.id FROM tree t JOIN parents p ON p.parent = t.id
), rest AS (SELECT p.* FROM parents p WHERE p.id NOT IN (SELECT id FROM tree)),
reach AS (
  SELECT id, parent AS up FROM rest
  UNION
  SELECT r.id, p.parent FROM reach r JOIN rest p ON p.id = r.up
), on_loop AS (SELECT id FROM reach WHERE id = up),
found AS (
  SELECT id, root_id, CAST(depth AS INT) AS depth, node_path FROM tree
  UNION ALL
  SELECT r.id, min(r.up), CASE WHEN r.id IN (SELECT id FROM on_loop) THEN -1 ELSE -2 END, ''
  FROM reach r WHERE r.up IN (SELECT id FROM on_loop) GROUP BY r.id
)
"""

ORACLES = {
    "p3_found": _P3 + "SELECT * FROM orphans WHERE kind IS NOT NULL",
    "p3_report": _P3 + "SELECT tbl, field, kind, period, count(*) AS n FROM orphans WHERE kind IS NOT NULL GROUP BY ALL",
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_descendants": _P4
    + """, below AS (
      SELECT p.parent AS id, p.id AS descendant, 1 AS distance FROM parents p WHERE p.id IN (SELECT id FROM tree)
      UNION ALL
      SELECT p.parent, b.descendant, b.distance + 1 FROM below b JOIN parents p ON p.id = b.id
    ) SELECT id, descendant, CAST(distance AS INT) AS distance FROM below""",
}
