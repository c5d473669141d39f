"""The queries of the training-data problems, on the tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import name_or_null
from tessera.llm.bpe import TOKENIZERS_DIR, token_count, token_ids
from tessera.llm.mixture import mixture, shares
from tessera.llm.neighbours import exact_nearest, nearest, neighbour_pairs, recall
from tessera.llm.setjoin import similar_sets
from tessera.llm.sourcefiles import CUT, foreign_files
from tessera.llm.subjects import composition, subject_areas
from tessera.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    scored = foreign_files(table(spark, d, "src_files"), table(spark, d, "vendor_index"))
    return scored.filter(F.col("known") | (F.col("score") >= CUT)).select("file_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs(nearest(table(spark, d, "vector_db"), "vec_id", "embeddings"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours with the class and the file of both sides."""
    vectors = table(spark, d, "vector_db")
    of = vectors.select("vec_id", F.col("metadata.id").alias("class_id"), F.col("metadata.file").alias("file"))
    other = of.toDF("neighbour", "neighbour_class", "neighbour_file")
    return nearest(vectors, "vec_id", "embeddings").withColumn("similarity", F.round("similarity", 9)).join(of, "vec_id").join(other, "neighbour")


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the neighbours of every vector whose id is divisible by 50, against all vectors."""
    vectors = table(spark, d, "vector_db")
    return recall(nearest(vectors, "vec_id", "embeddings"), exact_nearest(vectors, "vec_id", "embeddings"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """How much of the corpus each subject area has."""
    return composition(_subjects(spark, d), table(spark, d, "subject_areas"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p5_sets(spark: SparkSession, d: str) -> DataFrame:
    """The sets of members per class and of bound classes per module."""
    nothing = F.array().cast("array<string>")
    members = (
        table(spark, d, "kg_nodes")
        .groupBy("id")
        .agg(F.min_by(F.struct("methods", "events"), "node_row").alias("first"))
        .select(F.lit("members").alias("set_name"), "id", F.concat(F.coalesce("first.methods", nothing), F.coalesce("first.events", nothing)).alias("items"))
    )
    binds = (
        table(spark, d, "kg_edges")
        .filter(F.lower(name_or_null("edge_type")) == "binds")
        .select(name_or_null("src").alias("id"), name_or_null("dst").alias("item"))
        .filter("id IS NOT NULL AND item IS NOT NULL")
        .distinct()
        .groupBy("id")
        .agg(F.collect_list("item").alias("items"))
        .select(F.lit("binds").alias("set_name"), "id", "items")
    )
    return members.unionByName(binds)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_sets(p5_sets(spark, d)).select("set_name", "id_a", "id_b")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_ids(spark, F.col("text"), folder=TOKENIZERS_DIR).alias("ids"))


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", F.col("source"), token_count(spark, F.col("text"), folder=TOKENIZERS_DIR))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(_mixture(spark, d), table(spark, d, "mix_targets"), "doc_id")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p2_recall": p2_recall, "p5_found": p5_found, "p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_composition": p8_composition}

_TRIM = "chr(32) || chr(9) || chr(10)"

_P2 = """
WITH good AS (SELECT vec_id, embeddings::DOUBLE[] AS v, metadata.id AS c, metadata.file AS f FROM vector_db
  WHERE len(embeddings) = 384 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM good a JOIN good b ON a.vec_id <> b.vec_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) AS nth FROM pairs) WHERE nth <= 10)
"""

ORACLES = {
    "p2_found": _P2 + "SELECT DISTINCT least(vec_id, neighbour) AS vec_a, greatest(vec_id, neighbour) AS vec_b FROM top",
    "p2_neighbours": _P2
    + """SELECT t.vec_id, t.neighbour, round(t.s, 9) AS similarity, a.c AS class_id, a.f AS file, b.c AS neighbour_class, b.f AS neighbour_file
FROM top t JOIN good a ON a.vec_id = t.vec_id JOIN good b ON b.vec_id = t.neighbour""",
    "p5_found": f"""
WITH firsts AS (SELECT id, arg_min({{'m': methods, 'e': events}}, node_row) AS f FROM kg_nodes GROUP BY id),
items AS (
  SELECT 'members' AS set_name, id, unnest(list_distinct(list_concat(coalesce(f.m, []), coalesce(f.e, [])))) AS item FROM firsts
  UNION ALL
  SELECT DISTINCT 'binds', trim(src, {_TRIM}), trim(dst, {_TRIM}) FROM kg_edges
  WHERE lower(trim(edge_type, {_TRIM})) = 'binds' AND trim(src, {_TRIM}) <> '' AND trim(dst, {_TRIM}) <> ''
), kept AS (SELECT * FROM items WHERE item IS NOT NULL),
sizes AS (SELECT set_name, id, count(*) AS n FROM kept GROUP BY ALL HAVING count(*) >= 4),
big AS (SELECT k.*, s.n FROM kept k JOIN sizes s USING (set_name, id)),
shared AS (
  SELECT a.set_name, a.id AS id_a, b.id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM big a JOIN big b ON a.set_name = b.set_name AND a.item = b.item AND a.id < b.id GROUP BY a.set_name, a.id, b.id
)
SELECT set_name, id_a, id_b FROM shared WHERE c >= 0.6 * (na + nb - c)""",
}
