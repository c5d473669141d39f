"""Incremental maintenance: what changed since the last snapshot, and the merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import extract, search
from tessera.operators.vector import Encoder, embedding_text, encoded
from tessera.sources.tables import stage


def hashes(files: DataFrame) -> DataFrame:
    """(path, sha256) of each file with content."""
    return files.filter("content IS NOT NULL").select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): new, changed or deleted paths between two hash snapshots; equal ones are left out."""
    a, b = old.select("path", F.col("sha256").alias("a")), new.select("path", F.col("sha256").alias("b"))
    kind = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change")).filter("change IS NOT NULL")


def affected_ids(changed: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, change): the names whose file is among the changes."""
    return mapping.select("id", "path").join(changed, "path").select("id", "change").distinct()


def merged(kept: DataFrame, fresh: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Old rows that are neither refreshed nor gone, with the fresh ones."""
    out = fresh.select(key).unionByName(gone.select(key)).distinct()
    return kept.join(out, key, "left_anti").unionByName(fresh)


def refresh_vectors(old_vectors: DataFrame, old_hashes: DataFrame, files: DataFrame, documents: DataFrame, mapping: DataFrame, encoder: Encoder) -> dict[str, DataFrame]:
    """Bring a vector store up to date.

    ``documents`` has id and document for all names of the present graph,
    ``mapping`` id and path.  Names in new or changed files, and names without
    a vector, are encoded; names that are no longer mapped go.  The result
    equals encoding everything, at the cost of what changed.
    Returns vectors (id, file, vec), hashes and one row of statistics.
    """
    now = stage(hashes(files), "hashes")
    diff = stage(changes(old_hashes, now), "changes")
    live = mapping.select("id", F.col("path").alias("file")).filter("file IS NOT NULL")
    stale = affected_ids(diff.filter("change <> 'deleted'"), mapping).select("id").distinct()
    absent = live.select("id").join(old_vectors.select("id"), "id", "left_anti")
    todo = documents.join(stale.unionByName(absent).distinct(), "id", "left_semi").join(live, "id")
    fresh = stage(todo.select("id", "file", encoded(F.col("document"), encoder).alias("vec")), "fresh")
    gone = stage(old_vectors.select("id").join(live.select("id"), "id", "left_anti"), "gone")
    vectors = stage(merged(old_vectors.select("id", "file", "vec"), fresh, gone), "vectors")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(1))
    stats = count(vectors, "total").join(count(fresh, "encoded"), "_k").join(count(gone, "deleted"), "_k")
    return {"vectors": vectors, "hashes": now, "stats": stats.withColumn("unchanged", F.col("total") - F.col("encoded")).drop("_k")}


def documents_of(graph: dict[str, DataFrame], files: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(id, document): the text to embed of each node of a graph; ``files`` has each path once."""
    rows = graph["nodes"].join(graph["file_map"].select("id", "path"), "id", "left").join(files.select("path", "content"), "path", "left")
    shown = search.class_window(rows, "id")
    if lexicon is None:
        return embedding_text(shown.withColumn("synonyms", F.lit(None).cast("string")))
    words = search.with_synonyms(graph["nodes"], "id", search.camel_words(F.col("id")), lexicon, ", ")
    return embedding_text(shown.join(words, "id", "left"))


def rebuilt(files: DataFrame, old_vectors: DataFrame, old_hashes: DataFrame, lexicon: DataFrame | None, encoder: Encoder, parser: str = "regex") -> dict[str, DataFrame]:
    """Files to graph and vectors in one go: vectors, hashes, stats, and the graph they belong to."""
    graph = {name: stage(df, name) for name, df in extract.knowledge_graph(files, parser).items()}
    return {**refresh_vectors(old_vectors, old_hashes, files, documents_of(graph, files, lexicon), graph["file_map"], encoder), "graph": graph}
