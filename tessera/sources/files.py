"""Source trees, stored graphs, vector stores and hash stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.sources.tables import _file_system


def _sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of all Dart files below ``root``; paths are relative to it.

    The root is qualified by its file system, as the reader's paths are, and
    cut off by its length: no character in it has a meaning.
    """
    where, fs = _file_system(spark, root)
    base = fs.makeQualified(where).toString().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dart").load(root)
    return raw.select(F.substring("path", len(base) + 2, 1 << 20).alias("path"), F.col("content").alias("bytes"))


def _decoded(rows: DataFrame) -> DataFrame:
    return rows.select("repo", "path", F.expr("make_valid_utf8(cast(bytes AS string))").alias("content"), F.sha2("bytes", 256).alias("sha256"))


def scan(spark: SparkSession, root: str, prefix: str = "", generated: bool = False) -> DataFrame:
    """(repo, path, content, sha256) of the Dart files of all repos under ``root``.

    A repo is a folder whose name begins with ``prefix``; only what lies under
    its ``lib`` is read.  Files ending in ``.g.dart`` are left out unless
    ``generated``.  Bytes that are no UTF-8 become replacement characters.
    Files of length zero have no row: the reader skips them, and they declare
    nothing.  ``path`` begins with the repo.
    """
    rows = _sources(spark, root).withColumn("repo", F.split("path", "/")[0]).filter(F.col("repo").startswith(prefix) & (F.split("path", "/")[1] == "lib"))
    return _decoded(rows if generated else rows.filter(~F.col("path").endswith(".g.dart")))


def scan_tree(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """(repo, path, content, sha256) of every Dart file below ``root``, generated ones too; no rows where there is no such folder."""
    where, fs = _file_system(spark, root)
    if not fs.exists(where):
        return spark.createDataFrame([], schema.FILES)
    return _decoded(_sources(spark, root).withColumn("repo", F.lit(repo)))


def without_bad_bytes(content):
    """Text with replacement characters dropped and line ends unified."""
    return F.regexp_replace(F.regexp_replace(content, "�", ""), "\r\n?", "\n")


def save_graph(graph: dict[str, DataFrame], path: str, parser: str = "regex") -> None:
    """Nodes, edges and file mapping as Parquet, with one row about the parser."""
    for name, df in graph.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    next(iter(graph.values())).sparkSession.createDataFrame([(parser,)], "parser string").write.mode("overwrite").parquet(f"{path}/about")


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "file_map")}


def save_graph_json(graph: dict[str, DataFrame], path: str) -> None:
    """One JSON line per row, a folder for each relation; non-ASCII text is kept."""
    for name, df in graph.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def load_graph_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A graph of one JSON document: nodes, edges with from/to/type, and a mapping of names to paths or to objects with path and line."""
    text = spark.read.text(path, wholetext=True)
    node = schema.NODES.replace("node_type string", "type string")
    edge = "`from` string, `to` string, type string, shared_usecases array<string>"
    whole = text.select(F.from_json("value", f"nodes array<struct<{_fields(node)}>>, edges array<struct<{_fields(edge)}>>, file_mapping map<string,string>").alias("g"))
    nodes = whole.select(F.inline("g.nodes")).withColumnRenamed("type", "node_type")
    edges = whole.select(F.inline("g.edges")).toDF("src", "dst", "edge_type", "shared_usecases")
    entry = whole.select(F.explode("g.file_mapping").alias("id", "v")).withColumn("o", F.from_json("v", "path string, line int"))
    mapping = entry.select("id", F.coalesce("o.path", "v").alias("path"), F.coalesce("o.line", F.lit(1)).alias("line"))
    return {"nodes": nodes, "edges": edges, "file_map": mapping}


def _fields(ddl: str) -> str:
    return ", ".join(f"{part.split(' ', 1)[0]}: {part.split(' ', 1)[1]}" for part in ddl.split(", "))


def swap(df: DataFrame, path: str) -> None:
    """Write a new snapshot beside the old one, then put it in its place.

    The old snapshot is there until the new one is complete, and is deleted
    only when the new one has its name: at any moment one of the two is whole.
    """
    df.write.mode("overwrite").parquet(f"{path}.new")
    new, fs = _file_system(df.sparkSession, f"{path}.new")
    here, _ = _file_system(df.sparkSession, path)
    aside, _ = _file_system(df.sparkSession, f"{path}.old")
    fs.delete(aside, True)
    if fs.exists(here) and not fs.rename(here, aside):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, here):
        raise OSError(f"can't rename to {path}")
    fs.delete(aside, True)


def _stored(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A snapshot, or the one before it where a swap broke off, or no rows."""
    for at in (path, f"{path}.old"):
        where, fs = _file_system(spark, at)
        if fs.exists(where):
            return spark.read.schema(ddl).parquet(at)
    return spark.createDataFrame([], ddl)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """The vector store: (id, file, vec) as Parquet, the old one readable until the new one is whole."""
    swap(vectors.select("id", "file", F.col("vec").cast("array<float>").alias("vec")), f"{path}/vectors")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The stored vectors; none where nothing is stored yet."""
    return _stored(spark, f"{path}/vectors", schema.VECTORS)


def save_hashes(hashes: DataFrame, path: str) -> None:
    """The hash store: (path, sha256) of the files that the vectors were made of."""
    swap(hashes.select("path", "sha256"), f"{path}/hashes")


def load_hashes(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, f"{path}/hashes", schema.HASHES)


def missing_files(spark: SparkSession, names: list[str], present: DataFrame) -> DataFrame:
    """(path, present): which of the required files there are; ``present`` has path."""
    need = spark.createDataFrame([(n,) for n in names], "path string")
    return need.join(present.select("path").distinct().withColumn("here", F.lit(True)), "path", "left").select("path", F.coalesce("here", F.lit(False)).alias("present"))


#: The kinds of editor, the files that each reads its rules from, and the templates these are made of.
EDITORS = {
    "kiro": {".kiro/steering/00-workflow.md": "kiro/00-workflow.md", ".kiro/steering/session-lifecycle.md": "kiro/session-lifecycle.md"},
    "antigravity": {"GEMINI.md": "workflow_full.md"},
    "cursor": {".cursorrules": "workflow_full.md"},
    "windsurf": {".windsurfrules": "workflow_full.md"},
    "claude-code": {"CLAUDE.md": "workflow_full.md"},
    "codex": {"AGENTS.md": "workflow_full.md"},
}


def _rules_of(editor: str) -> dict[str, str]:
    if editor.lower() not in EDITORS:
        raise ValueError(f"no editor {editor!r}; there are {', '.join(EDITORS)}")
    return EDITORS[editor.lower()]


def copy_templates(spark: SparkSession, source: str, target: str, files: dict[str, str] | None = None) -> DataFrame:
    """(path, status): copy text files below ``source`` to ``target``, skipping those that exist.

    ``files`` names the copies and their templates; without it every file below
    ``source`` is copied under its own name.
    """
    src, fs = _file_system(spark, source)
    dst, out = _file_system(spark, target)
    jvm, rows = spark.sparkContext._jvm, []
    Path = jvm.org.apache.hadoop.fs.Path
    if files is None:
        base, found, each = fs.getFileStatus(src).getPath().toUri().getPath(), fs.listFiles(src, True), []
        while found.hasNext():
            name = found.next().getPath().toUri().getPath()[len(base) :].lstrip("/")
            each.append((name, name))
    else:
        each = list(files.items())
    for name, template in each:
        to = Path(dst, name)
        if out.exists(to):
            rows.append((name, "skipped"))
            continue
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, Path(src, template), out, to, False, spark.sparkContext._jsc.hadoopConfiguration())
        rows.append((name, "created"))
    return spark.createDataFrame(sorted(rows), "path string, status string")


def init_rules(spark: SparkSession, templates: str, project: str, editor: str = "kiro") -> DataFrame:
    """(path, status): put an editor's rule files into a project; those that are there stay."""
    rules = _rules_of(editor)
    where, fs = _file_system(spark, project)
    if not fs.exists(where):
        raise ValueError(f"no project {project}")
    return copy_templates(spark, templates, project, rules)


def check_rules(spark: SparkSession, project: str, editor: str = "kiro") -> DataFrame:
    """(path, present): which of an editor's rule files a project has."""
    where, fs = _file_system(spark, project)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = list(_rules_of(editor))
    there = [(n,) for n in names if fs.exists(Path(where, n))]
    return missing_files(spark, names, spark.createDataFrame(there, "path string"))
