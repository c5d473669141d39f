"""The tools of the analysis server: a name, arguments, and a DataFrame or text as the answer.

A ``Workspace`` holds the stored relations; ``call`` runs a tool by name,
``serve`` answers one request per line.  Tools that need the network are not
part of it.  Texts are read from the indexed files only, never from a path of
the machine.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import extract, graph, incremental, search
from tessera.operators.communities import communities, community_profiles
from tessera.operators.vector import Encoder, hashing_encoder
from tessera.plans import context
from tessera.sources.files import check_rules, init_rules, load_graph, load_hashes, load_vectors, save_graph, save_hashes, save_vectors
from tessera.sources.tables import scratch


@dataclass
class Workspace:
    """nodes, edges, mapping (id, path, line), files (repo, path, content), vectors (id, vec), lexicon (token, synonyms)."""

    nodes: DataFrame
    edges: DataFrame
    mapping: DataFrame
    files: DataFrame
    vectors: DataFrame | None = None
    lexicon: DataFrame | None = None
    encoder: Encoder = hashing_encoder()
    store: str | None = None  # folder of the stored vectors and hashes
    templates: str | None = None  # folder of the editors' rule templates

    def _latest(self) -> DataFrame:
        """The files, each path once: of one scanned several times the latest scan, then the greatest hash."""
        order = [F.col(c).desc_nulls_last() for c in ("scanned_at", "file_id", "sha256") if c in self.files.columns] or [F.xxhash64("content")]
        return extract.first_per(self.files.filter("path IS NOT NULL"), ["path"], *order)

    def build_db(self, parser: str = "regex") -> DataFrame:
        """Bring the stored vectors up to date with the files; one row: total, encoded, unchanged, deleted.

        The graph is extracted again, so new files get vectors; what hasn't
        changed since the stored hashes keeps its vector.
        """
        if self.store is None:
            raise ValueError("the workspace has no store")
        spark = self.files.sparkSession
        found = incremental.rebuilt(self._latest(), load_vectors(spark, self.store), load_hashes(spark, self.store), self.lexicon, self.encoder, parser)
        save_vectors(found["vectors"], self.store)
        save_hashes(found["hashes"], self.store)
        save_graph(found["graph"], f"{self.store}/graph", parser)
        graph_ = load_graph(spark, f"{self.store}/graph")
        self.nodes, self.edges, self.mapping, self.vectors = graph_["nodes"], graph_["edges"], graph_["file_map"], load_vectors(spark, self.store)
        return found["stats"]

    def init_steering(self, project_path: str, ide: str = "kiro") -> DataFrame:
        return init_rules(self.files.sparkSession, self.templates or "", project_path, ide)

    def check_steering(self, project_path: str, ide: str = "kiro") -> DataFrame:
        return check_rules(self.files.sparkSession, project_path, ide)

    def list_nodes(self, node_type: str = "", limit: int = 50) -> DataFrame:
        return search.list_nodes(self.nodes, node_type, limit)

    def _located(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.select("id", "node_type", "repo", column).join(self.mapping.select("id", "path"), "id", "left").withColumn("path", F.coalesce("path", F.lit("")))

    def search_by_api_path(self, path: str) -> DataFrame:
        return self._located(search.by_api_path(self.nodes, path), "api_paths")

    def search_by_error_type(self, error_type: str) -> DataFrame:
        return self._located(search.by_error_type(self.nodes, error_type), "error_types")

    def search_by_filename(self, pattern: str, repo: str = "") -> DataFrame:
        return search.by_filename(self.files, self.mapping, pattern, repo)

    def grep_in_files(self, keyword: str, repo: str = "", file_pattern: str = "*.dart", max_results: int = 20, context_lines: int = 3) -> DataFrame:
        name = F.element_at(F.split("path", "/"), -1)
        files = search.searched(self.files, repo).filter(name.rlike(search.glob_regex(file_pattern)))
        return search.grep(files, keyword, context=context_lines, max_files=max_results)

    def get_file_content(self, path: str, start_line: int = 1, end_line: int = 0, class_name: str = "") -> DataFrame:
        """Numbered lines with the first, the last, how many there are and how many follow.

        A class name jumps to the class; 200 lines, or 150 of a class, unless an
        end is given.
        """
        rows = self._latest().filter(F.col("path") == path)
        start = F.lit(start_line)
        if class_name:
            line = self.mapping.filter(F.col("id") == class_name).select(F.lit(path).alias("path"), F.col("line").alias("_line"))
            rows = rows.join(line, "path", "left")
            start = search.class_start(F.col("content"), F.lit(class_name), F.coalesce("_line", F.lit(1)))
        begin = F.greatest(start, F.lit(1))
        count = F.lit(end_line) - begin + 1 if end_line > 0 else F.lit(150 if class_name else 200)
        shown = search.line_window(rows, begin, count)
        more = F.col("total") - F.col("last")
        return shown.withColumn("more_lines", F.greatest(more, F.lit(0)))

    def find_similar_modules(self, module_name: str) -> DataFrame:
        found = graph.similar_modules(self.edges, module_name)
        return found.join(self.nodes.select(F.col("id").alias("module"), "repo"), "module", "left").join(self.mapping.select(F.col("id").alias("module"), "path"), "module", "left")

    def get_blast_radius(self, node_id: str, max_depth: int = 4) -> DataFrame:
        found = graph.blast_radius(self.edges, node_id, max_depth)
        rows = found.join(self.nodes.select("id", "node_type", "repo"), "id", "left").join(self.mapping.select("id", F.col("path").alias("file")), "id", "left")
        return rows.select("id", F.coalesce("node_type", F.lit("Unknown")).alias("node_type"), F.coalesce("repo", F.lit("")).alias("repo"), "depth", "via", "path", F.coalesce("file", F.lit("")).alias("file")).orderBy("node_type", "depth", "id")

    def detect_communities(self, min_size: int = 3) -> DataFrame:
        return community_profiles(communities(self.edges, self.mapping), self.nodes, min_size)

    def get_architecture_overview(self) -> dict[str, DataFrame]:
        between = graph.betweenness(graph.within(self.edges, self.mapping), 5)
        return {
            "graph_stats": graph.graph_stats(self.edges, self.nodes, self.mapping),
            "hub_nodes": graph.hubs(self.edges, self.nodes, self.mapping),
            "bridge_nodes": between.join(self.nodes.select("id", "repo"), "id", "left"),
            "cross_repo_coupling": graph.repo_coupling(self.edges, self.nodes),
        }

    def query_context(self, query: str, top_k: int = 5, snippet_chars: int = 300) -> dict[str, DataFrame]:
        """files, flow_files, graph and flow_nodes for a query in words; the query is enriched by the lexicon."""
        text = query
        if self.lexicon is not None:
            one = self.nodes.sparkSession.createDataFrame([(query,)], "q string")
            more = search.with_synonyms(one, "q", search.query_words(F.col("q")), self.lexicon, " ").first()
            text = f"{query} {more.synonyms}" if more else query
        found = context.hybrid(self.vectors, self._encoded(text), query, self.nodes, self.edges, self.mapping, top_k)
        return {
            "files": context.described(found["base"], self.nodes, self.mapping, self._latest(), snippet_chars),
            "flow_files": search.first_files(found["flow"].select("id", F.col("depth").alias("pos")), self.mapping),
            "graph": found["graph"],
            "flow_nodes": found["flow"].orderBy("depth", "id").limit(20),
        }

    def _encoded(self, text: str) -> list[float]:
        return [float(x) for x in self.encoder([text])[0]]

    def select_context(self, query: str, top_k: int = 5, without: Sequence[str] = ()) -> dict[str, DataFrame]:
        """files, flow and graph for a query whose trigger words are expanded; the flow also follows bindings and has the screens that depend on it."""
        found = context.hybrid(self.vectors, self._encoded(context.expanded(query)), query, self.nodes, self.edges, self.mapping, top_k, wide=True, without=without)
        return {
            "files": search.first_files(found["base"].select("id", (-F.col("score")).alias("pos")), self.mapping).orderBy("pos", "path").select("path"),
            "flow": search.first_files(found["flow"].select("id", F.col("depth").alias("pos")), self.mapping).orderBy("pos", "path").select("path"),
            "graph": found["graph"],
        }


#: Fixed value: the names under which tools are called.
TOOLS = (
    "list_nodes", "search_by_api_path", "search_by_error_type", "search_by_filename", "grep_in_files", "get_file_content",
    "find_similar_modules", "get_blast_radius", "detect_communities", "get_architecture_overview", "query_context",
    "build_db", "init_steering", "check_steering",
)
#: The selector's query, beside the tools.
MORE = ("select_context",)


def call(space: Workspace, tool: str, **arguments) -> DataFrame | dict[str, DataFrame]:
    if tool not in TOOLS + MORE:
        raise KeyError(f"no tool {tool!r}; there are {', '.join(TOOLS + MORE)}")
    return getattr(space, tool)(**arguments)


def rendered(answer: DataFrame | dict[str, DataFrame], empty: str = "nothing found") -> str:
    """An answer as JSON text; non-ASCII text is kept. Answers are small by their tools' limits."""
    if isinstance(answer, dict):
        return json.dumps({k: json.loads(rendered(v, "")) for k, v in answer.items()}, ensure_ascii=False, indent=2)
    rows = [json.loads(r) for r in answer.toJSON().collect()]
    return json.dumps(rows if rows or not empty else {"message": empty}, ensure_ascii=False, indent=2)


def serve(space: Workspace, lines: Iterable[str]) -> Iterator[str]:
    """One answer per line; a line is JSON with tool and arguments, or a query in plain words. Blank lines are skipped, errors are answers."""
    for line in lines:
        line = line.strip()
        if not line:
            continue
        try:
            request = json.loads(line) if line.startswith("{") else {"tool": "query_context", "query": line}
            with scratch(space.files.sparkSession):  # nothing of an answer is read after it is rendered
                answer = rendered(call(space, request.pop("tool"), **request))
            yield json.dumps(json.loads(answer), ensure_ascii=False)
        except Exception as error:  # noqa: BLE001
            yield json.dumps({"error": str(error).split("\n")[0]}, ensure_ascii=False)
