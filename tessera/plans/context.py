"""Hybrid queries: vector search, then the graph around what was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import entry_nodes, graph_text, priority, trace_flow, trace_flow_with_entries
from tessera.operators.search import first_files, preview
from tessera.operators.vector import top_k
from tessera.sources.tables import stage

# Fixed value: words of a query that point to entry classes, with the parts of names they mean.
TRIGGERS = (("home", ("home",)), ("flash", ("flash", "fsell")))
# Fixed value: what is added to a query that holds the word.
EXPANSIONS = {"flash": " flash sale fsell product discount"}

# What stands before a loaded file, and in place of one that can't be read.
FILE_LINE, UNREADABLE = "\nFILE: ", "(Cannot read file)"


def expanded(query: str) -> str:
    """The query with the words that its trigger words stand for."""
    return query + "".join(more for word, more in EXPANSIONS.items() if word in query.lower())


def expansion(query: Column) -> Column:
    """``expanded`` of a column of queries."""
    more = [F.when(F.lower(query).contains(word), words).otherwise("") for word, words in EXPANSIONS.items()]
    return F.concat(query, *more)


def hybrid(vectors: DataFrame, query_vector: list[float], query: str, nodes: DataFrame, edges: DataFrame, mapping: DataFrame, k: int = 5, wide: bool = False, without: Sequence[str] = (), key: str = "id", vector: str = "vec", triggers=TRIGGERS) -> dict[str, DataFrame]:
    """What a prompt needs about a query.

    * base (id, score): the k nearest mapped names;
    * flow (id, depth): what is reached from the query's entry names, or from
      base where it has none; with ``wide`` also over bindings and with the
      screens that depend on it;
    * graph (line): the edges that touch the flow.
    """
    base = stage(top_k(vectors, query_vector, k, key, vector, mapping, list(without)).toDF("id", "score"), "base")
    entries = entry_nodes(mapping, query, triggers)
    starts = entries if not entries.isEmpty() else base.select("id")
    flow = trace_flow_with_entries(edges, nodes, mapping, starts) if wide else trace_flow(edges, starts)
    return {"base": base, "flow": flow, "graph": graph_text(edges, flow)}


def described(base: DataFrame, nodes: DataFrame, mapping: DataFrame, contents: DataFrame | None = None, chars: int = 300) -> DataFrame:
    """(id, path, line, summary, snippet) of found names, joined by name; a snippet only where no summary is."""
    rows = base.join(mapping.select("id", "path", "line"), "id", "left").join(nodes.select("id", "summary"), "id", "left")
    if contents is None:
        rows = rows.withColumn("content", F.lit(None).cast("string"))
    else:
        rows = rows.join(contents.select("path", "content"), "path", "left")
    return rows.select("id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("summary", F.lit("")).alias("summary"), preview(F.col("summary"), F.col("content"), chars).alias("snippet"))


def flow_files(flow: DataFrame, mapping: DataFrame, blacklist: Sequence[str] = (), k: int = 6) -> DataFrame:
    """(path, rank): the files of a flow to load first: screens, then controllers, then others."""
    files = first_files(flow.select("id", F.col("depth").alias("pos")), mapping)
    for part in blacklist:
        files = files.filter(~F.col("path").contains(part))
    return priority(files, k)


def loaded(files: DataFrame, contents: DataFrame, blacklist: Sequence[str] = (), k: int = 6, chars: int = 2500) -> DataFrame:
    """(path, rank, text): the first characters of the first k files that aren't blacklisted; a note where a file can't be read."""
    rows = files
    for part in blacklist:
        rows = rows.filter(~F.col("path").contains(part))
    rows = rows.orderBy("rank").limit(k).join(contents.select("path", "content"), "path", "left")
    body = F.coalesce(F.substring("content", 1, chars), F.lit(UNREADABLE))
    return rows.select("path", "rank", F.concat(F.lit(FILE_LINE), "path", F.lit("\n"), body).alias("text"))


#: What kind of answer is wanted, by the intent of the query.
TASKS = {
    "FLOW": "Describe the steps of the real flow, from the screen to the data, using nothing but the sources above. Name what is missing.",
    "DEBUG": "Find the cause of the fault, then give the fix and the changed lines.",
    "GENERAL": "Explain this clearly.",
}


def prompt(query: Column, intent: Column, flow: Column, graph: Column, related: Column) -> Column:
    """The text for a language model: question, sources, and what kind of answer is wanted."""
    task = F.when(intent == "FLOW", TASKS["FLOW"]).when(intent == "DEBUG", TASKS["DEBUG"]).otherwise(TASKS["GENERAL"])
    return F.concat_ws("\n", F.lit("QUESTION"), query, F.lit("FLOW SOURCES"), flow, F.lit("GRAPH"), graph, F.lit("RELATED SOURCES"), related, F.lit("TASK"), task)
