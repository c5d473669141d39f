"""Search in stored graphs and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: folders whose contents are never searched.
EXCLUDED = ("/build/", "/.dart_tool/", "/node_modules/", "/venv/", "/.pub-cache/")


def _texts(df: DataFrame, content: str) -> Column:
    """Lines of a text; carriage returns before line ends are dropped, a last line end begins no line."""
    text = F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), r"\n\z", "")
    return F.when(F.coalesce(F.col(content), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def list_nodes(nodes: DataFrame, node_type: str = "", limit: int = 50) -> DataFrame:
    """Nodes of a type in any letter case, or of all types, by name."""
    rows = nodes.filter(F.lower("node_type") == node_type.lower()) if node_type else nodes
    return rows.orderBy("id").limit(limit)


def by_api_path(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes with a path that contains the given one or is part of it."""
    return nodes.filter(F.exists("api_paths", lambda p: p.contains(path) | F.lit(path).contains(p)))


def by_error_type(nodes: DataFrame, error: str) -> DataFrame:
    """Nodes with an error type that contains the given text in any letter case."""
    return nodes.filter(F.exists("error_types", lambda e: F.lower(e).contains(error.lower())))


def searched(files: DataFrame, repo: str = "") -> DataFrame:
    """Files outside excluded folders, of one repo if it is named."""
    rows = files.filter(F.col("path").isNotNull())
    for part in EXCLUDED:
        rows = rows.filter(~F.col("path").contains(part))
    return rows.filter(F.col("repo") == repo) if repo else rows


def glob_regex(pattern: str) -> str:
    """A file name pattern with *, ? and [] as a regular expression for a whole name."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"


def by_filename(files: DataFrame, mapping: DataFrame, pattern: str, repo: str = "", limit: int = 30) -> DataFrame:
    """(path, in_graph): Dart files whose name contains the pattern in any letter case, by path.

    Stars are dropped; ``?`` and ``[]`` stay active.  ``in_graph`` says that a
    mapped path equals the path or ends with the file's name.
    """
    name = F.element_at(F.split("path", "/"), -1)
    inner = pattern.lower().replace("*", "")
    rows = searched(files, repo).select("path").distinct().withColumn("file", name).filter(F.col("file").endswith(".dart"))
    hits = rows.filter(F.lower("file").rlike(glob_regex(f"*{inner}*"))).orderBy("path").limit(limit)
    # a mapped path ends with a name iff its own last part ends with it
    tails = mapping.filter("path IS NOT NULL").select(F.element_at(F.split("path", "/"), -1).alias("tail")).distinct()
    found = hits.join(tails, F.col("tail").endswith(F.col("file"))).select("path").distinct().withColumn("hit", F.lit(True))
    return hits.join(found, "path", "left").select("path", F.coalesce("hit", F.lit(False)).alias("in_graph"))


def grep(files: DataFrame, keyword: str, key: str = "path", content: str = "content", context: int = 3, per_file: int = 3, max_files: int | None = None, order: str | None = None) -> DataFrame:
    """(key, line, snippet): the first matches of each file with the lines around them.

    A match is a line that contains the keyword in any letter case.  Each
    snippet line has its number in four places, a marker at the match and the
    text.  The search stays within the row: the lines around a match are a
    slice of the file's own array, so nothing is shuffled.
    """
    lines = F.col("_lines")
    rows = files.filter(F.lower(content).contains(keyword.lower())).select(F.col(key), F.col(order or key).alias("_o"), _texts(files, content).alias("_lines"))
    hits = F.filter(F.transform(lines, lambda x, i: F.when(F.lower(x).contains(keyword.lower()), i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("_hits", F.slice(hits, 1, per_file)).filter(F.size("_hits") > 0)
    if max_files is not None:
        rows = rows.orderBy("_o").limit(max_files)
    each = rows.select(key, "_lines", F.explode("_hits").alias("line"))
    first = F.greatest(F.col("line") - context, F.lit(1))
    window = F.slice(lines, first, F.col("line") + context - first + 1)
    numbered = F.transform(window, lambda x, i: F.concat(F.lpad((first + i).cast("string"), 4, " "), F.lit(": "), F.when(first + i == F.col("line"), ">>>").otherwise("   "), F.lit(" "), x))
    return each.select(key, "line", F.array_join(numbered, "\n").alias("snippet"))


def line_window(files: DataFrame, start: Column, count: Column, key: str = "path", content: str = "content") -> DataFrame:
    """(key, first, last, total, text): numbered lines from ``start`` on, with where they stand in the whole."""
    rows = files.select(key, _texts(files, content).alias("_l"), F.greatest(start, F.lit(1)).cast("int").alias("first"), count.cast("int").alias("_n")).withColumn("total", F.size("_l"))
    part = F.when(F.col("first") > F.col("total"), F.array().cast("array<string>")).otherwise(F.slice("_l", "first", F.greatest(F.col("_n"), F.lit(0))))
    rows = rows.withColumn("_p", part).withColumn("last", F.col("first") + F.size("_p") - 1)
    text = F.array_join(F.transform("_p", lambda x, i: F.concat(F.lpad((F.col("first") + i).cast("string"), 4, " "), F.lit(": "), x)), "\n")
    return rows.select(key, "first", "last", "total", text.alias("text"))


def class_start(content: Column, name: Column, mapped_line: Column) -> Column:
    """Where to begin reading a class: two lines above its mapped line, else three above the line that declares it, else 1."""
    lines = F.split(content, "\n", -1)
    word = F.concat(F.lit(r"\bclass\s+"), F.regexp_replace(name, r"([^\w])", r"\\$1"), F.lit(r"\b"))
    at = F.array_min(F.transform(lines, lambda x, i: F.when(F.regexp_like(x, word), i)))
    return F.greatest(F.when(mapped_line > 1, mapped_line - 2).otherwise(F.coalesce(at - 2, F.lit(1))), F.lit(1))


def class_window(files: DataFrame, name: str = "name", content: str = "content", lines: int = 120) -> DataFrame:
    """The files with ``snippet``: lines from three above the class's declaration, or the first ones."""
    word = F.concat(F.lit(r"\bclass\s+"), F.regexp_replace(name, r"([^\w])", r"\\$1"), F.lit(r"\b"))
    all_ = _texts(files, content)
    at = F.array_min(F.transform(all_, lambda x, i: F.when(F.regexp_like(x, word), i)))
    begin = F.greatest(F.coalesce(at - 2, F.lit(1)), F.lit(1))
    return files.withColumn("snippet", F.array_join(F.slice(all_, begin, lines), "\n"))


def preview(summary: Column, content: Column, chars: int) -> Column:
    """The first characters of a text, only where there is no summary and any are wanted."""
    return F.when((F.coalesce(summary, F.lit("")) == "") & F.lit(chars > 0), F.substring(content, 1, max(chars, 0)))


def camel_words(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit("[A-Z][a-z0-9]*|[0-9]+"), F.lit(0))


def query_words(text: Column) -> Column:
    """ASCII words of a text, the first letter in upper case and the rest in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z][a-z0-9]*"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))


def with_synonyms(rows: DataFrame, key: str, words: Column, lexicon: DataFrame, separator: str) -> DataFrame:
    """(key, synonyms): the lexicon's entries of the words in their order, joined; repeated words repeat.

    Rows without any entry have none in the result.
    """
    each = rows.select(key, F.posexplode(words).alias("pos", "token"))
    hit = each.join(lexicon.select("token", "synonyms"), "token")
    return hit.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "synonyms"))), lambda s: s["synonyms"]), separator).alias("synonyms"))


def intent(query: Column) -> Column:
    """FLOW, else DEBUG, else GENERAL, by words of the query."""
    q = F.lower(query)
    # fixed values: the words
    return F.when(q.contains("luồng") | q.contains("flow"), "FLOW").when(q.contains("fix") | q.contains("bug") | q.contains("crash"), "DEBUG").otherwise("GENERAL")


def first_files(paths: DataFrame, mapping: DataFrame) -> DataFrame:
    """(path, pos): distinct paths of names in the order of their first occurrence; unmapped names are skipped.

    ``paths`` has id and pos.
    """
    mapped = paths.join(mapping.filter(F.coalesce("path", F.lit("")) != "").select("id", "path"), "id")
    return mapped.groupBy("path").agg(F.min("pos").alias("pos"))


def nth_per(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", nth).filter(F.col("_n") <= k).drop("_n")
