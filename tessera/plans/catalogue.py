"""Queries of the code-graph operators on whole tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import dart
from tessera.functions.text import name_or_null
from tessera.operators import extract, graph, incremental, search, vector
from tessera.operators.communities import communities, community_profiles
from tessera.operators.vector import hashing_encoder
from tessera.plans import context
from tessera.sources.tables import kept, table

QUERIES: dict = {}
ORACLES: dict = {}

_TRIM = "chr(32) || chr(9) || chr(10)"

#: The canonical relations in SQL: first node by row, last mapping by row, first edge by id.
_VIEWS = f"""
nodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY node_row) AS rn FROM kg_nodes) WHERE rn = 1),
edges AS (SELECT * FROM (
  SELECT edge_id, src, dst, edge_type, row_number() OVER (PARTITION BY src, dst, edge_type ORDER BY edge_id) AS rn FROM (
    SELECT edge_id, nullif(trim(src, {_TRIM}), '') AS src, nullif(trim(dst, {_TRIM}), '') AS dst, lower(nullif(trim(edge_type, {_TRIM}), '')) AS edge_type FROM kg_edges)
  WHERE src IS NOT NULL AND dst IS NOT NULL AND edge_type IS NOT NULL) WHERE rn = 1),
mapping AS (SELECT id, path, coalesce(line, 1) AS line, map_id FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY map_id DESC) AS rn FROM (
    SELECT map_id, nullif(trim(id, {_TRIM}), '') AS id, nullif(trim(path, {_TRIM}), '') AS path, line FROM file_mapping)
  WHERE id IS NOT NULL) WHERE rn = 1)
"""


def query(sql: str | None = None, views: bool = True, name: str | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            lead = "WITH RECURSIVE" + _VIEWS + ("," if sql.lstrip().startswith("+") else "") if views else ""
            ORACLES[key] = lead + (sql.lstrip()[1:] if sql.lstrip().startswith("+") else sql)
        return f

    return add


def _path(d: str, name: str) -> str:
    return f"{d.rstrip('/')}/{name}.parquet"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """The canonical nodes; like edges and mapping made once a session, as a stored graph is."""
    return kept(spark, _path(d, "kg_nodes"), "nodes", lambda: extract.first_nodes(table(spark, d, "kg_nodes"), "node_row"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "kg_edges").select("edge_id", name_or_null("src").alias("src"), name_or_null("dst").alias("dst"), F.lower(name_or_null("edge_type")).alias("edge_type"))
    return kept(spark, _path(d, "kg_edges"), "edges", lambda: extract.distinct_edges(e.dropna(), "edge_id"))


def mapping(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "file_mapping").select("map_id", name_or_null("id").alias("id"), name_or_null("path").alias("path"), "line")
    return kept(spark, _path(d, "file_mapping"), "mapping", lambda: extract.last_mapping(m.filter("id IS NOT NULL"), "map_id"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "src_files")


# ---------------------------------------------------------------- relations


@query("SELECT id, node_row, node_type, repo, base_class FROM nodes")
def q_nodes_first_wins(spark, d):
    return nodes(spark, d).select("id", "node_row", "node_type", "repo", "base_class")


@query("SELECT id, path, line, map_id FROM mapping")
def q_filemap_last_wins(spark, d):
    return mapping(spark, d).select("id", "path", "line", "map_id")


@query("SELECT src, dst, edge_type, edge_id FROM edges")
def q_edges_dedup(spark, d):
    return edges(spark, d)


# --------------------------------------------------------------- extraction

_WS = r"[\pL\pN_]"


def _sql(pattern: str) -> str:
    """A pattern of the library as a DuckDB literal."""
    return "'" + pattern.replace(dart.W, _WS).replace("'", "''") + "'"


_FIRSTS = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _each(lists: str) -> str:
    return f"SELECT file_id, CAST(i - 1 AS INT) AS pos, l[i] AS value FROM (SELECT file_id, l, unnest(range(1, len(l) + 1)) AS i FROM ({lists}))"


def _extraction(name: str, column, lists: str) -> None:
    def run(spark, d):
        return files(spark, d).filter("content IS NOT NULL").select("file_id", F.posexplode(column(F.col("content"))).alias("pos", "value"))

    query(_each(lists), views=False, name=name)(run)


def _all(pattern: str, group: int = 1) -> str:
    return f"SELECT file_id, regexp_extract_all(content, {_sql(pattern)}, {group}) AS a FROM src_files WHERE content IS NOT NULL"


_extraction("q_extract_methods", dart.methods, f"SELECT file_id, ({_FIRSTS.format('a')})[1:10] AS l FROM ({_all(dart.METHOD)})")
_extraction("q_extract_events", dart.events, f"SELECT file_id, ({_FIRSTS.format('a')})[1:10] AS l FROM ({_all(dart.EVENT)})")
_extraction("q_extract_api", dart.api_paths, f"SELECT file_id, list_filter({_FIRSTS.format('a')}, lambda x: length(x) > 3)[1:5] AS l FROM ({_all(dart.API_PATH)})")
_extraction("q_extract_routes", dart.route_paths, f"SELECT file_id, a[1:3] AS l FROM ({_all(dart.ROUTE_PATH)})")
_extraction(
    "q_extract_errors",
    dart.error_types,
    f"SELECT file_id, ({_FIRSTS.format('b')})[1:5] AS l FROM (SELECT file_id, list_filter(list_transform(range(1, len(a) + 1), lambda i: coalesce(a[i], '') || coalesce(a2[i], '') || coalesce(a3[i], '')), lambda x: x <> '') AS b FROM ("
    f"SELECT file_id, regexp_extract_all(content, {_sql(dart.ERROR)}, 1) AS a, regexp_extract_all(content, {_sql(dart.ERROR)}, 2) AS a2, regexp_extract_all(content, {_sql(dart.ERROR)}, 3) AS a3 FROM src_files WHERE content IS NOT NULL))",
)

_CLASSES = f"""classes AS (
  SELECT file_id, path, content, n1, b1, list_filter(list_filter(n2, lambda x, i: list_position(n2, x) = i), lambda x: NOT list_contains(n1, x)) AS n2 FROM (
    SELECT file_id, path, content, regexp_extract_all(content, {_sql(dart.INHERITING)}, 1) AS n1, regexp_extract_all(content, {_sql(dart.INHERITING)}, 2) AS b1, regexp_extract_all(content, {_sql(dart.STANDALONE)}, 1) AS n2
    FROM src_files WHERE content IS NOT NULL AND NOT (path LIKE '%\\_event.dart' ESCAPE '\\' OR path LIKE '%\\_state.dart' ESCAPE '\\')))
"""


def _edge_sql(pattern: str, group: int, distinct: bool, own: bool) -> str:
    take = _FIRSTS.format("a") if distinct else "a"
    return f"""WITH {_CLASSES}, mains AS (SELECT file_id, content, coalesce(n1[1], n2[1]) AS src FROM classes),
    found AS (SELECT file_id, src, unnest({take}) AS dst FROM (SELECT file_id, src, regexp_extract_all(content, {_sql(pattern)}, {group}) AS a FROM mains WHERE src IS NOT NULL))
    SELECT file_id, src, dst FROM found {'' if own else 'WHERE src <> dst'}"""


def _code_edges(kind: str):
    def run(spark, d):
        rows = files(spark, d).withColumn("repo", F.col("file_id"))
        return extract.code_edges(rows).filter(F.col("edge_type") == kind).select(F.col("repo").alias("file_id"), "src", "dst")

    return run


query(_edge_sql(dart.LOOKUP, 1, True, False), views=False, name="q_edges_depends")(_code_edges("depends_on"))
query(_edge_sql(dart.BINDING, 1, True, False), views=False, name="q_edges_binds")(_code_edges("binds"))
query(_edge_sql(dart.ROUTED, 2, False, True), views=False, name="q_edges_routes")(_code_edges("routes_to"))


@query(
    f"""WITH {_CLASSES}, each AS (
      SELECT file_id, content, i - 1 AS pos, names[i] AS name, bases[i] AS base FROM (
        SELECT file_id, content, list_concat(n1, n2) AS names, list_concat(b1, list_transform(n2, lambda x: '')) AS bases, unnest(range(1, len(n1) + len(n2) + 1)) AS i FROM classes)),
    lines AS (SELECT file_id, pos, name, base, string_split(content, chr(10)) AS l FROM each)
    SELECT file_id, CAST(pos AS INT) AS pos, name, base,
      CAST(coalesce((SELECT CASE WHEN m >= len(l) THEN 1 ELSE m END FROM (SELECT list_max(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '\\bclass\\s+' || name || '\\b'))) AS m)), 1) AS INT) AS line
    FROM lines""",
    views=False,
)
def q_declarations(spark, d):
    return extract.declared_classes(files(spark, d)).select("file_id", "pos", "name", "base", "line")


@query()
def q_declarations_scan(spark, d):
    return extract.declared_classes(files(spark, d), "scan").select("file_id", "pos", "name", "base", "line")


@query()
def q_code_graph_nodes(spark, d):
    found = extract.knowledge_graph(files(spark, d), "scan")["nodes"]
    return found.select("id", "node_type", "repo", "base_class", "summary", "start_line")


@query()
def q_script_graph(spark, d):
    return extract.script_graph(files(spark, d))["nodes"]


@query(
    f"""SELECT file_id, id, node_type, n_classes, replace(replace(id, 'Event', 'Bloc'), 'State', 'Bloc') AS bloc FROM (
      SELECT file_id, CASE WHEN path LIKE '%\\_event.dart' ESCAPE '\\' THEN 'Event' ELSE 'State' END AS node_type,
        list_reduce(list_transform(string_split(replace(string_split(path, '/')[-1], '.dart', ''), '_'), lambda w: upper(w[1]) || lower(w[2:])), lambda x, y: x || y) AS id,
        CAST(len(list_concat(regexp_extract_all(content, {_sql(dart.EVENT_CLASS)}, 1), regexp_extract_all(content, {_sql(dart.STATE_CLASS)}, 1))[1:20]) AS INT) AS n_classes
      FROM src_files WHERE path LIKE '%\\_event.dart' ESCAPE '\\' OR path LIKE '%\\_state.dart' ESCAPE '\\') WHERE n_classes > 0""",
    views=False,
)
def q_part_files(spark, d):
    rows = extract.part_nodes(files(spark, d).withColumn("repo", F.col("file_id")))
    return rows.select(F.col("repo").alias("file_id"), "id", "node_type", F.size("classes").alias("n_classes"), dart.bloc_of(F.col("id")).alias("bloc"))


def _rule_sql() -> str:
    out = "CASE WHEN contains(coalesce(base_class, ''), 'Module') OR contains(id, 'Module') THEN 'Module'"
    for kind, parts, at_end in dart.NODE_RULES:
        out += " WHEN " + " OR ".join(f"{'ends_with' if at_end else 'contains'}(id, '{p}')" for p in parts) + f" THEN '{kind}'"
    return out + " ELSE 'Unknown' END"


@query(f"SELECT id, base_class, {_rule_sql()} AS node_type FROM nodes")
def q_classify(spark, d):
    return nodes(spark, d).select("id", "base_class", dart.node_type(F.col("id"), F.col("base_class")).alias("node_type"))


@query(
    """SELECT id, concat_ws(' | ', node_type, CASE WHEN coalesce(base_class, '') NOT IN ('', 'Mixin') THEN 'extends ' || base_class END,
      CASE WHEN len(e) > 0 THEN 'on<' || array_to_string(e[1:3], ',') || '>' WHEN len(m) > 0 THEN 'fn:' || array_to_string(m[1:4], ',') END,
      'api:' || p[1]) AS summary
    FROM (SELECT *, list_filter(coalesce(events, []), lambda x: x IS NOT NULL) AS e, list_filter(coalesce(methods, []), lambda x: x IS NOT NULL) AS m, list_filter(coalesce(api_paths, []), lambda x: x IS NOT NULL) AS p FROM nodes)"""
)
def q_summary(spark, d):
    return nodes(spark, d).select("id", dart.summary(*map(F.col, ("node_type", "base_class", "methods", "events", "api_paths"))).alias("summary"))


@query("""SELECT id, CASE WHEN ends_with(id, 'Module') THEN 'Module' WHEN ends_with(id, 'Controller') THEN 'Controller' WHEN ends_with(id, 'Service') THEN 'Service'
  WHEN ends_with(id, 'Repository') THEN 'Repository' WHEN contains(coalesce(base_class, ''), 'Module') THEN 'Module' END AS script_type FROM nodes""")
def q_script_types(spark, d):
    return nodes(spark, d).select("id", dart.script_type(F.col("id"), F.col("base_class")).alias("script_type"))


# ------------------------------------------------------------------- search


@query("SELECT id, node_type, repo FROM nodes WHERE lower(node_type) = 'usecase' ORDER BY id LIMIT 50")
def q_list_nodes(spark, d):
    return search.list_nodes(nodes(spark, d), "usecase").select("id", "node_type", "repo")


@query("SELECT id, node_type, repo FROM nodes WHERE len(list_filter(api_paths, lambda p: contains(p, '/v1') OR contains('/v1', p))) > 0")
def q_api_path(spark, d):
    return search.by_api_path(nodes(spark, d), "/v1").select("id", "node_type", "repo")


@query("SELECT id, node_type, repo FROM nodes WHERE len(list_filter(error_types, lambda e: contains(lower(e), 'exception'))) > 0")
def q_error_type(spark, d):
    return search.by_error_type(nodes(spark, d), "Exception").select("id", "node_type", "repo")


_SEARCHED = " AND ".join(f"NOT contains(path, '{x}')" for x in search.EXCLUDED)


@query(
    f"""+hits AS (SELECT DISTINCT path, string_split(path, '/')[-1] AS file FROM src_files WHERE {_SEARCHED} AND ends_with(path, '.dart') AND contains(lower(string_split(path, '/')[-1]), '_bloc') ORDER BY path LIMIT 30)
    SELECT path, EXISTS (SELECT 1 FROM mapping m WHERE ends_with(m.path, h.file)) AS in_graph FROM hits h"""
)
def q_filename(spark, d):
    return search.by_filename(files(spark, d), mapping(spark, d), "*_bloc*")


@query(
    """WITH lines AS (
      SELECT file_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT file_id, string_split(regexp_replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n\\z', ''), chr(10)) AS l FROM src_files WHERE content <> '')),
    hits AS (SELECT file_id, l, i, row_number() OVER (PARTITION BY file_id ORDER BY i) AS nth FROM lines WHERE contains(lower(l[i]), 'await'))
    SELECT file_id, CAST(i AS INT) AS line, array_to_string(list_transform(range(greatest(i - 3, 1), least(i + 3, len(l)) + 1), lambda j: printf('%4d: %s %s', j, CASE WHEN j = i THEN '>>>' ELSE '   ' END, l[j])), chr(10)) AS snippet
    FROM hits WHERE nth <= 3""",
    views=False,
)
def q_grep_context(spark, d):
    return search.grep(files(spark, d), "AWAIT", key="file_id")


@query(
    """WITH l AS (SELECT file_id, CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n\\z', ''), chr(10)) END AS l FROM src_files WHERE content IS NOT NULL)
    SELECT file_id, 5 AS first, CAST(greatest(least(len(l), 14), 4) AS INT) AS last, CAST(len(l) AS INT) AS total,
      coalesce(array_to_string(list_transform(range(5, least(len(l), 14) + 1), lambda j: printf('%4d: %s', j, l[j])), chr(10)), '') AS text FROM l""",
    views=False,
)
def q_file_window(spark, d):
    return search.line_window(files(spark, d).filter("content IS NOT NULL"), F.lit(5), F.lit(10), key="file_id")


@query(
    f"""WITH {_CLASSES}, c AS (SELECT file_id, coalesce(n1[1], n2[1]) AS name, string_split(regexp_replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n\\z', ''), chr(10)) AS l FROM classes),
    s AS (SELECT file_id, name, l, coalesce(greatest(list_min(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '\\bclass\\s+' || name || '\\b'))) - 3, 1), 1) AS b FROM c WHERE name IS NOT NULL)
    SELECT file_id, name, array_to_string(l[b:b + 119], chr(10)) AS snippet FROM s""",
    views=False,
)
def q_class_snippet(spark, d):
    main = extract.main_classes(files(spark, d)).withColumnRenamed("main", "name")
    return search.class_window(main).select("file_id", "name", "snippet")


#: A small lexicon of our own: parts of names and words that users say for them.
LEXICON = (("Garden", "yard, plot"), ("Paper", "sheet, page"), ("Engine", "motor"), ("Echo", "reflection, repeat"), ("Module", "unit, package"), ("Harbor", "port"), ("Session", "visit"), ("Cat", "kitten"), ("Letter", "mail, note"))
_LEXICON = "lexicon(token, synonyms) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LEXICON) + ")"


def _lexicon(spark):
    return spark.createDataFrame(list(LEXICON), "token string, synonyms string")


@query(
    f"""+{_LEXICON}, words AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT id, regexp_extract_all(id, '[A-Z][a-z0-9]*|[0-9]+') AS w FROM nodes))
    SELECT id, string_agg(synonyms, ', ' ORDER BY i) AS synonyms FROM words JOIN lexicon ON token = w[i] GROUP BY id"""
)
def q_enrich_identifier(spark, d):
    return search.with_synonyms(nodes(spark, d), "id", search.camel_words(F.col("id")), _lexicon(spark), ", ")


@query(
    f"""WITH {_LEXICON}, words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][a-z0-9]*') AS w FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, string_agg(synonyms, ' ' ORDER BY i) AS synonyms FROM words JOIN lexicon ON token = upper(w[i][1]) || lower(w[i][2:]) GROUP BY doc_id""",
    views=False,
)
def q_enrich_query(spark, d):
    return search.with_synonyms(table(spark, d, "documents"), "doc_id", search.query_words(F.col("text")), _lexicon(spark), " ")


@query(
    """SELECT doc_id, CASE WHEN contains(lower(text), 'luồng') OR contains(lower(text), 'flow') THEN 'FLOW'
      WHEN contains(lower(text), 'fix') OR contains(lower(text), 'bug') OR contains(lower(text), 'crash') THEN 'DEBUG' ELSE 'GENERAL' END AS intent FROM documents""",
    views=False,
)
def q_intent(spark, d):
    return table(spark, d, "documents").select("doc_id", search.intent(F.col("text")).alias("intent"))


# -------------------------------------------------------------------- graph


def _first_module(spark, d) -> DataFrame:
    return edges(spark, d).filter("edge_type = 'routes_to'").agg(F.min("src").alias("id"))


def _busiest(spark, d) -> str:
    best = edges(spark, d).groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dst").first()
    return best.dst if best else ""


_START = "start AS (SELECT min(src) AS id FROM edges WHERE edge_type = 'routes_to')"
_BUSIEST = "busiest AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def _flow(types: str, depth: int = 5) -> str:
    return f"""reached AS (SELECT id, 0 AS depth FROM start UNION SELECT e.dst, r.depth + 1 FROM reached r JOIN edges e ON e.src = r.id AND e.edge_type IN ({types}) WHERE r.depth < {depth}),
    flow AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM reached GROUP BY id)"""


@query(f"+{_START}, {_flow("'routes_to', 'depends_on'")} SELECT id, depth FROM flow WHERE id IS NOT NULL")
def q_trace_flow(spark, d):
    return graph.trace_flow(edges(spark, d), _first_module(spark, d).dropna())


@query(
    f"""+{_START}, {_flow("'routes_to', 'depends_on', 'binds'")} SELECT id, depth FROM flow WHERE id IS NOT NULL
    UNION ALL SELECT DISTINCT e.src, -1 FROM edges e JOIN nodes n ON n.id = e.src AND n.node_type IN ('UI', 'Controller') JOIN mapping m ON m.id = e.src
    WHERE e.edge_type = 'depends_on' AND e.dst IN (SELECT id FROM flow) AND e.src NOT IN (SELECT id FROM flow WHERE id IS NOT NULL)"""
)
def q_trace_flow_entries(spark, d):
    return graph.trace_flow_with_entries(edges(spark, d), nodes(spark, d), mapping(spark, d), _first_module(spark, d).dropna())


_BLAST = f"""+{_BUSIEST}, back AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type IN ('depends_on', 'binds', 'has_part')),
    reached AS (SELECT b.src AS id, 1 AS depth FROM back b JOIN busiest s ON b.dst = s.id UNION SELECT b.src, r.depth + 1 FROM reached r JOIN back b ON b.dst = r.id WHERE r.depth < 4),
    affected AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM reached GROUP BY id)"""


@query(_BLAST + " SELECT id, depth FROM affected")
def q_blast_radius(spark, d):
    return graph.blast_radius(edges(spark, d), _busiest(spark, d)).select("id", "depth")


@query(_BLAST + " SELECT coalesce(n.node_type, 'Unknown') AS node_type, count(*) AS n FROM affected a LEFT JOIN nodes n USING (id) GROUP BY 1")
def q_blast_summary(spark, d):
    return graph.blast_summary(graph.blast_radius(edges(spark, d), _busiest(spark, d)), nodes(spark, d))


@query(f"+{_START} SELECT e.src || ' --[' || e.edge_type || ']--> ' || e.dst AS line FROM edges e WHERE e.src IN (SELECT id FROM start) OR e.dst IN (SELECT id FROM start)")
def q_graph_text(spark, d):
    return graph.graph_text(edges(spark, d), _first_module(spark, d))


@query(
    """+uses AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'binds' AND contains(dst, 'UseCase'))
    SELECT a.src, b.src AS dst, 'similar_to' AS edge_type, list_sort(list(a.dst))[1:3] AS shared_usecases FROM uses a JOIN uses b ON a.dst = b.dst AND a.src < b.src GROUP BY a.src, b.src"""
)
def q_similar_to(spark, d):
    return extract.similar_to(edges(spark, d))


def _binder(spark, d) -> str:
    return edges(spark, d).filter((F.col("edge_type") == "binds") & F.col("dst").contains("UseCase")).agg(F.min("src")).first()[0] or ""


@query(
    """+uses AS (SELECT src, dst, regexp_replace(dst, '^(Get|Create|Delete|Update|Fetch)', '') AS s FROM edges WHERE edge_type = 'binds' AND contains(dst, 'UseCase')),
    own AS (SELECT DISTINCT s, dst FROM uses WHERE src = (SELECT min(src) FROM uses) AND s <> '')
    SELECT u.src AS module, count(*) AS score FROM uses u JOIN own o ON contains(u.s, o.s) OR contains(o.s, u.s) WHERE u.s <> '' AND u.src <> (SELECT min(src) FROM uses)
    GROUP BY u.src ORDER BY score DESC, module LIMIT 5"""
)
def q_similar_modules(spark, d):
    return graph.similar_modules(edges(spark, d), _binder(spark, d))


_WITHIN = "inside AS (SELECT e.* FROM edges e WHERE src IN (SELECT id FROM mapping) AND dst IN (SELECT id FROM mapping))"


@query(
    f"""+{_WITHIN}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM inside UNION ALL SELECT dst FROM inside) GROUP BY id ORDER BY degree DESC, id LIMIT 10)
    SELECT d.id, d.degree, n.repo, n.node_type FROM deg d LEFT JOIN nodes n USING (id)"""
)
def q_degree_hubs(spark, d):
    return graph.hubs(edges(spark, d), nodes(spark, d), mapping(spark, d))


@query("SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")
def q_degrees(spark, d):
    return graph.degrees(edges(spark, d))


@query(
    """+pairs AS (SELECT least(a.repo, b.repo) AS repo_a, greatest(a.repo, b.repo) AS repo_b, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst
      WHERE a.repo <> '' AND b.repo <> '' AND a.repo <> b.repo GROUP BY 1, 2 ORDER BY n DESC, repo_a, repo_b LIMIT 10)
    SELECT * FROM pairs WHERE n >= 3"""
)
def q_repo_coupling(spark, d):
    return graph.repo_coupling(edges(spark, d), nodes(spark, d))


@query(f"+{_WITHIN} SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM inside) AS total_edges, (SELECT count(DISTINCT coalesce(repo, '')) FROM nodes) AS repos")
def q_graph_stats(spark, d):
    return graph.graph_stats(edges(spark, d), nodes(spark, d), mapping(spark, d))


@query(
    """+pairs AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), reach AS (SELECT a AS id, a AS c FROM pairs UNION SELECT r.id, b.b FROM reach r JOIN pairs b ON b.a = r.c)
    SELECT id, min(c) AS component FROM reach GROUP BY id"""
)
def q_components(spark, d):
    e = edges(spark, d)
    ids = e.select(F.col("src").alias("id")).unionAll(e.select("dst"))
    return graph.components(e, ids)


@query()
def q_betweenness(spark, d):
    return graph.betweenness(graph.within(edges(spark, d), mapping(spark, d)), 5)


@query()
def q_communities(spark, d):
    return communities(edges(spark, d), mapping(spark, d))


@query()
def q_community_profiles(spark, d):
    return community_profiles(communities(edges(spark, d), mapping(spark, d)), nodes(spark, d))


# -------------------------------------------------- vectors and hybrid queries


def _first_vector(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").filter("embedding IS NOT NULL").orderBy("vec_id").first().embedding)


_Q = "q AS (SELECT embedding AS v FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1)"


@query(f"WITH {_Q} SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id LIMIT 10", views=False)
def q_vector_topk(spark, d):
    return vector.top_k(table(spark, d, "embeddings"), _first_vector(spark, d), 10, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query(f"WITH {_Q} SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q WHERE vec_id NOT IN (0, 3) ORDER BY list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id LIMIT 5", views=False)
def q_vector_topk_blacklist(spark, d):
    return vector.top_k(table(spark, d, "embeddings"), _first_vector(spark, d), 5, "vec_id", "embedding", without=[0, 3]).withColumn("score", F.round("score", 6))


@query(
    """WITH good AS (SELECT vec_id, embeddings::DOUBLE[] AS v FROM vector_db WHERE len(embeddings) = 384 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    q AS (SELECT v FROM good WHERE len(list_filter(v, lambda x: x <> 0)) > 0 ORDER BY vec_id LIMIT 1)
    SELECT vec_id, round(list_dot_product(good.v, q.v), 6) AS score FROM good, q ORDER BY round(list_dot_product(good.v, q.v), 12) DESC, vec_id LIMIT 10""",
    views=False,
)
def q_vector_db_topk(spark, d):
    v = table(spark, d, "vector_db")
    first = v.filter(_good(F.col("embeddings"))).orderBy("vec_id").select("embeddings").first()
    return vector.top_k(v, list(first[0]) if first else [0.0] * 384, 10, "vec_id", "embeddings").withColumn("score", F.round("score", 6))


def _good(v) -> Column:
    return (F.size(v) == 384) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _usable(spark, d) -> DataFrame:
    rows = table(spark, d, "vector_db").filter(_good(F.col("embeddings")) & F.col("metadata.id").isNotNull())
    lean = rows.select(F.col("metadata.id").alias("id"), "vec_id", F.col("embeddings").alias("vec"))
    return kept(spark, _path(d, "vector_db"), "usable", lambda: extract.first_per(lean, ["id"], "vec_id"))


_CONTEXT = f"""+good AS (SELECT * FROM (SELECT metadata.id AS id, embeddings::DOUBLE[] AS vec, vec_id, row_number() OVER (PARTITION BY metadata.id ORDER BY vec_id) AS rn FROM vector_db
      WHERE len(embeddings) = 384 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0 AND metadata.id IS NOT NULL) WHERE rn = 1),
    base AS (SELECT g.id FROM good g, (SELECT vec FROM good ORDER BY vec_id LIMIT 1) q WHERE g.id IN (SELECT id FROM mapping) ORDER BY round(list_dot_product(g.vec, q.vec), 9) DESC, g.id LIMIT 5),
    start AS (SELECT id FROM base), {_flow("'routes_to', 'depends_on'")}"""


@query(_CONTEXT + " SELECT id, depth FROM flow")
def q_context_flow(spark, d):
    return _hybrid(spark, d)["flow"]


@query(_CONTEXT + " SELECT DISTINCT e.src || ' --[' || e.edge_type || ']--> ' || e.dst AS line FROM edges e WHERE e.src IN (SELECT id FROM flow) OR e.dst IN (SELECT id FROM flow)")
def q_context_graph(spark, d):
    return _hybrid(spark, d)["graph"].distinct()


def _hybrid(spark, d):
    good = _usable(spark, d)
    first = good.orderBy("vec_id").first()
    return context.hybrid(good, list(first.vec) if first else [0.0] * 384, "similar classes", nodes(spark, d), edges(spark, d), mapping(spark, d))


@query(_CONTEXT + " SELECT b.id, coalesce(m.path, '') AS path, coalesce(m.line, 1) AS line, coalesce(n.summary, '') AS summary FROM base b LEFT JOIN mapping m USING (id) LEFT JOIN nodes n USING (id)")
def q_context_files(spark, d):
    return context.described(_hybrid(spark, d)["base"], nodes(spark, d), mapping(spark, d)).drop("snippet")


@query(
    """SELECT path, row_number() OVER (ORDER BY level, pos, path) AS rank FROM (
      SELECT path, min(CASE WHEN contains(path, '_page.dart') OR contains(path, '_screen.dart') OR contains(path, '_view.dart') THEN 0 WHEN contains(path, '_bloc.dart') OR contains(path, '_cubit.dart') THEN 1 ELSE 2 END) AS level, min(file_id) AS pos
      FROM src_files WHERE path IS NOT NULL GROUP BY path) ORDER BY rank LIMIT 6""",
    views=False,
)
def q_priority_files(spark, d):
    return graph.priority(files(spark, d).select("path", F.col("file_id").alias("pos"))).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""+{_LEXICON}, words AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT id, regexp_extract_all(id, '[A-Z][a-z0-9]*|[0-9]+') AS w FROM nodes)),
    syn AS (SELECT id, string_agg(synonyms, ', ' ORDER BY i) AS synonyms FROM words JOIN lexicon ON token = w[i] GROUP BY id),
    last AS (SELECT path, content FROM (SELECT path, content, row_number() OVER (PARTITION BY path ORDER BY file_id DESC) AS rn FROM src_files WHERE content IS NOT NULL) WHERE rn = 1),
    rows_ AS (SELECT n.*, m.path, s.synonyms, CASE WHEN coalesce(l.content, '') = '' THEN [] ELSE string_split(regexp_replace(replace(replace(l.content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n\\z', ''), chr(10)) END AS l
      FROM nodes n LEFT JOIN mapping m USING (id) LEFT JOIN last l ON l.path = m.path LEFT JOIN syn s ON s.id = n.id),
    cut AS (SELECT *, coalesce(greatest(list_min(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '\\bclass\\s+' || id || '\\b'))) - 3, 1), 1) AS b FROM rows_)
    SELECT id, concat_ws(chr(10), 'Class: ' || nullif(id, ''), 'File: ' || nullif(path, ''), 'Also: ' || nullif(synonyms, ''), 'Methods: ' || nullif(array_to_string(list_filter(methods, lambda x: x IS NOT NULL), ', '), ''),
      'Events: ' || nullif(array_to_string(list_filter(events, lambda x: x IS NOT NULL), ', '), ''), 'API paths: ' || nullif(array_to_string(list_filter(api_paths, lambda x: x IS NOT NULL), ', '), ''),
      nullif(array_to_string(l[b:b + 119], chr(10)), '')) AS document FROM cut"""
)
def q_embedding_text(spark, d):
    n, m = nodes(spark, d), mapping(spark, d)
    content = extract.first_per(files(spark, d).filter("content IS NOT NULL").select("path", "content", "file_id"), ["path"], F.col("file_id").desc()).select("path", "content")
    rows = n.join(m.select("id", "path"), "id", "left").join(content, "path", "left")
    words = search.with_synonyms(n, "id", search.camel_words(F.col("id")), _lexicon(spark), ", ")
    return vector.embedding_text(search.class_window(rows, "id").join(words, "id", "left"))


@query()
def q_encoded(spark, d):
    return q_embedding_text(spark, d).select("id", vector.encoded(F.col("document"), hashing_encoder()).alias("vec"))


# -------------------------------------------------------------- maintenance

#: Two moments: what was scanned and not yet deleted then are two snapshots of the files.
THEN, NOW = "2025-05-01 00:00:00", "2025-12-31 00:00:00"


def _as_of(t: str) -> str:
    """The files alive at a moment in SQL, each path once: the latest scan."""
    return f"""SELECT file_id, repo, path, content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, file_id DESC) AS rn FROM src_files
      WHERE scanned_at <= '{t}' AND (deleted_at IS NULL OR deleted_at > '{t}') AND content IS NOT NULL AND path IS NOT NULL) WHERE rn = 1"""


def _alive(spark, d, t: str) -> DataFrame:
    at = F.lit(t).cast("timestamp_ntz")
    rows = files(spark, d).filter((F.col("scanned_at") <= at) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > at)) & F.col("content").isNotNull() & F.col("path").isNotNull())
    return extract.first_per(rows.select("file_id", "repo", "path", "content", "scanned_at"), ["path"], F.col("scanned_at").desc(), F.col("file_id").desc())


_OLD = f"SELECT path, sha256(content) AS sha256 FROM ({_as_of(THEN)})"
_NEW = f"SELECT path, sha256(content) AS sha256 FROM ({_as_of(NOW)})"


def _snapshots(spark, d):
    return incremental.hashes(_alive(spark, d, THEN)), incremental.hashes(_alive(spark, d, NOW))


@query("SELECT file_id, sha256(content) AS sha256, coalesce(sha256(content) = sha256, content IS NULL AND sha256 IS NULL) AS same FROM src_files", views=False)
def q_hash(spark, d):
    h = F.sha2("content", 256)
    return files(spark, d).select("file_id", h.alias("sha256"), F.coalesce(h == F.col("sha256"), F.col("content").isNull() & F.col("sha256").isNull()).alias("same"))


_CHANGES = f"""WITH o AS ({_OLD}), n AS ({_NEW}), diff AS (
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
    FROM o FULL OUTER JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.sha256 <> n.sha256)"""


@query(_CHANGES + " SELECT * FROM diff", views=False)
def q_changes(spark, d):
    return incremental.changes(*_snapshots(spark, d))


@query("+" + _CHANGES.removeprefix("WITH ") + " SELECT DISTINCT m.id, change FROM mapping m JOIN diff USING (path)")
def q_affected(spark, d):
    return incremental.affected_ids(incremental.changes(*_snapshots(spark, d)), mapping(spark, d))


@query(
    _CHANGES + """, fresh AS (SELECT n.path, n.sha256 FROM n JOIN diff d ON d.path = n.path)
    SELECT path, sha256 FROM o WHERE path NOT IN (SELECT path FROM diff) UNION ALL SELECT * FROM fresh""",
    views=False,
)
def q_incremental_merge(spark, d):
    old, new = _snapshots(spark, d)
    diff = incremental.changes(old, new)
    fresh = new.join(diff.select("path"), "path", "left_semi")
    return incremental.merged(old, fresh, diff.filter("change = 'deleted'").select("path"), "path")


# --------------------------------------------------- selector and prompt parts


@query("SELECT DISTINCT id FROM mapping WHERE contains(lower(id), 'home') OR contains(lower(id), 'garden') OR contains(lower(id), 'engine') ORDER BY id LIMIT 3")
def q_entry_nodes(spark, d):
    return graph.entry_nodes(mapping(spark, d), "Where is HOME and the flash port", (("home", ("home",)), ("flash", ("garden", "engine")), ("cart", ("cart",))))


@query(
    _CONTEXT.replace("g.id IN (SELECT id FROM mapping)", "g.id IN (SELECT id FROM mapping) AND g.vec_id <> 0").replace("'routes_to', 'depends_on'", "'routes_to', 'depends_on', 'binds'")
    + """ SELECT id, depth FROM flow
    UNION ALL SELECT DISTINCT e.src, -1 FROM edges e JOIN nodes n ON n.id = e.src AND n.node_type IN ('UI', 'Controller') JOIN mapping m ON m.id = e.src
    WHERE e.edge_type = 'depends_on' AND e.dst IN (SELECT id FROM flow) AND e.src NOT IN (SELECT id FROM flow)"""
)
def q_selector_flow(spark, d):
    good = _usable(spark, d)
    first = good.orderBy("vec_id").first()
    banned = [r.id for r in good.filter("vec_id = 0").select("id").collect()]
    return context.hybrid(good, list(first.vec) if first else [0.0] * 384, "similar classes", nodes(spark, d), edges(spark, d), mapping(spark, d), wide=True, without=banned)["flow"]


@query(
    """WITH ranked AS (SELECT path, row_number() OVER (ORDER BY level, pos, path) AS rank FROM (
      SELECT path, min(CASE WHEN contains(path, '_page.dart') OR contains(path, '_screen.dart') OR contains(path, '_view.dart') THEN 0 WHEN contains(path, '_bloc.dart') OR contains(path, '_cubit.dart') THEN 1 ELSE 2 END) AS level, min(file_id) AS pos
      FROM src_files WHERE path IS NOT NULL AND NOT contains(path, '_state.dart') GROUP BY path)),
    last AS (SELECT path, content FROM (SELECT path, content, row_number() OVER (PARTITION BY path ORDER BY file_id DESC) AS rn FROM src_files WHERE content IS NOT NULL) WHERE rn = 1)
    SELECT r.path, r.rank, chr(10) || 'FILE: ' || r.path || chr(10) || coalesce(l.content[1:2500], '(Cannot read file)') AS text FROM ranked r LEFT JOIN last l USING (path) WHERE r.rank <= 6""",
    views=False,
)
def q_loaded_files(spark, d):
    f = files(spark, d)
    ranked = graph.priority(f.select("path", F.col("file_id").alias("pos")).filter(~F.col("path").contains("_state.dart")))
    content = extract.first_per(f.filter("content IS NOT NULL").select("path", "content", "file_id"), ["path"], F.col("file_id").desc()).select("path", "content")
    return context.loaded(ranked.withColumn("rank", F.col("rank").cast("bigint")), content, ["_state.dart"])


@query("""SELECT n.id, CASE WHEN coalesce(n.summary, '') = '' THEN l.content[1:300] END AS snippet FROM nodes n LEFT JOIN mapping m USING (id)
  LEFT JOIN (SELECT path, content FROM (SELECT path, content, row_number() OVER (PARTITION BY path ORDER BY file_id DESC) AS rn FROM src_files WHERE content IS NOT NULL) WHERE rn = 1) l ON l.path = m.path""")
def q_preview(spark, d):
    content = extract.first_per(files(spark, d).filter("content IS NOT NULL").select("path", "content", "file_id"), ["path"], F.col("file_id").desc()).select("path", "content")
    return context.described(nodes(spark, d).select("id"), nodes(spark, d), mapping(spark, d), content).select("id", "snippet")


# ------------------------------------------------------------ the whole graph


def _graph(latest: str, x: str = "") -> str:
    """CTEs of the graph of some files in SQL: found (class and part-file rows), nodes, edges and file map, all with the suffix ``x``."""
    classes = _CLASSES.replace("classes AS", f"classes{x} AS").replace("FROM src_files", f"FROM latest{x}")
    first = _FIRSTS.format("a")

    def listed(name: str, pattern: str, tail: str) -> str:
        return f"{name}{x} AS (SELECT file_id, {tail} AS l FROM (SELECT file_id, regexp_extract_all(content, {_sql(pattern)}, 1) AS a FROM latest{x}))"

    def ends(kind: str, pattern: str, group: int, own: bool) -> str:
        return f"""SELECT src, dst, edge_type FROM (SELECT src, unnest(regexp_extract_all(content, {_sql(pattern)}, {group})) AS dst, '{kind}' AS edge_type FROM mains{x} WHERE src IS NOT NULL){'' if own else ' WHERE src <> dst'}"""

    return f"""latest{x} AS ({latest}), {classes},
    {listed("m", dart.METHOD, f"({first})[1:10]")}, {listed("e", dart.EVENT, f"({first})[1:10]")}, {listed("p", dart.API_PATH, f"list_filter({first}, lambda x: length(x) > 3)[1:5]")},
    each{x} AS (SELECT file_id, path, content, i - 1 AS pos, names[i] AS name, bases[i] AS base FROM (
      SELECT file_id, path, content, list_concat(n1, n2) AS names, list_concat(b1, list_transform(n2, lambda x: '')) AS bases, unnest(range(1, len(n1) + len(n2) + 1)) AS i FROM classes{x})),
    lined{x} AS (SELECT *, (SELECT CASE WHEN m >= len(l) THEN 1 ELSE m END FROM (SELECT list_max(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '\\bclass\\s+' || name || '\\b'))) AS m)) AS spot
      FROM (SELECT *, string_split(content, chr(10)) AS l FROM each{x})),
    parts{x} AS (SELECT * FROM (SELECT file_id, path, CASE WHEN path LIKE '%\\_event.dart' ESCAPE '\\' THEN 'Event' ELSE 'State' END AS node_type,
        list_reduce(list_transform(string_split(replace(string_split(path, '/')[-1], '.dart', ''), '_'), lambda w: upper(w[1]) || lower(w[2:])), lambda x, y: x || y) AS id,
        len(list_concat(regexp_extract_all(content, {_sql(dart.EVENT_CLASS)}, 1), regexp_extract_all(content, {_sql(dart.STATE_CLASS)}, 1))[1:20]) AS n
      FROM latest{x} WHERE path LIKE '%\\_event.dart' ESCAPE '\\' OR path LIKE '%\\_state.dart' ESCAPE '\\') WHERE n > 0),
    found{x} AS (
      SELECT id, node_type, base_class, concat_ws(' | ', node_type, CASE WHEN base_class NOT IN ('', 'Mixin') THEN 'extends ' || base_class END,
          CASE WHEN len(ev) > 0 THEN 'on<' || array_to_string(ev[1:3], ',') || '>' WHEN len(me) > 0 THEN 'fn:' || array_to_string(me[1:4], ',') END, 'api:' || ap[1]) AS summary,
        CAST(coalesce(spot, 1) AS INT) AS start_line, file_id, path, pos
      FROM (SELECT *, {_rule_sql()} AS node_type FROM (SELECT name AS id, base AS base_class, spot, file_id, path, pos, m.l AS me, e.l AS ev, p.l AS ap
        FROM lined{x} JOIN m{x} m USING (file_id) JOIN e{x} e USING (file_id) JOIN p{x} p USING (file_id)))
      UNION ALL SELECT id, node_type, NULL, NULL, NULL, file_id, path, 0 FROM parts{x}),
    placed{x} AS (SELECT f.*, l.repo FROM found{x} f JOIN latest{x} l USING (file_id)),
    graph_nodes{x} AS (SELECT id, node_type, repo, base_class, summary, start_line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY repo NULLS FIRST, path, pos) AS rn FROM placed{x}) WHERE rn = 1),
    graph_map{x} AS (SELECT id, path, CAST(coalesce(start_line, 1) AS INT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY repo DESC NULLS LAST, path DESC, pos DESC) AS rn FROM placed{x}) WHERE rn = 1),
    mains{x} AS (SELECT content, coalesce(n1[1], n2[1]) AS src FROM classes{x}),
    plain{x} AS (SELECT DISTINCT src, dst, edge_type FROM ({ends("depends_on", dart.LOOKUP, 1, False)} UNION ALL {ends("binds", dart.BINDING, 1, False)} UNION ALL {ends("routes_to", dart.ROUTED, 2, True)}
      UNION ALL SELECT replace(replace(id, 'Event', 'Bloc'), 'State', 'Bloc'), id, 'has_part' FROM parts{x})),
    cases{x} AS (SELECT src, dst FROM plain{x} WHERE edge_type = 'binds' AND contains(dst, 'UseCase')),
    graph_edges{x} AS (SELECT src, dst, edge_type, NULL::VARCHAR[] AS shared_usecases FROM plain{x}
      UNION ALL SELECT a.src, b.src, 'similar_to', list_sort(list(a.dst))[1:3] FROM cases{x} a JOIN cases{x} b ON a.dst = b.dst AND a.src < b.src GROUP BY a.src, b.src)"""


def _whole(spark, d, t: str = NOW) -> dict[str, DataFrame]:
    return extract.knowledge_graph(_alive(spark, d, t))


_WHOLE = "WITH " + _graph(_as_of(NOW))


@query(_WHOLE + " SELECT * FROM graph_nodes", views=False)
def q_graph_nodes(spark, d):
    return _whole(spark, d)["nodes"].select("id", "node_type", "repo", "base_class", "summary", "start_line")


@query(_WHOLE + " SELECT src, dst, edge_type, coalesce(array_to_string(shared_usecases, ','), '') AS shared FROM graph_edges", views=False)
def q_graph_edges(spark, d):
    return _whole(spark, d)["edges"].select("src", "dst", "edge_type", F.coalesce(F.array_join("shared_usecases", ","), F.lit("")).alias("shared"))


@query(_WHOLE + " SELECT * FROM graph_map", views=False)
def q_graph_files(spark, d):
    return _whole(spark, d)["file_map"]


@query()
def q_script_edges(spark, d):
    return extract.script_graph(files(spark, d))["edges"]


@query(
    "WITH " + _graph(_as_of(THEN), "_a") + ", " + _graph(_as_of(NOW), "_b") + """,
    changed AS (SELECT n.path FROM latest_b n LEFT JOIN latest_a o USING (path) WHERE o.path IS NULL OR sha256(o.content) <> sha256(n.content)),
    judged AS (SELECT id, path IN (SELECT path FROM changed) OR id NOT IN (SELECT id FROM graph_map_a) AS again FROM graph_map_b)
    SELECT count(*) AS total, count(*) FILTER (WHERE again) AS encoded, (SELECT count(*) FROM graph_map_a WHERE id NOT IN (SELECT id FROM graph_map_b)) AS deleted, count(*) FILTER (WHERE NOT again) AS unchanged FROM judged""",
    views=False,
)
def q_rebuilt_vectors(spark, d):
    """The vectors of an earlier moment brought up to a later one."""
    encoder = hashing_encoder()
    none = spark.createDataFrame([], schema.VECTORS), spark.createDataFrame([], schema.HASHES)
    was = incremental.rebuilt(_alive(spark, d, THEN), *none, None, encoder)
    return incremental.rebuilt(_alive(spark, d, NOW), was["vectors"], was["hashes"], None, encoder)["stats"]


# --------------------------------------------------- prompt parts and overview


@query("SELECT doc_id, text || CASE WHEN contains(lower(text), 'flash') THEN ' flash sale fsell product discount' ELSE '' END AS expanded FROM documents", views=False)
def q_query_expansion(spark, d):
    return table(spark, d, "documents").select("doc_id", context.expansion(F.col("text")).alias("expanded"))


_TASKS = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in context.TASKS.items() if k != "GENERAL") + f" ELSE '{context.TASKS['GENERAL']}' END"


@query(
    f"""WITH q AS (SELECT doc_id, text, source, target_text, CASE WHEN contains(lower(text), 'luồng') OR contains(lower(text), 'flow') THEN 'FLOW'
      WHEN contains(lower(text), 'fix') OR contains(lower(text), 'bug') OR contains(lower(text), 'crash') THEN 'DEBUG' ELSE 'GENERAL' END AS intent FROM documents)
    SELECT doc_id, concat_ws(chr(10), 'QUESTION', text, 'FLOW SOURCES', source, 'GRAPH', intent, 'RELATED SOURCES', target_text, 'TASK', {_TASKS}) AS prompt FROM q""",
    views=False,
)
def q_prompt(spark, d):
    rows = table(spark, d, "documents").withColumn("intent", search.intent(F.col("text")))
    return rows.select("doc_id", context.prompt(F.col("text"), F.col("intent"), F.col("source"), F.col("intent"), F.col("target_text")).alias("prompt"))


@query("SELECT m.path, min(e.edge_id) AS pos FROM edges e JOIN mapping m ON m.id = e.src WHERE coalesce(m.path, '') <> '' GROUP BY m.path")
def q_node_files(spark, d):
    return search.first_files(edges(spark, d).select(F.col("src").alias("id"), F.col("edge_id").alias("pos")), mapping(spark, d))


@query(
    f"""+{_WITHIN}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM inside UNION ALL SELECT dst FROM inside) GROUP BY id ORDER BY degree DESC, id LIMIT 10),
    pairs AS (SELECT least(a.repo, b.repo) AS repo_a, greatest(a.repo, b.repo) AS repo_b, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst
      WHERE a.repo <> '' AND b.repo <> '' AND a.repo <> b.repo GROUP BY 1, 2 ORDER BY n DESC, repo_a, repo_b LIMIT 10)
    SELECT 'total_nodes' AS part, '' AS name, (SELECT count(*) FROM nodes) AS n UNION ALL SELECT 'total_edges', '', (SELECT count(*) FROM inside) UNION ALL SELECT 'repos', '', (SELECT count(DISTINCT coalesce(repo, '')) FROM nodes)
    UNION ALL SELECT 'hub', id, degree FROM deg UNION ALL SELECT 'coupling', repo_a || ' - ' || repo_b, n FROM pairs WHERE n >= 3"""
)
def q_overview(spark, d):
    """The overview in long form, without the bridges (``q_betweenness``)."""
    n, e, m = nodes(spark, d), edges(spark, d), mapping(spark, d)
    stats = graph.graph_stats(e, n, m).select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.lit("").alias("name"), F.col(c).alias("n")) for c in ("total_nodes", "total_edges", "repos")])).alias("x")).select("x.*")
    hubs = graph.hubs(e, n, m).select(F.lit("hub").alias("part"), F.col("id").alias("name"), F.col("degree").alias("n"))
    coupled = graph.repo_coupling(e, n).select(F.lit("coupling").alias("part"), F.concat("repo_a", F.lit(" - "), "repo_b").alias("name"), "n")
    return stats.unionByName(hubs).unionByName(coupled)


@query(
    """+pairs AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), reach AS (SELECT a AS id, a AS c FROM pairs UNION SELECT r.id, b.b FROM reach r JOIN pairs b ON b.a = r.c),
    member AS (SELECT id, min(c) AS community FROM reach GROUP BY id),
    known AS (SELECT m.community, m.id, coalesce(n.repo, '') AS repo, coalesce(n.node_type, 'Unknown') AS node_type FROM member m LEFT JOIN nodes n USING (id)),
    sizes AS (SELECT community, count(*) AS size FROM known GROUP BY 1 HAVING count(*) >= 3),
    r AS (SELECT community, repo, count(*) AS n FROM known GROUP BY 1, 2), t AS (SELECT community, node_type, count(*) AS n FROM known GROUP BY 1, 2)
    SELECT s.community, s.size, (SELECT repo FROM r WHERE r.community = s.community ORDER BY n DESC, repo LIMIT 1) AS name,
      (SELECT string_agg(repo || '=' || n, ',' ORDER BY repo) FROM r WHERE r.community = s.community) AS repos,
      (SELECT string_agg(node_type || '=' || n, ',' ORDER BY node_type) FROM t WHERE t.community = s.community) AS types,
      (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM known k WHERE k.community = s.community ORDER BY id LIMIT 5)) AS key_nodes FROM sizes s"""
)
def q_component_profiles(spark, d):
    """Profiles of given memberships: those of the connected components."""
    e = edges(spark, d)
    member = graph.components(e, e.select(F.col("src").alias("id")).unionAll(e.select("dst"))).withColumnRenamed("component", "community")
    counts = lambda c: F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    found = community_profiles(member, nodes(spark, d))
    return found.select("community", "size", "name", counts("repo_distribution").alias("repos"), counts("node_types").alias("types"), F.array_join("key_nodes", ",").alias("key_nodes"))
