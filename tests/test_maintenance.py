import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import incremental, vector
from tessera.plans import tools
from tessera.sources import files as sources
from tessera.sources import tables

FILE = "path string, content string"


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], FILE)
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), ("n", None)], FILE)
    diff = incremental.changes(incremental.hashes(old), incremental.hashes(new))
    assert {(r.path, r.change) for r in diff.collect()} == {("b", "changed"), ("c", "deleted"), ("d", "new")}
    m = spark.createDataFrame([("B", "b"), ("B2", "b"), ("A", "a"), ("N", None)], "id string, path string")
    assert {(r.id, r.change) for r in incremental.affected_ids(diff, m).collect()} == {("B", "changed"), ("B2", "changed")}
    assert incremental.changes(incremental.hashes(old.limit(0)), incremental.hashes(new.limit(0))).count() == 0


def test_incremental_equals_full(spark):
    rng, encoder = random.Random(7), vector.hashing_encoder(16)
    state = {f"f{i}": f"text {i} word{i % 3}" for i in range(20)}
    empty_v = spark.createDataFrame([], "id string, file string, vec array<float>")
    vectors, hashes = empty_v, spark.createDataFrame([], "path string, sha256 string")
    for step in range(3):
        if step:
            for _ in range(4):
                state[rng.choice(sorted(state))] = f"new {rng.random()}"
            del state[rng.choice(sorted(state))]
            state[f"g{step}"] = "fresh file"
        files = spark.createDataFrame(sorted(state.items()), FILE)
        mapping = files.select(F.concat(F.lit("C"), "path").alias("id"), "path")
        documents = files.select(F.concat(F.lit("C"), "path").alias("id"), F.col("content").alias("document"))
        out = incremental.refresh_vectors(vectors, hashes, files, documents, mapping, encoder)
        vectors, hashes, stats = out["vectors"], out["hashes"], out["stats"].first()
        got = {r.id: list(r.vec) for r in vectors.collect()}
        want = {f"C{p}": list(encoder([t])[0]) for p, t in state.items()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
        assert stats.total == len(state) and (step == 0 or stats.encoded <= 5) and stats.deleted == (1 if step else 0)


def test_encoder(spark):
    e = vector.hashing_encoder(32)
    v = e(["CartModule loads", "cart module loads", "", None])
    assert np.allclose(v[0], v[1]) and abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not v[2].any() and not v[3].any()
    df = spark.createDataFrame([("a b",), (None,)], "t string").select(vector.encoded(F.col("t"), e).alias("v"))
    assert [len(r.v) for r in df.collect()] == [32, 32]


def test_top_k(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.5, 0.5]), ("d", None), ("e", [1.0])], "id string, vec array<float>")
    assert [r.id for r in vector.top_k(v, [1.0, 0.0], 2).collect()] == ["a", "b"]
    assert [r.id for r in vector.top_k(v, [1.0, 0.0], 2, without=["a"]).collect()] == ["b", "c"]
    mapped = spark.createDataFrame([("c",), ("b",)], "id string")
    assert [r.id for r in vector.top_k(v, [1.0, 0.0], 9, mapped=mapped).collect()] == ["b", "c"]
    assert vector.top_k(v.limit(0), [1.0, 0.0], 3).count() == 0


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    for name, data in {"app-a/lib/x/a.dart": b"class A extends Module {\n}\n", "app-a/lib/b.g.dart": b"class G {}", "app-a/test/t.dart": b"class T {}", "other/lib/o.dart": b"class O {}", "app-b/lib/bad.dart": b"class B\xff {}\r\n", "app-b/lib/e.dart": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


def test_scan_and_stores(spark, tree, tmp_path):
    got = {r.path: (r.repo, r.content) for r in sources.scan(spark, str(tree), "app-").collect()}
    assert got == {"app-a/lib/x/a.dart": ("app-a", "class A extends Module {\n}\n"), "app-b/lib/bad.dart": ("app-b", "class B� {}\r\n")}
    assert sources.scan(spark, str(tree), "app-", generated=True).count() == 3
    df = spark.createDataFrame([("a�\r\nb",)], "t string")
    assert df.select(sources.without_bad_bytes(F.col("t"))).first()[0] == "a\nb"
    from tessera.operators.extract import knowledge_graph

    g = knowledge_graph(sources.scan(spark, str(tree), "app-"), "scan")
    sources.save_graph(g, str(tmp_path / "g"), "scan")
    assert {r.id for r in sources.load_graph(spark, str(tmp_path / "g"))["nodes"].collect()} == {"A", "B"}
    sources.save_graph_json(g, str(tmp_path / "j"))
    doc = {"nodes": [{"id": "N", "type": "UI", "repo": "r", "methods": ["é"]}], "edges": [{"from": "N", "to": "M", "type": "binds"}], "file_mapping": {"N": {"path": "p", "line": 3}, "S": "old/path"}}
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    loaded = sources.load_graph_json(spark, str(tmp_path / "doc.json"))
    assert {(r.id, r.path, r.line) for r in loaded["file_map"].collect()} == {("N", "p", 3), ("S", "old/path", 1)}
    assert loaded["edges"].first().dst == "M" and loaded["nodes"].first().methods == ["é"]
    for value in (1, 2, 3):
        sources.swap(spark.createDataFrame([(value,)], "v int"), str(tmp_path / "snap"))
        assert spark.read.parquet(str(tmp_path / "snap")).first().v == value


def test_templates(spark, tree, tmp_path):
    for want in ("created", "skipped"):
        rows = sources.copy_templates(spark, str(tree / "app-a"), str(tmp_path / "t")).collect()
        assert {r.status for r in rows} == {want} and len(rows) == 3
    need = sources.missing_files(spark, ["a", "b"], spark.createDataFrame([("a",), ("a",)], "path string"))
    assert {(r.path, r.present) for r in need.collect()} == {("a", True), ("b", False)}


def test_tools(spark):
    nodes = spark.createDataFrame([("HomePage", "UI", "r", ["/v1"], ["E"], "UI"), ("CartModule", "Module", "r", [], [], "")], "id string, node_type string, repo string, api_paths array<string>, error_types array<string>, summary string")
    edges = spark.createDataFrame([("HomePage", "CartModule", "routes_to")], "src string, dst string, edge_type string")
    mapping = spark.createDataFrame([("HomePage", "r/home_page.dart", 1), ("CartModule", "r/cart.dart", 3)], "id string, path string, line int")
    files = spark.createDataFrame([("r", "r/home_page.dart", "class HomePage {\n}\n"), ("r", "r/cart.dart", "1\n2\nclass CartModule {\n")], "repo string, path string, content string")
    encoder = vector.hashing_encoder(16)
    vectors = nodes.select("id", vector.encoded(F.col("id"), encoder).alias("vec"))
    lexicon = spark.createDataFrame([("Basket", "cart")], "token string, synonyms string")
    space = tools.Workspace(nodes, edges, mapping, files, vectors, lexicon, encoder)
    out = [json.loads(x) for x in tools.serve(space, ["", "where is home", '{"tool": "list_nodes", "node_type": "ui"}', '{"tool": "nope"}', '{"tool": "search_by_api_path", "path": "/zzz"}'])]
    assert len(out) == 4
    assert {f["id"] for f in out[0]["flow_nodes"]} == {"HomePage", "CartModule"} and out[0]["graph"] == [{"line": "HomePage --[routes_to]--> CartModule"}]
    assert [n["id"] for n in out[1]] == ["HomePage"] and "error" in out[2] and out[3] == {"message": "nothing found"}
    text = tools.call(space, "get_file_content", path="r/cart.dart", class_name="CartModule").first()
    assert text.text.startswith("   1: 1") and (text.first, text.last, text.total, text.more_lines) == (1, 3, 3, 0)
    assert tools.call(space, "get_file_content", path="r/cart.dart", end_line=1).first().more_lines == 2
    assert tools.call(space, "get_blast_radius", node_id="CartModule").count() == 0
    assert tools.call(space, "grep_in_files", keyword="class", file_pattern="*page*").count() == 1
    assert tools.call(space, "search_by_filename", pattern="home").first().in_graph
    chosen = tools.call(space, "select_context", query="home in a flash")
    assert [r.path for r in chosen["flow"].collect()] == ["r/home_page.dart", "r/cart.dart"] and len(chosen["files"].collect()) == 2
    assert set(tools.call(space, "get_architecture_overview")) == {"graph_stats", "hub_nodes", "bridge_nodes", "cross_repo_coupling"}
    assert tools.call(space, "find_similar_modules", module_name="CartModule").count() == 0
    assert tools.call(space, "detect_communities", min_size=2).first()["size"] == 2


def test_roots_with_special_characters(spark, tmp_path):
    root = tmp_path / "a+b.c (d)"
    (root / "app-x" / "lib").mkdir(parents=True)
    (root / "app-x" / "lib" / "m.dart").write_text("class M {}\n")
    (root / "app-x" / "lib" / "m.g.dart").write_text("class G {}\n")
    for named in (str(root), f"{root}/", f"file://{root}", f"file:{root}"):
        assert [(r.repo, r.path) for r in sources.scan(spark, named, "app-").collect()] == [("app-x", "app-x/lib/m.dart")], named
    assert {r.path for r in sources.scan_tree(spark, str(root / "app-x"), "x").collect()} == {"lib/m.dart", "lib/m.g.dart"}
    assert sources.scan_tree(spark, str(tmp_path / "absent")).count() == 0


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://elsewhere:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        conf, sparkContext = Conf(), Context()

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_dir(Session())


def test_scratch_is_emptied(spark):
    with tables.scratch(spark) as made:
        assert tables.stage(spark.range(3)).count() == 3 and len(made) == 1
        where, fs = tables._file_system(spark, made[0])
        assert fs.exists(where)
    assert not fs.exists(where)


def test_build_db_and_rules(spark, tmp_path):
    encoder = vector.hashing_encoder(16)
    text = {"r/lib/a.dart": "class AModule extends Module {\n  i.addSingleton<BService>(BService.new);\n}\n", "r/lib/b.dart": "class BService {\n}\n"}
    schema = "repo string, path string, content string, scanned_at int"
    none = spark.createDataFrame([], "id string, node_type string")
    (tmp_path / "templates").mkdir()
    (tmp_path / "templates" / "workflow_full.md").write_text("rules")
    (tmp_path / "project").mkdir()
    stats = []
    for step in range(3):
        rows = [("r", p, t, 1) for p, t in text.items()] + [("r", "r/lib/a.dart", "class Old {}\n", 0)]
        space = tools.Workspace(none, none, none, spark.createDataFrame(rows, schema), encoder=encoder, store=str(tmp_path / "store"), templates=str(tmp_path / "templates"))
        s = tools.call(space, "build_db").first()
        stats.append((s.total, s.encoded, s.unchanged, s.deleted))
        if step == 0:
            text["r/lib/b.dart"] += "// more\n"
            text["r/lib/c.dart"] = "class CPage {\n}\n"
        elif step == 1:
            del text["r/lib/a.dart"]
            rows_old = text.setdefault("r/lib/a.dart", "")
            assert rows_old == ""
    assert stats == [(2, 2, 0, 0), (3, 2, 1, 0), (2, 0, 2, 1)]
    assert {r.id for r in sources.load_vectors(spark, str(tmp_path / "store")).collect()} == {"BService", "CPage"}
    served = json.loads(next(tools.serve(space, ['{"tool": "build_db"}'])))
    assert served == [{"total": 2, "encoded": 0, "deleted": 0, "unchanged": 2}]
    assert {r.id for r in space.nodes.collect()} == {"BService", "CPage"}
    project = str(tmp_path / "project")
    assert [r.present for r in tools.call(space, "check_steering", project_path=project, ide="cursor").collect()] == [False]
    for want in ("created", "skipped"):
        assert [(r.path, r.status) for r in tools.call(space, "init_steering", project_path=project, ide="Cursor").collect()] == [(".cursorrules", want)]
    assert [r.present for r in tools.call(space, "check_steering", project_path=project, ide="cursor").collect()] == [True]
    with pytest.raises(ValueError, match="no editor"):
        tools.call(space, "check_steering", project_path=project, ide="none")


def test_kept_tables_are_made_once_and_again_when_gone(spark, tmp_path):
    source = str(tmp_path / "t")
    spark.range(3).write.parquet(source)
    made = []
    make = lambda: made.append(1) or spark.range(3)
    with tables.scratch(spark):
        first = tables.kept(spark, source, "n", make)
    assert tables.kept(spark, source, "n", make) is first and first.count() == 3 and len(made) == 1
    tables.drop(first)
    assert tables.kept(spark, source, "n", make).count() == 3 and len(made) == 2
