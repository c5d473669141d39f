import itertools
import os
import random
from collections import deque

import pytest

from tessera.operators import graph
from tessera.operators.communities import communities, community_profiles, modularity
from tessera.operators.extract import similar_to

EDGE, NODE, ID = "src string, dst string, edge_type string", "id string, node_type string, repo string", "id string"


def es(spark, *pairs, kind="depends_on"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], EDGE)


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], ID)


def test_flow_depth_and_dangling(spark):
    e = spark.createDataFrame([("a", "b", "routes_to"), ("b", "c", "routes_to"), ("c", "gone", "depends_on"), ("a", "x", "binds"), ("c", "a", "routes_to")], EDGE)
    assert {(r.id, r.depth) for r in graph.trace_flow(e, ids(spark, "a"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.id for r in graph.trace_flow(e, ids(spark, "a"), types=("routes_to",)).collect()} == {"a", "b", "c"}
    assert {r.id for r in graph.trace_flow(e, ids(spark, "a")).collect()} == {"a", "b", "c", "gone"}
    text = [r.line for r in graph.graph_text(e, ids(spark, "b")).collect()]
    assert sorted(text) == ["a --[routes_to]--> b", "b --[routes_to]--> c"]


def test_shorter_way_wins(spark):
    long = [("s", "p"), ("p", "q"), ("q", "r"), ("r", "t"), ("s", "t"), ("t", "u"), ("u", "v")]
    assert {r.id: r.depth for r in graph.trace_flow(es(spark, *long), ids(spark, "s"), 3).collect()} == {"s": 0, "p": 1, "t": 1, "q": 2, "u": 2, "r": 3, "v": 3}


def test_entries(spark):
    e = spark.createDataFrame([("s", "t", "binds"), ("ui", "t", "depends_on"), ("svc", "t", "depends_on"), ("unmapped", "t", "depends_on")], EDGE)
    n = spark.createDataFrame([("ui", "UI", "r"), ("svc", "Service", "r"), ("unmapped", "UI", "r")], NODE)
    got = graph.trace_flow_with_entries(e, n, ids(spark, ["ui", "svc"]), ids(spark, "s"))
    assert {(r.id, r.depth) for r in got.collect()} == {("s", 0), ("t", 1), ("ui", -1)}


def test_blast_radius(spark):
    e = es(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"))
    got = {r.id: (r.depth, r.path) for r in graph.blast_radius(e, "a").collect()}
    assert got == {"c": (1, ["a", "c"]), "d": (1, ["a", "d"]), "b": (2, ["a", "c", "b"]), "a": (3, ["a", "c", "b", "a"])}
    assert graph.blast_radius(e, "nobody").count() == 0
    n = spark.createDataFrame([("c", "UI", "r")], NODE)
    assert {(r.node_type, r.n) for r in graph.blast_summary(graph.blast_radius(e, "a", 1), n).collect()} == {("UI", 1), ("Unknown", 1)}


def test_degrees_hubs_coupling(spark):
    e = es(spark, ("a", "a"), ("a", "b"), ("a", "b"), ("b", "c"))
    assert {r.id: r.degree for r in graph.degrees(e).collect()} == {"a": 4, "b": 3, "c": 1}
    n = spark.createDataFrame([("a", "UI", "r1"), ("b", "UI", "r2"), ("c", "UI", "")], NODE)
    assert [r.id for r in graph.hubs(e, n, ids(spark, "ab"), 1).collect()] == ["a"]
    assert [(r.repo_a, r.repo_b, r.n) for r in graph.repo_coupling(e, n, least=2).collect()] == [("r1", "r2", 2)]
    stats = graph.graph_stats(e, n, ids(spark, "ab")).first()
    assert (stats.total_nodes, stats.total_edges, stats.repos) == (3, 3, 3)
    empty = e.limit(0)
    assert graph.hubs(empty, n, ids(spark, "ab")).count() == 0 and graph.graph_stats(empty, n.limit(0), ids(spark, "a")).first().total_nodes == 0


def brandes(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = dict.fromkeys(near, 0.0)
    for s in near:
        order, dist, paths, before = [], {s: 0}, {s: 1.0}, {}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] = paths.get(w, 0) + paths[v]
                    before.setdefault(w, []).append(v)
        owed = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, ()):
                owed[v] += paths[v] / paths[w] * (1 + owed[w])
            if w != s:
                out[w] += owed[w] / 2
    return out


@pytest.mark.parametrize("kind", ["path", "random", "none"])
def test_betweenness(spark, kind):
    rng = random.Random(4)
    pairs = {"path": [(x, y) for x, y in itertools.pairwise("abcde")] + [("a", "b"), ("c", "c")], "random": [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(26)], "none": []}[kind]
    got = {r.id: r.betweenness for r in graph.betweenness(spark.createDataFrame([(a, b, "x") for a, b in pairs], EDGE)).collect()}
    want = brandes(pairs)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    if kind == "path":
        assert [(r.id, r.betweenness) for r in graph.betweenness(es(spark, *pairs), 2).collect()] == [("c", 4.0), ("b", 3.0)]


def test_components(spark):
    rng = random.Random(9)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [(f"m{rng.randrange(30)}", f"m{rng.randrange(30)}") for _ in range(20)]
    e = es(spark, *pairs)
    names = sorted({x for p in pairs for x in p} | {"alone"})
    got = {r.id: r.component for r in graph.components(e, ids(spark, names)).collect()}
    assert set(got) == set(names) and got["alone"] == "alone" and {got[f"n{i}"] for i in range(41)} == {"n0"}
    assert all(got[a] == got[b] for a, b in pairs) and all(min(k for k, v in got.items() if v == c) == c for c in set(got.values()))


def test_communities(spark):
    cliques = [(f"a{i}", f"a{j}") for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(5) for j in range(i)] + [("a0", "b0"), ("a1", "a1"), ("zz", "a0")]
    e, names = es(spark, *cliques), [f"{x}{i}" for x in "ab" for i in range(5)] + ["lone"]
    member = communities(e, ids(spark, names))
    got = {r.id: r.community for r in member.collect()}
    assert set(got) == set(names) and got["lone"] == "lone"
    assert {got[f"a{i}"] for i in range(5)} == {"a0"} and {got[f"b{i}"] for i in range(5)} == {"b0"}
    inside = e.filter("src <> 'zz'")
    single = ids(spark, names).selectExpr("id", "id AS community")
    assert modularity(inside, member) > max(0.3, modularity(inside, single))
    n = spark.createDataFrame([(f"a{i}", "UI", "r1" if i else "r2") for i in range(5)], NODE)
    rows = community_profiles(member, n).collect()
    assert [(r.community, r.name, r.size, r.key_nodes[0]) for r in rows] == [("a0", "r1", 5, "a0"), ("b0", "", 5, "b0")] and rows[0].repo_distribution == {"r1": 4, "r2": 1}
    assert communities(e.limit(0), ids(spark, names)).count() == len(names)


def test_similar_modules(spark):
    e = spark.createDataFrame([("m", "GetCartUseCase", "binds"), ("n", "CreateCartUseCase", "binds"), ("n", "CartUseCaseX", "binds"), ("o", "PayUseCase", "binds"), ("m", "Repo", "binds"), ("p", "GetCartUseCase", "binds")], EDGE)
    assert [(r.module, r.score) for r in graph.similar_modules(e, "m").collect()] == [("n", 2), ("p", 1)]
    assert graph.similar_modules(e, "none").count() == 0
    assert [(r.src, r.dst, r.shared_usecases) for r in similar_to(e).collect()] == [("m", "p", ["GetCartUseCase"])]


def test_entry_nodes_and_priority(spark):
    m = ids(spark, ["HomePage", "FSellPage", "Other", "HomeFlash"])
    triggers = (("home", ("home",)), ("flash", ("flash", "fsell")))
    assert [r.id for r in graph.entry_nodes(m, "Home and FLASH", triggers).collect()] == ["FSellPage", "HomeFlash", "HomePage"]
    assert graph.entry_nodes(m, "cart", triggers).count() == 0
    f = spark.createDataFrame([("z.dart", 0), ("a_bloc.dart", 1), ("b_page.dart", 2), ("b_page.dart", 3), (None, 4)], "path string, pos int")
    assert [(r.path, r.rank) for r in graph.priority(f).collect()] == [("b_page.dart", 1), ("a_bloc.dart", 2), ("z.dart", 3)]


def test_betweenness_from_pivots(spark):
    rng = random.Random(9)
    names = [f"n{i:02d}" for i in range(30)]
    e = es(spark, *{tuple(rng.sample(names, 2)) for _ in range(55)})
    exact = {r.id: r.betweenness for r in graph.betweenness(e).collect()}
    assert {r.id: round(r.betweenness, 6) for r in graph.betweenness(e, pivots=99).collect()} == {k: round(v, 6) for k, v in exact.items()}
    some = {r.id: r.betweenness for r in graph.betweenness(e, pivots=15).collect()}
    n = len(exact)
    assert set(some) == set(exact) and max(abs(some[k] - exact[k]) for k in exact) < 0.2 * n * n / 2
    assert graph.pivots_for(10**9, 0.01) < 10**6 and graph.pivots_for(5, 0.01) == 5


def test_betweenness_held_and_by_joins_agree(spark, monkeypatch):
    rng = random.Random(12)
    pairs = {tuple(rng.sample([f"n{i:02d}" for i in range(16)], 2)) for _ in range(20)} | {(f"t{i}", f"t{i // 2}") for i in range(1, 9)} | {("t0", "n00"), ("x", "y")}
    e, want = es(spark, *pairs), brandes(pairs)
    monkeypatch.setattr(graph, "HELD_EDGES", 0)
    joins = {r.id: r.betweenness for r in graph.betweenness(e).collect()}
    monkeypatch.undo()
    held = {r.id: r.betweenness for r in graph.betweenness(e).collect()}
    assert held.keys() == joins.keys() == want.keys() and all(abs(held[v] - want[v]) < 1e-9 and abs(joins[v] - want[v]) < 1e-9 for v in want)


def test_betweenness_of_a_large_graph_ends(spark):
    rng = random.Random(13)
    chain, n = [("a%05d" % i, "a%05d" % (i + 1)) for i in range(3000)], 1500  # by joins: a job for each of 3,000 levels
    pairs = chain + [(f"n{i}", f"n{rng.randrange(n)}") for i in range(n) for _ in range(2)]
    got = {r.id: r.betweenness for r in graph.betweenness(es(spark, *pairs), 3001 + n).collect()}
    assert got["a01500"] == 1500.0 * 1500 and "a00000" not in got
    some = brandes(pairs[len(chain) :])
    assert all(abs(got.get(v, 0.0) - some[v]) <= 0.00501 for v in some)


@pytest.mark.parametrize("pivots", [None, 99])
def test_walks_by_joins_go_in_batches_that_leave_no_files(spark, monkeypatch, pivots):
    rng = random.Random(17)
    pairs = {tuple(rng.sample([f"n{i:02d}" for i in range(18)], 2)) for _ in range(24)} | {("x", "y"), ("t0", "n00")}
    monkeypatch.setattr(graph, "HELD_EDGES", 0)
    monkeypatch.setattr(graph, "WALKED_PAIRS", 120)
    rows, stage = [], graph.stage

    def counted(df, label="t", **kw):
        out = stage(df, label, **kw)
        if label in ("level", "owed"):
            rows.append((out.count(), kw, out._tessera_path.removeprefix("file://")))
        return out

    monkeypatch.setattr(graph, "stage", counted)
    got, want = {r.id: r.betweenness for r in graph.betweenness(es(spark, *pairs), pivots=pivots).collect()}, brandes(pairs)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert len(rows) > 8 and max(n for n, _, _ in rows) <= 120 and not any(os.path.exists(p) for _, _, p in rows)


def test_a_graph_of_two_million_edges_is_held_by_tasks():
    assert graph.HELD_EDGES > 2_000_000  # 1 GB of tables; by joins a pair of nodes each would be on disk
