import random

from tessera.operators import hierarchy
from tessera.operators.hierarchy import descendants, hierarchies

LINK = "parent string, child string, edge_id bigint, id string"


def brute(links):
    parent = {}
    for p, c, e, _ in sorted(links, key=lambda x: (x[2], x[0])):
        parent.setdefault(c, p)
    out = {}
    for n in {x for p, c, _, _ in links for x in (p, c)}:
        path, seen = [n], {n}
        while path[-1] in parent and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        if path[-1] not in parent:
            out[n] = (path[-1], len(path) - 1, tuple(reversed(path)))
        else:
            loop = path[path.index(parent[path[-1]]) :]
            out[n] = (min(loop), -1 if n in loop else -2, ())
    return out


def check(spark, links):
    tree = hierarchies(spark.createDataFrame(links, LINK)).cache()
    got = {r.id: (r.root_id, r.depth, tuple(r.path)) for r in tree.collect()}
    want = brute(links)
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {}
    assert tree.count() == len(got) == len(want)
    below = {(r.id, r.descendant, r.distance) for r in descendants(tree).collect()}
    assert below == {(a, n, len(p) - 1 - i) for n, (_, d, p) in got.items() if d > 0 for i, a in enumerate(p[:-1])}
    tree.unpersist()


def test_shapes(spark):
    chain = [(f"c{i}", f"c{i + 1}", i, None) for i in range(37)]
    loops = [("s", "s", 100, None), ("s", "t", 101, None), ("x", "y", 102, None), ("y", "z", 103, "q"), ("z", "x", 104, None), ("z", "w", 105, None), ("w", "v", 106, None)]
    ties = [("r1", "m", 200, None), ("r2", "m", 200, None), ("r3", "m", 199, None), ("r3", "m", 199, None)]
    check(spark, chain + loops + ties)


def test_random(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(60)]
    check(spark, [(rng.choice(names), rng.choice(names), i, None) for i in range(45)])


def test_hot_parent(spark):
    check(spark, [("top", "hub", 0, None)] + [("hub", f"k{i}", i + 1, None) for i in range(300)])


def test_empty(spark):
    assert hierarchies(spark.createDataFrame([], LINK)).count() == 0


def test_nothing_is_sent_through_the_driver(spark):
    rows = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "id string, anc string, dist int")
    plan = hierarchy._follow(rows, rows, 2, "l.id", "r.anc")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
