import datetime as dt

from pyspark.sql import functions as F

from tessera.operators.orphans import child_rows, orphan_references, orphan_report, parent_rows

T = lambda d: dt.datetime(2025, 1, d, 12)
PARENT = "k string, b timestamp_ntz, e timestamp_ntz, parent_tbl string"
CHILD = "row bigint, k string, t timestamp_ntz, day string"


def run(spark, parents, children):
    p = spark.createDataFrame(parents, PARENT)
    c = spark.createDataFrame(children, CHILD)
    return orphan_references(
        [parent_rows(p, "p", F.col("k"), F.col("b"), F.col("e"))],
        [child_rows(c, "p", "c", F.col("row"), "k", F.col("k"), F.col("t"))],
    )


def kinds(df):
    return {(r.row_id, r.kind, r.period) for r in df.collect()}


def test_kinds_and_boundaries(spark):
    parents = [("a", T(5), T(10), "x"), ("a", T(20), None, "x"), ("b", T(9), T(3), None), ("n", None, None, None), (None, T(1), None, None)]
    children = [
        (1, "a", T(4), "x"), (2, "a", T(5), None), (3, "a", T(10), None), (4, "a", T(20), None), (5, "a", None, None),
        (6, "zz", T(1), None), (7, "zz", None, None), (8, "b", T(9), None), (9, "n", T(9), None), (10, None, T(9), None), (11, "A", T(6), None),
    ]
    got = kinds(run(spark, parents, children + [(6, "zz", T(1), None)]))
    assert got == {(1, "late", "2025-01"), (3, "deleted", "2025-01"), (6, "missing", "2025-01"), (7, "missing", "none"), (8, "deleted", "2025-01"), (9, "late", "2025-01"), (11, "missing", "2025-01")}


def test_repeated_rows_and_report(spark):
    df = run(spark, [], [(1, "a", T(1), None), (1, "a", T(1), None), (2, "b", None, None)])
    assert df.count() == 3
    assert {(r.period, r.n) for r in orphan_report(df).collect()} == {("2025-01", 2), ("none", 1)}


def test_empty(spark):
    assert run(spark, [], []).count() == 0
    assert run(spark, [("a", T(1), None, None)], []).count() == 0


def test_hot_key_against_brute_force(spark):
    parents = [("hot", T(1 + i % 28), T(1 + (i * 7) % 28), None) for i in range(40)]
    children = [(i, "hot", T(1 + i % 28), None) for i in range(200)]
    want = set()
    for row, _, t, _ in children:
        begun = [(b, e) for _, b, e, _ in parents if b <= t]
        if not begun:
            want.add((row, "late", "2025-01"))
        elif not any(e > t for _, e in begun):
            want.add((row, "deleted", "2025-01"))
    assert kinds(run(spark, parents, children)) == want


def test_a_third_of_the_rows_on_one_key(spark):
    """One key with null times and with all on one day: its rows are spread, and each is judged right."""
    import random

    rng = random.Random(4)
    at = lambda: dt.datetime(2025, 3, 7, rng.randrange(24), rng.randrange(60))
    parents = [("hot", at(), at(), None) for _ in range(30)] + [(f"k{i}", T(1 + i % 20), None, None) for i in range(60)]
    children = [(i, "hot", at(), None) for i in range(150)] + [(200 + i, "hot", None, None) for i in range(150)] + [(400 + i, "gone", None, None) for i in range(150)]
    children += [(1000 + i, f"k{i % 90}", T(1 + i % 28), None) for i in range(450)]
    lives = {}
    for k, b, e, _ in parents:
        lives.setdefault(k, []).append((b, e))
    want = set()
    for row, k, t, _ in children:
        begun = [(b, e) for b, e in lives.get(k, []) if t is not None and b <= t]
        period = f"{t:%Y-%m}" if t else "none"
        if k not in lives:
            want.add((row, "missing", period))
        elif t is not None and not begun:
            want.add((row, "late", period))
        elif t is not None and not any(e is None or e > t for _, e in begun):
            want.add((row, "deleted", period))
    df = run(spark, parents, children)
    assert kinds(df) == want and df.count() == len(want)
