import itertools
import random

import pytest

from tessera.llm import setjoin
from tessera.llm.setjoin import similar_sets

SCHEMA = "set_name string, id string, items array<string>, cls string, n int, salt string"


def brute(rows, t=0.6, least=4):
    sets = {(k, i): {x for x in items or [] if x is not None} for k, i, items in rows if i is not None}
    out = set()
    for (ka, a), (kb, b) in itertools.combinations(sorted(sets, key=lambda x: (x[0], x[1].encode())), 2):
        x, y = sets[ka, a], sets[kb, b]
        if ka == kb and min(len(x), len(y)) >= least and len(x & y) / len(x | y) >= t:
            out.add((ka, a, b))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "c", 1, "s") for r in rows], SCHEMA)
    got = [(r.set_name, r.id_a, r.id_b) for r in similar_sets(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def sets(rng, n):
    base = [rng.sample(range(200), rng.randint(4, 14)) for _ in range(n // 4)]
    for i in range(n):
        items = [f"i{x}" for x in rng.choice(base)]
        for _ in range(rng.randint(0, 3)):
            items[rng.randrange(len(items))] = f"i{rng.randrange(200)}"
        yield ("k" if i % 3 else "l", f"r{i}", items + [None, items[0]] * (i % 2))


def test_against_brute_force(spark):
    rows = list(sets(random.Random(5), 160))
    rows += [("k", "nul", None), ("k", "emp", []), ("k", None, ["a", "b", "c", "d"]), ("k", "few", ["a", "b", "c"]), ("k", "few2", ["a", "b", "c"])]
    rows += [rows[1], ("k", "Z", ["a", "b", "c", "d"]), ("k", "é", ["d", "c", "b", "a"]), ("l", "Z", ["a", "b", "c", "d"])]
    assert run(spark, rows) == brute(rows)


def test_crowded_buckets_are_exact(spark, monkeypatch):
    """Prefix filtering loses nothing: with every shared bucket crowded, all pairs of these sets come out."""
    monkeypatch.setattr(setjoin, "BUCKET", 1)
    monkeypatch.setattr(setjoin, "PART", 8)
    rng = random.Random(6)
    rows = [("k", f"r{i}", [*"abcdefgh", *rng.sample("uvwxyz", rng.randint(0, 4))]) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_crowded_at_the_real_size(spark):
    """Buckets of more than BUCKET classes: sets that share most items."""
    rng = random.Random(8)
    rows = [("k", f"r{i}", [f"c{j}" for j in range(9)] + [f"u{rng.randrange(40)}" for _ in range(2)]) for i in range(420)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("t", [0.3, 0.5, 0.6, 0.8, 1.0])
def test_recall_at_any_threshold(spark, t):
    """Planted pairs just at the threshold, all else disjoint."""
    n, rows = 400, []
    for i in range(n):
        size = {0.3: (6, 7, 7), 0.5: (8, 4, 4), 0.6: (6, 2, 2), 0.8: (8, 1, 1), 1.0: (6, 0, 0)}[t]
        common = [f"p{i}c{j}" for j in range(size[0])]
        rows += [("k", f"a{i}", common + [f"p{i}a{j}" for j in range(size[1])]), ("k", f"b{i}", common + [f"p{i}b{j}" for j in range(size[2])])]
    df = spark.createDataFrame([(*r, "c", 1, "s") for r in rows], SCHEMA)
    got = {(r.id_a, r.id_b) for r in similar_sets(df, t).collect()}
    assert got <= {(f"a{i}", f"b{i}") for i in range(n)} and len(got) >= 0.99 * n
    bands, per = setjoin.bands_for(t)
    assert (1 - t**per) ** bands <= setjoin.MISS


def test_parts_of_large_classes(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "PART", 7)
    rows = [("k", f"x{i}", list("abcde")) for i in range(40)] + [("k", f"y{i}", list("abcd")) for i in range(25)] + [("k", "z", list("vwxyz"))]
    assert run(spark, rows) == brute(rows)
    found = setjoin.similar_classes(spark.createDataFrame([(*r, "c", 1, "s") for r in rows], SCHEMA))
    assert found.pairs.count() == 1 and found.members.count() == 66 and found.classes.count() == 3


def test_threshold_must_be_a_share(spark):
    for t in (0, -1, 1.5):
        with pytest.raises(ValueError, match="threshold"):
            similar_sets(spark.createDataFrame([], SCHEMA), t)


def test_copies_are_one_class(spark):
    rows = [("k", f"r{i:03d}", ["a", "b", "c", "d"]) for i in range(60)]
    assert len(run(spark, rows)) == 60 * 59 // 2


@pytest.mark.parametrize("rows", [[], [("k", "a", ["1", "2", "3", "4"])]])
def test_empty(spark, rows):
    assert run(spark, rows) == set()
