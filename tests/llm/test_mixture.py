import math
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.llm.bpe import token_count
from tessera.llm.mixture import mean_for, means, mixture, shares, tails, wanted

RECORD = "doc_id bigint, source string, size bigint, n_tokens string, distance int"
TARGET = "source string, target_share double, max_repeats int"


def make(spark, rows, targets, **kw):
    r = spark.createDataFrame([(*x, "clash", 1) for x in rows], RECORD)
    t = spark.createDataFrame(targets, TARGET)
    m = mixture(r, t, "doc_id", F.col("source"), F.col("size"), **kw)
    return m, {x.source: x for x in shares(m, t, "doc_id").collect()}


def test_shares_caps_and_names(spark):
    rows = [(i, [" Web", "web\t", "WEB", "web"][i % 4], 10 + i % 7) for i in range(6000)]
    rows += [(10_000 + i, "small", 20) for i in range(300)]
    rows += [(20_000 + i, s, 50) for i, s in enumerate([None, "other", ""] * 20)]
    m, got = make(spark, rows, [("web", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 3)])
    assert abs(got["web"].actual_share - 0.6 / 0.9) < 1e-3 and abs(got["small"].actual_share - 0.3 / 0.9) < 1e-3
    assert got["absent"].actual_share == 0 and got["absent"].n_copies == 0
    assert got["web"].most_copies == 1 and 1 < got["small"].most_copies <= 4
    sources = {r.doc_id: r.source for r in m.collect()}
    assert set(sources.values()) == {"web", "small"} and max(sources) < 20_000
    order = [r.position_key for r in m.collect()]
    assert order == sorted(order)


def test_deterministic_and_repeated_rows(spark):
    rows = [(i // 2, "a", 5) for i in range(400)]
    first, second = (sorted((r.doc_id, r.copy_no) for r in make(spark, rows, [("a", 1.0, 2)])[0].collect()) for _ in range(2))
    assert first == second
    assert all(first.count(x) % 2 == 0 for x in first)


def test_nulls_zero_sizes_and_empty(spark):
    m, got = make(spark, [(1, "a", None), (2, "a", 0)], [("a", 1.0, 2), ("b", None, 1), (None, 0.2, 1)])
    assert m.count() == 0 and got["a"].actual_share == 0
    m, got = make(spark, [], [])
    assert m.count() == 0 and got == {}
    m, got = make(spark, [(1, "a", 3)], [("a", 1.0, 0)])
    assert m.count() == 0


def test_a_wanted_total(spark):
    rows = [(i, "a", 1) for i in range(4000)] + [(9000 + i, "b", 2) for i in range(4000)]
    _, got = make(spark, rows, [("a", 0.5, 3), ("b", 0.5, 3)], total=1000)
    assert got["a"].n_tokens == 500 and got["b"].n_tokens == 500


def test_low_rates_meet_their_targets(spark):
    rows = [(i, "large", 1) for i in range(60_000)] + [(100_000 + i, "small", 1) for i in range(100)]
    for share in (0.5, 0.05):  # rates of about 1 / 600 to 1 / 11000
        m, got = make(spark, rows, [("large", share, 3), ("small", 1 - share, 1)])
        want = 0.95 * 100 / (1 - share) * share
        assert abs(got["large"].n_tokens - want) <= 1, (share, got["large"].n_tokens, want)


def test_tails_are_a_poisson_distribution():
    one, two, *_ = tails(1.0, 4)
    assert abs(one - (1 - math.exp(-1))) < 1e-12 and abs(two - (1 - 2 * math.exp(-1))) < 1e-12
    for rate in (1e-15, 1e-9, 1e-5, 0.0012, 0.1, 0.9):
        t = tails(rate, 3)
        assert abs(t[0] / -math.expm1(-rate) - 1) < 1e-9 and t == sorted(t, reverse=True)
        assert abs(mean_for(sum(t), 3) / rate - 1) < 1e-6


def test_shares_hold_where_sources_differ_a_million_times():
    """The large source has 10^9 records; only those that such rates can reach are made."""
    rng = np.random.default_rng(3)
    n, reach = 10**9, 1e-3
    near = np.sort(rng.random(rng.binomial(n, reach)) * reach)
    small = np.sort(rng.random(1000))
    v = {"large": near, "small": small}
    caps, targets = {"large": 1, "small": 3}, {"large": (0.5, 1), "small": (0.5, 3)}
    want = wanted({"large": n, "small": 1000}, targets)
    passes = []

    def drawn(grid):
        passes.append(1)
        return {s: [int(sum(np.searchsorted(v[s], t, side="right") for t in tails(m, caps[s]))) for m in tried] for s, tried in grid.items()}

    found = means(want, {"large": (n, float(n)), "small": (1000, 1000.0)}, caps, drawn)
    got = {s: d[0] for s, d in drawn({s: [m] for s, m in found.items()}).items()}
    whole = sum(got.values())
    assert all(abs(got[s] / whole - 0.5) < 0.005 for s in got), got
    assert len(passes) < 12


def test_unlisted_sources_are_never_encoded(spark):
    r = spark.createDataFrame([(1, "a", "text"), (2, "b", "more text")], "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 2)], TARGET)
    kept = []
    from tessera.llm import mixture as module

    real, module.stage = module.stage, lambda df, label: kept.append(df) or real(df, label)
    try:
        mixture(r, t, "doc_id", F.col("source"), token_count(spark, F.col("text")))
    finally:
        module.stage = real
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    at = lambda word: next(i for i, x in enumerate(lines) if re.search(word, x))
    assert at("ArrowEvalPython") < at("LeftSemi"), plan  # the join is below the encoding


def test_shares_equal_sql_over_a_staged_mixture(spark, tmp_path):
    rows = [(i, ["a", "b", "c"][i % 3], i % 50) for i in range(3000)]
    m, got = make(spark, rows, [("a", 0.6, 1), ("b", 0.1, 2), ("c", 0.3, 2), ("d", 0.2, 1)])
    m.write.parquet(str(tmp_path / "m"))
    sql = f"""WITH m AS (SELECT * FROM read_parquet('{tmp_path}/m/*.parquet'))
      SELECT source, sum(n_tokens) / (SELECT sum(n_tokens) FROM m), sum(n_tokens), count(*), count(DISTINCT doc_id), max(copy_no) FROM m GROUP BY source"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    assert set(want) == {"a", "b", "c"}
    for s, (share, *counts) in want.items():
        assert abs(got[s].actual_share - share) < 1e-12 and [got[s].n_tokens, got[s].n_copies, got[s].n_records, got[s].most_copies] == counts


def test_one_huge_record_is_no_excuse(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "a", int(x)) for i, x in enumerate(rng.integers(1, 60, 4000))] + [(5000, "a", 20_000)] + [(10_000 + i, "b", 30) for i in range(4000)]
    _, got = make(spark, rows, [("a", 0.5, 2), ("b", 0.5, 2)])
    assert abs(got["a"].actual_share - 0.5) < 5e-4
