"""Every core query against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare

from tessera.plans import catalogue, problems

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = {**catalogue.QUERIES, **problems.QUERIES}, {**catalogue.ORACLES, **problems.ORACLES}
SLOW = {"q_community_profiles"}  # the same work as q_communities

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="test tables not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name], D)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() >= 0


def test_core_knows_nothing_of_llm():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tessera")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "tessera.llm" not in text.read(), f
