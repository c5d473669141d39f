"""Every registered query of the training-data problems on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare  # noqa: E402

from tessera.llm.bpe import TOKENIZERS_DIR  # noqa: E402
from tessera.llm.catalogue import ORACLES, QUERIES  # noqa: E402

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(D) or not os.path.isdir(TOKENIZERS_DIR), reason="test tables or vocabularies not here")

COLUMNS = {
    "p1_found": {"file_id"}, "p2_recall": {"n_queries", "n_pairs", "recall"}, "p6_ids": {"doc_id", "ids"},
    "p7_mixture": {"doc_id", "source", "n_tokens", "copy_no", "position_key"}, "p8_found": {"doc_id", "subject"}, "p8_composition": {"subject", "n_documents"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], D) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, D)
    rows = df.collect()
    assert rows and (name not in COLUMNS or set(df.columns) == COLUMNS[name])
    if name == "p2_recall":
        assert rows[0].recall >= 0.9
    if name == "p7_shares":
        assert abs(sum(r.actual_share for r in rows) - 1) < 1e-9
    if name == "p8_composition":
        found = QUERIES["p8_found"](spark, D).groupBy("subject").count().collect()
        assert {r.subject: r.n_documents for r in rows if r.n_documents} == {r["subject"]: r["count"] for r in found}
