import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.bpe import TOKENIZERS_DIR, ByteBpe, RankQueue, token_count, token_ids

PATH = f"{TOKENIZERS_DIR}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="public vocabulary not here")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(PATH)
    public.encode_special_tokens = True
    with open(PATH, "rb") as f:
        return ByteBpe(f.read()), lambda t: public.encode(t, add_special_tokens=False).ids


def test_rank_queue_order():
    rng, q, want = random.Random(1), RankQueue(50_000), {}
    for i in range(500):
        r = rng.randrange(50_000)
        q.push(r, i)
        want.setdefault(r, []).append(i)
    got = []
    while q.high:
        got.append(q.pop())
    assert got == [(r, want[r]) for r in sorted(want)]


def test_same_ids_as_public_library(both):
    own, public = both
    rng = random.Random(2)
    texts = ["", " ", "<|endoftext|>", "x<|endoftext|>y", "It's   we'LL\n\n\t ok", "é ​ ‮abc", "🙂🙂", "漢字かな", "a" * 5000]
    for letters in ("ab", "abcdefghij ", " \n\t'sx", "áéñữ漢🙂x", "0123456789,.-"):
        texts += ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 7, 60, 2500)]
    for t in texts:
        assert list(own.encode(t)) == public(t), t[:50]


def test_long_pretoken_is_nearly_linear(both):
    own, _ = both
    assert sum(1 for _ in own.encode("ab" * 200_000)) > 0


def test_columns(spark, both):
    own, _ = both
    rows = [(1, "Hello world", "x"), (2, "", "y"), (3, None, None), (1, "Hello world", "x"), (4, "z" * 30_000, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = df.select("doc_id", token_ids(spark, F.col("text")).alias("t"), token_count(spark, F.col("text")).alias("n")).collect()
    assert sorted((r.doc_id, tuple(r.t), r.n) for r in got) == sorted((i, tuple(own.encode(t)) if t else (), len(own.encode(t)) if t else 0) for i, t, _ in rows)
    assert df.limit(0).select(token_ids(spark, F.col("text"))).count() == 0
