"""Properties that must hold for any input."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.bpe import TOKENIZERS_DIR, ByteBpe
from tessera.llm.mixture import means, tails, wanted
from tessera.llm.neighbours import Side, pack, tile_top, unit
from tessera.llm.sourcefiles import FEATURES, measure
from tessera.llm.subjects import sentences_of

PATH = f"{TOKENIZERS_DIR}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokenizers():
    if not os.path.exists(PATH):
        pytest.skip("public vocabulary not here")
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(PATH)
    public.encode_special_tokens = True
    with open(PATH, "rb") as f:
        return ByteBpe(f.read()), public


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=120))
def test_ids_equal_the_public_library(tokenizers, text):
    own, public = tokenizers
    assert list(own.encode(text)) == public.encode(text, add_special_tokens=False).ids
    assert public.decode(list(own.encode(text)), skip_special_tokens=False) == text or not text.isprintable()


@settings(max_examples=60, deadline=None)
@given(mean=st.floats(0, 40), cap=st.integers(1, 9))
def test_tails_fall_and_are_probabilities(mean, cap):
    t = tails(mean, cap)
    assert len(t) == cap and t == sorted(t, reverse=True) and 0 <= t[-1] and t[0] <= 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=5), st.integers(1, 4), st.integers(0, 10_000))
def test_means_meet_targets_of_large_sources(shares, cap, seed):
    total = sum(shares)
    rng = np.random.default_rng(seed)
    near = {str(i): np.sort(rng.random(40_000)) for i in range(len(shares))}
    want = wanted({s: 40_000 for s in near}, {str(i): (s / total, cap) for i, s in enumerate(shares)})

    def drawn(grid):
        return {s: [int(sum(np.searchsorted(near[s], x, side="right") for x in tails(m, cap))) for m in tried] for s, tried in grid.items()}

    found = means(want, {s: (40_000, 40_000.0) for s in near}, dict.fromkeys(near, cap), drawn)
    for s, m in found.items():
        assert abs(drawn({s: [m]})[s][0] - want[s]) <= max(cap, 1e-4 * want[s])


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.one_of(st.none(), st.text(max_size=9)))
def test_any_file_has_finite_features(text, repo):
    x, label = measure(text, repo)
    assert label in (None, 0.0, 1.0) and len(x) == len(FEATURES) and np.isfinite(x).all()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_sentences_hold_distinct_words(text):
    for s in sentences_of(text):
        words = s.split(" ")
        assert len(words) > 1 and len(set(words)) == len(words)


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 40), st.integers(1, 12), st.integers(0, 10_000))
def test_tile_top_is_exact(rows, k, seed):
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(size=(rows, 24)), 1).astype(np.float32)
    values[:, 0] += 0.05
    values[rows // 2] = values[0]
    side = Side([np.arange(rows, dtype=np.int64).tobytes()], [pack(values)], 24)
    q, n, _ = tile_top(side, side, k)
    s = np.round(unit(values, np.float64) @ unit(values, np.float64).T, 12)
    for i in range(rows):
        assert list(n[q == i]) == sorted((j for j in range(rows) if j != i), key=lambda j: (-s[i, j], j))[:k]
