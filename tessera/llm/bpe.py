"""Byte-level BPE of whole texts with a public vocabulary.

A text is split by the vocabulary's public pattern; each pre-token becomes
ids through a rank queue:

* the bytes form a linked list of positions;
* each merge rank has a bucket of positions where its pair stands;
* a two-level bitmap holds the ranks with a bucket: find-first-set on the
  upper word, then on the lower one, gives the next rank;
* a position whose pair has changed since it was queued is stale and skipped.

A merge makes pairs of later ranks only, so a bucket is complete when its
rank comes up and each position is touched a constant number of times per
merge: a pre-token of n bytes takes about O(n) steps, where a scan for the
best pair takes O(n^2).  Short pre-tokens repeat all the time and are kept in
a table of bounded size per Python worker.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.sources.ship import ship

#: Where the public vocabularies lie, unless the caller says otherwise.
TOKENIZERS_DIR = "/opt/tokenizers"

#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bits of a bitmap word, and bounds of the table of known pre-tokens.
WORD, KNOWN_ENTRIES, KNOWN_LENGTH = 256, 1 << 18, 48


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in the vocabulary file, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class RankQueue:
    """Ranks with a bucket of positions each; the least rank comes first."""

    def __init__(self, n_ranks: int):
        self.low = [0] * (n_ranks // WORD + 1)
        self.high = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank // WORD
        self.low[word] |= 1 << (rank % WORD)
        self.high |= 1 << word

    def pop(self) -> tuple[int, list[int]]:
        word = (self.high & -self.high).bit_length() - 1
        bits = self.low[word]
        first = bits & -bits
        bits ^= first
        self.low[word] = bits
        if not bits:
            self.high ^= 1 << word
        rank = word * WORD + first.bit_length() - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()  # nearly in order already; overlapping pairs merge from the left
        return rank, bucket


class ByteBpe:
    """The ids of a text by the merges of a vocabulary file's bytes."""

    def __init__(self, raw: bytes):
        model = json.loads(raw)["model"]
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rank = {a << 20 | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.byte_id = [0] * 256
        for letter, byte in _byte_letters().items():
            self.byte_id[byte] = vocab[letter]
        self.queue = RankQueue(len(pairs))
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        byte_id, rank, queue = self.byte_id, self.rank, self.queue
        ids = [byte_id[b] for b in data]
        n = len(ids)
        for i in range(n - 1):
            r = rank.get(ids[i] << 20 | ids[i + 1])
            if r is not None:
                queue.push(r, i)
        if not queue.high:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue.high:
            r, bucket = queue.pop()
            a, b, new = self.left[r], self.right[r], self.made[r]
            for i in bucket:
                j = after[i]
                if ids[i] != a or j >= n or ids[j] != b:
                    continue  # stale
                ids[i], ids[j] = new, -1
                k, h = after[j], before[i]
                after[i] = k
                if k < n:
                    before[k] = i
                    q = rank.get(new << 20 | ids[k])
                    if q is not None:
                        queue.push(q, i)
                if h >= 0:
                    q = rank.get(ids[h] << 20 | new)
                    if q is not None:
                        queue.push(q, h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> array:
        """Ids of a text; strings of special tokens are ordinary text."""
        out, known = array("i"), self.known
        for token in self.split(text):
            ids = known.get(token)
            if ids is None:
                ids = self.piece(token.encode("utf-8"))
                if len(token) <= KNOWN_LENGTH:
                    if len(known) >= KNOWN_ENTRIES:
                        known.clear()
                    known[token] = ids
            out.extend(ids)
        return out


_LOADED: dict[str, ByteBpe] = {}


def _loaded(raw: bytes) -> ByteBpe:
    key = hashlib.md5(raw).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(raw)
    return _LOADED[key]


def _vocabulary(spark: SparkSession, name: str, folder: str):
    """The file's bytes for all workers: bounded by the vocabulary, not by data."""
    ship()
    with open(f"{folder}/{name}.json", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(bpe: ByteBpe, texts: Iterable[str | None]) -> tuple[array, array]:
    offsets, values = array("i", [0]), array("i")
    for text in texts:
        if text:
            values.extend(bpe.encode(text))
        offsets.append(len(values))
    return offsets, values


def token_ids(spark: SparkSession, text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS_DIR) -> Column:
    """array<int> of the ids of ``text``; an empty list for an empty or a null text.

    Whole texts of any length are encoded; other columns never reach Python.
    """
    raw = _vocabulary(spark, name, folder)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        offsets, values = _encoded(_loaded(raw.value), texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    return ids(text)


def token_count(spark: SparkSession, text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS_DIR) -> Column:
    """Number of tokens of ``text`` as bigint; 0 for an empty or a null text."""
    raw = _vocabulary(spark, name, folder)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        bpe = _loaded(raw.value)
        return pa.array([len(bpe.encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count(text)
