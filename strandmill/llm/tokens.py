"""Encoding of texts with the vocabulary of a public byte-level BPE tokenizer.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that
are vocabulary entries as a whole; each of the others is merged by a heap over
its linked bytes. A task meets the same pre-tokens again and again, so each is
encoded once while it stays in the task's bounded memo.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that cuts a text into pre-tokens before the merges of the vocabulary apply.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a task remembers; beyond that the memo starts anew.
MEMO_ENTRIES = 400_000
#: Mean number of entries that share a displacement in the perfect hash.
BUCKET = 2

_PRIME = (1 << 61) - 1


def two_hashes(key: bytes, seed: int) -> tuple[int, int]:
    """Two 61-bit hashes of a byte string: its residue modulo a Mersenne prime, scrambled twice."""
    value = (int.from_bytes(key, "little") + (len(key) << 3) + 1) % _PRIME
    first = value * (0x1B873593CC9E2D51 + 2 * seed) % _PRIME
    return first, (first ^ (first >> 29)) * 0x165667B19E3779F9 % _PRIME


class PerfectHash:
    """Minimal perfect hash by displacement: n keys to the places 0 .. n - 1 without a collision.

    Keys fall into buckets by one hash; from the largest bucket on, each gets
    the first displacement that moves all its keys to free places; a bucket of
    one key gets a free place directly. Looking up costs two hashes and one
    comparison with the key stored at the place.
    """

    def __init__(self, entries: dict[bytes, int]):
        keys = list(entries)
        self.size = len(keys)
        for self.seed in range(64):
            if self._build(keys):
                break
        else:
            raise ValueError("no perfect hash was found")
        self.keys: list[bytes] = [b""] * self.size
        self.values = [0] * self.size
        for key in keys:
            place = self.place(key)
            self.keys[place], self.values[place] = key, entries[key]

    def _build(self, keys: list[bytes]) -> bool:
        self.buckets = max(1, len(keys) // BUCKET)
        members: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for key in keys:
            first, second = two_hashes(key, self.seed)
            members[first % self.buckets].append((first // self.buckets, second))
        taken = bytearray(self.size)
        self.displacement = [0] * self.buckets
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        for bucket in (b for b in order if len(members[b]) > 1):
            for shift in range(20 * self.size):
                places = {(first + shift * second) % _PRIME % self.size for first, second in members[bucket]}
                if len(places) == len(members[bucket]) and not any(taken[p] for p in places):
                    break
            else:
                return False
            self.displacement[bucket] = shift
            for p in places:
                taken[p] = 1
        free = (p for p in range(self.size) if not taken[p])
        for bucket in (b for b in order if len(members[b]) == 1):
            self.displacement[bucket] = -1 - next(free)
        return True

    def place(self, key: bytes) -> int:
        first, second = two_hashes(key, self.seed)
        shift = self.displacement[first % self.buckets]
        return -1 - shift if shift < 0 else (first // self.buckets + shift * second) % _PRIME % self.size

    def get(self, key: bytes) -> int | None:
        """The value stored for ``key``, None if it is none of the keys."""
        place = self.place(key)
        return self.values[place] if self.keys[place] == key else None


def merged(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: pairs of neighbours merge in order of rank, then of position.

    The parts are a doubly linked list over the bytes; a heap holds the
    mergeable pairs, and a pair that has changed since is skipped.
    """
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins here; 0 once it is merged into the one before
    previous = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = rank.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, stop = pop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            previous[stop] = i
            r = rank.get(word[i : end[stop]])
            if r is not None:
                push(heap, (r, i, end[stop]))
        before = previous[i]
        if before >= 0:
            r = rank.get(word[before:stop])
            if r is not None:
                push(heap, (r, before, stop))
    ids, i = [], 0
    while i < n:
        ids.append(rank[word[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes texts with a rank file: lines of a base64 token and its rank, which is its id."""

    def __init__(self, path: str, pattern: str = PRE_TOKEN):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(token): int(number) for token, number in (line.split() for line in file if line.strip())}
        self.whole = PerfectHash(self.rank)
        self.cut = regex.compile(pattern).findall
        self.memo: dict[str, np.ndarray] = {}

    def word(self, text: str) -> np.ndarray:
        """Ids of one pre-token."""
        raw = text.encode("utf-8", "replace")
        known = self.whole.get(raw)
        ids = np.array([known] if known is not None else merged(raw, self.rank), np.int32)
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        self.memo[text] = ids
        return ids

    def text(self, text: str | None) -> np.ndarray:
        """Ids of a text; none for an empty or null one."""
        if not text:
            return np.zeros(0, np.int32)
        memo, word = self.memo, self.word
        parts = []
        for token in self.cut(text):
            ids = memo.get(token)
            parts.append(word(token) if ids is None else ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path)


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).text
    for batch in batches:
        lists = [encode(text) for text in batch.column(1).to_pylist()]
        offsets = np.zeros(len(lists) + 1, np.int32)
        np.cumsum([len(ids) for ids in lists], out=offsets[1:])
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=["key", "ids"])


def encoded(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key, ids``: the token ids of every row's whole text, without special tokens.

    A null or empty text has the empty list; the names of special tokens are
    ordinary text. One row out for each row in, repeats and null keys
    included; other columns are ignored. ``path`` is a rank file that every
    worker can read. No shuffle: the vocabulary is a file of fixed size.
    """
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    return rows.mapInArrow(lambda batches: encoded_batches(batches, path), f"key {kind}, ids array<int>").withColumnRenamed("key", key)
