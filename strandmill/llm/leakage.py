"""Passages of held-out items inside a corpus, found by q-gram lemma filtering.

A passage of n characters that occurs with at most e edits shares at least
``n + 1 - q * (e + 1)`` character q-grams with its occurrence, all of them on
diagonals (text position minus item position) that lie within e of each other.
Per document the q-grams of all items are looked up; hits are counted in
overlapping diagonal bands; regions that reach the bound are verified by banded
alignment. Texts are compared as their letters and digits alone, so one filter
serves passages of words and of scripts without spaces.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.workspace import Workspace

#: A passage: so many consecutive words, or so many letters of an item in Chinese or Japanese.
WORDS, LETTERS = 12, 24
#: Longest q-gram; shorter ones are taken where passages or the edit budget need them.
LONGEST_GRAM = 12
#: Characters of items that are indexed at once (about 20 bytes each in every worker); more items take further passes.
BLOCK_CHARACTERS = 2_000_000
#: Characters of documents that are hashed at once.
CHUNK_CHARACTERS = 400_000

_WORD = re.compile(r"[^\W_]+").findall
_FORMAT = regex.compile(r"\p{Cf}+")
_LETTER_SCRIPT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC and lower-casing, without format characters."""
    if not text:
        return []
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text).lower())
        return _WORD(text)
    return _WORD(text.lower())


def by_letters(lang: str | None, words: list[str]) -> bool:
    """Whether an item's passages are counted in letters: Chinese or Japanese by its language or, where that is null, by its script."""
    if lang is not None:
        return regex.split(r"[-_]", lang.strip().lower())[0] in ("zh", "ja")
    joined = "".join(words)
    return 2 * len(_LETTER_SCRIPT.findall(joined)) > len(joined)


@dataclass
class Item:
    """Letters of an item, where its words begin, and its passages as (start, length) in letters."""

    letters: str
    starts: set[int]
    passages: list[tuple[int, int]]
    whole_words: bool


def item_of(text: str | None, lang: str | None) -> Item:
    words = words_of(text)
    lengths = [len(w) for w in words]
    starts = [0, *np.cumsum(lengths).tolist()]
    if by_letters(lang, words):
        passages = [(i, LETTERS) for i in range(starts[-1] - LETTERS + 1)]
        return Item("".join(words), set(starts), passages, False)
    passages = [(starts[i], starts[i + WORDS] - starts[i]) for i in range(len(words) - WORDS + 1)]
    return Item("".join(words), set(starts), passages, True)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram that begins at each position; built from powers of two, so in about log q passes."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = codes.astype(np.uint64) + np.uint64(1)
    total, done, width, left = None, 0, 1, q
    while left:
        if left & 1:
            part = power[done : done + n]
            total = part.copy() if total is None else total * np.uint64(pow(_BASE, width, 2**64)) + part
            done += width
        left >>= 1
        if left:
            power = power[:-width] * np.uint64(pow(_BASE, width, 2**64)) + power[width:]
            width *= 2
    return total ^ (total >> np.uint64(29))


def longest_gram(item: Item, edits: int) -> int:
    """The q-gram length that suits an item: an occurrence with all the edits still shares a third of its shortest passage's grams."""
    return int(max(1, min(LONGEST_GRAM, 2 * min(n for _, n in item.passages) // (3 * (edits + 1)))))


class GramIndex:
    """The q-grams of items with one q-gram length, sorted by hash, with the bounds of each item."""

    def __init__(self, found: list[tuple[int, Item]], q: int, edits: int):
        self.edits, self.q = edits, q
        self.keys, self.items = [k for k, _ in found], [i for _, i in found]
        shortest = np.array([min(n for _, n in i.passages) for i in self.items], np.int64)
        longest = np.array([max(n for _, n in i.passages) for i in self.items], np.int64)
        self.needed = np.maximum(shortest + 1 - self.q * (edits + 1), 1)
        self.span = longest - self.q + 2 * edits
        hashes = [gram_hashes(code_points(i.letters), self.q) for i in self.items]
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes] or [np.zeros(0, np.int64)])
        flat = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.hashes, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position, item and item position of every common q-gram."""
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.some[(hashes >> np.uint64(44)).astype(np.int64)])
        entry = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[entry] == hashes[at]
        at, entry = at[same], entry[same]
        count = self.count[entry]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        posting = np.repeat(self.first[entry], count) + nth
        return np.repeat(at, count), self.owner[posting], self.place[posting]

    def regions(self, codes: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """``text, item, low, high, first, last``: diagonal bands of a text and an item where the bound is reached, and from where to where."""
        at, item, place = self.hits(codes)
        if not len(at):
            return
        width = self.edits + 1
        band = (at - place) // width
        if self.edits:  # bands overlap: each hit lies in two; without edits a band is one diagonal
            at, item = np.concatenate((at, at)), np.concatenate((item, item))
            band = np.concatenate((band, band - 1))
        text = text_of[at]
        order = np.lexsort((at, band, item, text))
        at, item, text, band = at[order], item[order], text[order], band[order]
        ahead = np.arange(len(at)) + self.needed[item] - 1
        inside = np.minimum(ahead, len(at) - 1)
        full = (ahead < len(at)) & (text[inside] == text) & (item[inside] == item) & (band[inside] == band) & (at[inside] - at <= self.span[item])
        kept = np.flatnonzero(full)
        if not len(kept):
            return
        new = np.ones(len(kept), bool)
        new[1:] = (text[kept[1:]] != text[kept[:-1]]) | (item[kept[1:]] != item[kept[:-1]]) | (band[kept[1:]] != band[kept[:-1]])
        starts = np.flatnonzero(new)
        first = np.minimum.reduceat(at[kept], starts)
        last = np.maximum.reduceat(at[inside[kept]], starts) + self.q
        for k, a, z in zip(kept[starts].tolist(), first.tolist(), last.tolist()):
            low = int(band[k]) * width
            yield int(text[k]), int(item[k]), low, low + (2 * width - 1 if self.edits else 0), a, z


class ItemIndex:
    """A block of items; one index for each q-gram length, so that an item of short passages costs the others nothing."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]], edits: int = 0):
        found: dict[int, list[tuple[int, Item]]] = {}
        for key, text, lang in rows:
            item = item_of(text, lang)
            if item.passages:
                found.setdefault(longest_gram(item, edits), []).append((key, item))
        self.parts = [GramIndex(of, q, edits) for q, of in sorted(found.items())]
        self.keys = [key for part in self.parts for key in part.keys]


def banded_distance(pattern: str, text: str, spread: int, budget: int | None = None) -> int:
    """Least edits of ``pattern`` against any part of ``text`` that begins within its first ``len(text) - len(pattern) + spread`` places.

    Only cells within the band of possible diagonals are computed, a row at a
    time over all of them; more than ``budget`` edits (``spread`` by default) count as ``budget + 1``.
    """
    budget = spread if budget is None else budget
    n, m = len(pattern), len(text)
    width = m - n + 2 * spread  # diagonals -spread .. m - n + spread
    if width < 0:
        return budget + 1
    if pattern in text:
        return 0
    if budget < 1:
        return budget + 1
    far = budget + 1
    place = np.arange(width + 1) - spread
    slope = np.arange(width + 1)
    letters = np.full(n + 2 * width + 2 + spread, 0xFFFFFFFF, np.uint32)
    letters[spread : spread + m] = code_points(text)
    row = np.where((place >= 0) & (place <= m), 0, far)
    for i, letter in enumerate(code_points(pattern), 1):
        # the text's letter under a diagonal; letters outside of the text match nothing
        best = row + (letters[i - 1 : i + width] != letter)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best = np.where((place + i >= 0) & (place + i <= m), best, far)
        row = np.minimum(np.minimum.accumulate(best - slope) + slope, far)
        if row.min() >= far:
            return far
    return int(row.min())


def verified(item: Item, letters: str, starts: list[int], region: tuple[int, int, int, int], budget: int, q: int, spread: int) -> int | None:
    """Least edits, ``budget`` at most, of a passage of ``item`` that lies in the band and region, None if there is none.

    ``spread`` is the edits the filter allows. Without edits a passage of words
    must also fill whole words of the text.
    """
    low, high, first, last = region
    margin = (q + 2) * spread  # edits may spoil so much before the first and after the last common q-gram
    least = None
    places = [(start, length) for start, length in item.passages if start + length + high <= last + margin and start + low >= first - margin]
    if spread and places:
        # a passage without an edit settles it, whichever comes first
        around = letters[max(0, places[0][0] + low - spread) : max(start + length for start, length in places) + high + spread]
        if any(item.letters[start : start + length] in around for start, length in places):
            return 0
    for start, length in places:
        begin, end = start + low, start + length + high
        passage = item.letters[start : start + length]
        if not spread:
            if letters[begin:end] == passage and (not item.whole_words or same_words(item, start, length, starts, begin)):
                return 0
            continue
        edits = banded_distance(passage, letters[max(0, begin - spread) : end + spread], spread, budget)
        if edits <= budget:
            least, budget = edits, edits - 1
            if not edits:
                break
    return least


def same_words(item: Item, start: int, length: int, starts: list[int], at: int) -> bool:
    """Whether the words of the passage and those of the text begin and end at the same letters."""
    k = bisect_right(starts, at)
    if not k or starts[k - 1] != at:
        return False
    inner = {s - at + start for s in starts[k : bisect_right(starts, at + length)]}
    return inner == {s for s in item.starts if start < s <= start + length}


def leak_batches(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found: list[tuple] = []
        pending: list[tuple] = []
        size = 0
        for key, text in zip(keys, texts):
            words = words_of(text)
            if words:
                pending.append((key, words))
                size += sum(map(len, words)) + 1
            if size >= CHUNK_CHARACTERS:
                found += leaks_in(pending, index)
                pending, size = [], 0
        found += leaks_in(pending, index)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], batch.schema.field(0).type), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32())],
            names=["key", "item", "edits"],
        )


def leaks_in(texts: list[tuple], index: ItemIndex) -> Iterator[tuple]:
    """``key, item, edits`` of the items that the (key, words) texts hold, with the least edits of each."""
    if not texts or not index.keys:
        return
    letters = ["".join(words) for _, words in texts]
    joined = code_points("\0".join(letters))
    lengths = np.array([len(x) + 1 for x in letters])
    begin = np.cumsum(lengths) - lengths
    text_of = np.repeat(np.arange(len(texts)), lengths)[: len(joined)]
    boundaries: dict[int, list[int]] = {}
    for part in index.parts:
        least: dict[tuple[int, int], int] = {}
        for text, item, low, high, first, last in part.regions(joined, text_of):
            budget = least.get((text, item), part.edits + 1) - 1
            if budget < 0:
                continue
            if text not in boundaries:
                boundaries[text] = [0, *np.cumsum([len(w) for w in texts[text][1]]).tolist()]
            at = int(begin[text])
            edits = verified(part.items[item], letters[text], boundaries[text], (low - at, high - at, first - at, last - at), budget, part.q, part.edits)
            if edits is not None:
                least[text, item] = edits
        for (text, item), edits in least.items():
            yield texts[text][0], part.keys[item], edits


def leaked_items(documents: DataFrame, document: str, text: str, items: DataFrame, item: str, item_text: str, lang: str, edits: int = 0, block: int = BLOCK_CHARACTERS) -> DataFrame:
    """``document, item, edits``: every document and the items of which it holds a passage, with the least edits.

    With ``edits`` a passage may differ by so many letters, and word
    boundaries don't count. Items are indexed in blocks of about ``block``
    characters, one pass over the corpus each; the driver holds one block at a
    time, and the result of a pass is written before the next begins. Null and
    empty texts, and items shorter than a passage, give no row; each pair comes
    once however often it occurs or its rows are repeated.
    """
    work = Workspace(documents.sparkSession, "leaks")
    rows = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text"), F.col(lang).alias("lang")).where("item IS NOT NULL AND text IS NOT NULL")
    characters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + int(characters) // block
    corpus = documents.select(F.col(document).alias("key"), F.col(text).alias("text"))
    kind = documents.schema[document].dataType.simpleString()
    found = None
    for number in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).collect()
        index = ItemIndex([(r["item"], r["text"], r["lang"]) for r in part], edits)
        leaks = corpus.mapInArrow(lambda batches, index=index: leak_batches(batches, index), f"key {kind}, item long, edits int")
        if blocks > 1:
            leaks = work.keep(leaks, f"pass{number}")
        found = leaks if found is None else found.unionByName(leaks)
    return found.groupBy("key", "item").agg(F.min("edits").alias("edits"))
