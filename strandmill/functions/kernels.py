"""Numeric kernels over one sequence or one pair, called on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_CODE = np.full(256, 4, np.uint8)
for _letters, _value in ((b"Aa", 0), (b"Cc", 1), (b"Gg", 2), (b"TtUu", 3)):
    for _letter in _letters:
        _CODE[_letter] = _value

#: Alignment scores.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 2, -4, -4, -2
#: Fields of a packed cell: score, matches, columns.
_FIELD = 20
#: Field of the matches where columns travel by themselves.
_WIDE_FIELD = 28
_NOTHING = -(1 << 61)
#: Diagonals to either side that are tried first, and cells of a row over all pairs of a group.
_FIRST_BAND, _GROUP_CELLS = 16, 60_000


def codes(sequence: str) -> np.ndarray:
    """0 to 3 for A, C, G and T or U in either case, 4 for anything else."""
    return _CODE[np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)]


def token(code: np.ndarray, bits: int = 32, seed: int = 0) -> np.ndarray:
    """A one-to-one scrambling of codes of so many bits; another one for each seed."""
    low = np.uint64((1 << bits) - 1)
    code = code ^ (np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64) & low)
    code = code * np.uint64(0x9E3779B1 if bits == 32 else 0x9E3779B97F4A7C15) & low
    code ^= code >> np.uint64(15 if bits == 32 else 29)
    code = code * np.uint64(0x85EBCA77 if bits == 32 else 0xD6E8FEB86659FD93) & low
    return code ^ (code >> np.uint64(13 if bits == 32 else 31))


def canonical_tokens(code: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Token of the smaller of each k-mer and its reverse complement (k up to 31), for a run of known bases."""
    n = len(code) - k + 1
    base = code.astype(np.uint64)
    forward, reverse = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        forward = (forward << np.uint64(2)) | base[j : j + n]
        reverse = (reverse << np.uint64(2)) | (np.uint64(3) - base[k - 1 - j : k - 1 - j + n])
    return token(np.minimum(forward, reverse), 32 if k <= 16 else 62, seed)


def sliding_extreme(values: np.ndarray, width: int, extreme: np.ufunc, filler) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours, from prefix and suffix extremes of blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, filler, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    prefix = extreme.accumulate(table, axis=1).ravel()
    suffix = extreme.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return extreme(suffix[:n], prefix[width - 1 : width - 1 + n])


def minimizers(sequence: str, k: int, window: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and places of the k-mers that are smallest in some window of ``window`` k-mers.

    Windows lie within runs of known bases; every place that attains a window's
    minimum counts, so both strands yield the same k-mers.
    """
    code = codes(sequence)
    unknown = np.flatnonzero(code == 4)
    edges = np.concatenate(([-1], unknown, [len(code)]))
    tokens, places = [], []
    for begin, end in zip(edges[:-1] + 1, edges[1:]):
        if end - begin < k + window - 1:
            continue
        values = canonical_tokens(code[begin:end], k, seed)
        least = sliding_extreme(values, window, np.minimum, np.uint64(2**63))
        padded = np.concatenate((np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)))
        highest = sliding_extreme(padded, window, np.maximum, np.uint64(0))
        chosen = np.flatnonzero(highest == values)
        tokens.append(values[chosen])
        places.append(chosen + begin)
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(tokens), np.concatenate(places)


def banded_alignment(query: np.ndarray, target: np.ndarray, band: int) -> tuple[int, int, int]:
    """:func:`banded_alignments` of one pair."""
    return banded_alignments([(query, target)], band)[0]


def banded_alignments(pairs: Sequence[tuple[np.ndarray, np.ndarray]], band: int) -> list[tuple[int, int, int]]:
    """Score, matches and columns of the best end-to-end alignments with affine gaps within a band of diagonals.

    Of alignments with one score the one with more matches counts. ``band``
    under 0 means no band. Code 4 matches nothing. A narrow band is tried
    first: it is wide enough once its score is beyond what a path that leaves
    it could reach; otherwise the pair is aligned again in one four times as wide.
    """
    found: list = [None] * len(pairs)
    left = []
    for i, (query, target) in enumerate(pairs):
        n, m = len(query), len(target)
        if not n or not m:
            longest = max(n, m)
            found[i] = (GAP_OPEN + GAP_EXTEND * longest if longest else 0), 0, longest
        elif n == m and not (query == 4).any() and np.array_equal(query, target):
            found[i] = MATCH * n, n, n
        else:
            left.append(i)
    reach = _FIRST_BAND
    while left:
        groups: dict[int, list[int]] = {}
        whole = {}
        for i in left:
            n, m = len(pairs[i][0]), len(pairs[i][1])
            whole[i] = max(n, m) if band < 0 else band + abs(m - n)
            groups.setdefault(min(whole[i], reach + abs(m - n)), []).append(i)
        left = []
        for half, group in groups.items():
            for i, figures in zip(group, aligned_within([pairs[i] for i in group], half)):
                n, m = len(pairs[i][0]), len(pairs[i][1])
                gaps = 2 * (half + 1) - abs(m - n)
                beyond = (n + m - gaps) * MATCH // 2 + GAP_EXTEND * gaps + 2 * GAP_OPEN
                if half == whole[i] or figures[0] > beyond:
                    found[i] = figures
                else:
                    left.append(i)
        reach *= 4
    return found


def aligned_within(pairs: Sequence[tuple[np.ndarray, np.ndarray]], half: int) -> list[tuple[int, int, int]]:
    """The figures of pairs that are aligned within ``half`` diagonals to either side, several pairs at once."""
    found: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]))
    short = [i for i in order if len(pairs[i][0]) + len(pairs[i][1]) < 1 << _FIELD]
    size = max(1, _GROUP_CELLS // (2 * half + 1))
    for begin in range(0, len(short), size):
        group = short[begin : begin + size]
        for i, figures in zip(group, packed_alignments([pairs[i] for i in group], half)):
            found[i] = figures
    for i in order[len(short) :]:
        found[i] = wide_alignment(*pairs[i], half)
    return found


def packed_alignments(pairs: Sequence[tuple[np.ndarray, np.ndarray]], half: int) -> list[tuple[int, int, int]]:
    """Alignment of pairs whose queries ascend in length; all advance by one row at a time.

    Score, matches and columns travel in one integer a cell, so no traceback is
    kept; rows are bands, so memory does not grow with the product of the lengths.
    """
    n, m = (np.array([len(pair[side]) for pair in pairs]) for side in (0, 1))
    width = 2 * half + 1
    unit = 1 << (2 * _FIELD)
    match = MATCH * unit + (1 << _FIELD) + 1
    mismatch, extend, opening = MISMATCH * unit + 1, GAP_EXTEND * unit + 1, GAP_OPEN * unit
    offsets = np.arange(width) - half  # target place minus query place
    climb = np.arange(width) * extend
    queries = np.full((int(n[-1]), len(pairs)), 4, np.uint8)
    padded = np.full((len(pairs), int(max(n.max(), m.max())) + 2 * half + 2), 5, np.uint8)
    for k, (query, target) in enumerate(pairs):
        queries[: len(query), k] = query
        padded[k, half : half + len(target)] = target
    best = np.where(offsets == 0, 0, np.where((offsets > 0) & (offsets <= m[:, None]), opening + offsets * extend, _NOTHING))
    down = np.full(best.shape, _NOTHING)
    cells = np.zeros(len(pairs), np.int64)
    first = 0
    for i in range(1, int(n[-1]) + 1):
        segment, letters, limit = padded[first:, i - 1 : i - 1 + width], queries[i - 1, first:, None], m[first:, None]
        column = offsets + i
        step = np.where((segment == letters) & (segment < 4), match, mismatch)
        diagonal = np.where((column >= 1) & (column <= limit), best + step, _NOTHING)
        above = np.full_like(best, _NOTHING)
        above[:, :-1] = np.maximum(down[:, 1:], best[:, 1:] + opening)
        inside = (column >= 0) & (column <= limit)
        down = np.where(inside, above + extend, _NOTHING)
        entry = np.maximum(diagonal, down)
        # a gap along the row: the best earlier entry, lowered by the opening and by each letter since
        right = np.full_like(best, _NOTHING)
        right[:, 1:] = np.maximum.accumulate(np.maximum(entry, _NOTHING // 2) - climb, axis=1)[:, :-1] + climb[1:] + opening
        best = np.where(inside, np.maximum(np.maximum(entry, right), _NOTHING), _NOTHING)
        ended = int(np.searchsorted(n, i, "right"))
        if ended > first:
            cells[first:ended] = best[np.arange(ended - first), half + (m - n)[first:ended]]
            best, down, first = best[ended - first :], down[ended - first :], ended
    field = (1 << _FIELD) - 1
    return [(c >> (2 * _FIELD), (c >> _FIELD) & field, c & field) for c in cells.tolist()]


def larger(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The larger of each two pairs."""
    first = (x[0] > y[0]) | ((x[0] == y[0]) & (x[1] >= y[1]))
    return np.where(first, x[0], y[0]), np.where(first, x[1], y[1])


def running_largest(x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The largest pair so far at each place."""
    top = np.maximum.accumulate(x[0])
    run = np.cumsum(np.append(0, top[1:] != top[:-1])) << 34
    return top, np.maximum.accumulate(run + np.where(x[0] == top, x[1], -(1 << 32))) - run


def wide_alignment(query: np.ndarray, target: np.ndarray, half: int) -> tuple[int, int, int]:
    """:func:`banded_alignment` with score and matches in one integer and columns in another, for long overlaps."""
    n, m = len(query), len(target)
    width = 2 * half + 1
    unit = 1 << _WIDE_FIELD
    opening = GAP_OPEN * unit
    offsets = np.arange(width) - half
    steps = np.arange(width)
    climb = steps * (GAP_EXTEND * unit)
    none, zero = np.full(width, _NOTHING), np.zeros(width, np.int64)
    best = (np.where(offsets == 0, 0, np.where((offsets > 0) & (offsets <= m), opening + offsets * (GAP_EXTEND * unit), _NOTHING)), np.where((offsets > 0) & (offsets <= m), offsets, 0))
    down = (none, zero)
    padded = np.full(max(n, m) + 2 * half + 2, 5, np.uint8)
    padded[half : half + m] = target
    for i in range(1, n + 1):
        segment = padded[i - 1 : i - 1 + width]
        column = offsets + i
        inside = (column >= 0) & (column <= m)
        step = np.where((segment == query[i - 1]) & (segment < 4), MATCH * unit + 1, MISMATCH * unit)
        met = inside & (column >= 1) & (best[0] > _NOTHING // 2)
        diagonal = np.where(met, best[0] + step, _NOTHING), np.where(met, best[1] + 1, 0)
        opened = np.append(best[0][1:] + opening, _NOTHING), np.append(best[1][1:], 0)
        down = larger((np.append(down[0][1:], _NOTHING), np.append(down[1][1:], 0)), opened)
        met = inside & (down[0] > _NOTHING // 2)
        down = np.where(met, down[0] + GAP_EXTEND * unit, _NOTHING), np.where(met, down[1] + 1, 0)
        entry = larger(diagonal, down)
        top, columns = running_largest((np.maximum(entry[0], _NOTHING // 2) - climb, entry[1] - steps))
        right = np.append(_NOTHING, top[:-1] + climb[1:] + opening), np.append(0, columns[:-1] + steps[1:])
        best = larger(entry, right)
        met = inside & (best[0] > _NOTHING // 2)
        best = np.where(met, best[0], _NOTHING), np.where(met, best[1], 0)
    at = half + m - n
    return int(best[0][at]) >> _WIDE_FIELD, int(best[0][at]) & (unit - 1), int(best[1][at])
