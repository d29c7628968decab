"""Repeated windows of byte strings, from interval expansion on a Burrows-Wheeler transform.

The strings are concatenated, each closed by a separator of its own. Breadth-first backward extension starts with
the interval of every symbol; extending an l-symbol interval by the symbols that precede it gives the intervals
of (l+1)-symbol strings. An interval whose right border has no common-prefix length yet gets the current level
there and is kept for the next level; others are dropped, so every border is set once and lengths come out in
increasing order. At a threshold the borders still open join suffixes that share at least that many symbols, so
several thresholds are answered on the way; the expansion stops at the greatest. Extensions walk over runs of the
transform, not over its positions.
"""

from __future__ import annotations

import numpy as np

#: Symbols packed into the first sorting key, 9 bits each.
PACKED = 4
#: Symbols of which places fit a sorting word, 2^21; longer sequences are sorted by index.
WORD = 1 << 21


def _sorted(high: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``at`` (below n) sorted by (high, at), and ``high`` in that order."""
    if n <= WORD:  # both fit one word (high is below 2^42), which sorts several times as fast as an index
        word = (high << 21) | at
        word.sort()
        return word & ((1 << 21) - 1), word >> 21
    order = np.lexsort((at, high))
    return at[order], high[order]


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix array, by prefix doubling over unresolved suffixes.

    ``symbols`` are 1 to 256, and 0 for separators, which are unique and ascend; ``left`` counts the symbols from
    each place to the next separator.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(PACKED, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(PACKED):
        key <<= 9
        key |= np.where(left >= j, padded[j : j + n], 0)
    order, key = _sorted(key, np.arange(n), n)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    rank, group = np.empty(n, np.int32), np.repeat(starts, sizes)
    # Equal keys with a separator have it at the same distance, so their places, in order already, decide.
    closed = left[order] < PACKED
    rank[order] = np.where(closed, np.arange(n), group)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes) & ~closed)
    at, group = order[slots], group[slots]
    width = 1 << 21 if n <= WORD else n
    h = PACKED
    while len(slots):
        at, high = _sorted(group * width + rank[at + h], at, n)
        new = np.empty(len(at) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(high[1:], high[:-1], out=new[1:-1])
        starts = np.flatnonzero(new)
        group = np.repeat(slots[starts[:-1]], np.diff(starts))
        rank[at] = group
        more = np.flatnonzero(~(new[1:] & new[:-1]))
        at, group, slots = at[more], group[more], slots[more]
        h *= 2
    order[rank] = np.arange(n)
    return order


def repeated(pieces: list[bytes], threshold: int) -> list[np.ndarray]:
    """For each piece a mask of the starts whose ``threshold``-byte string also starts elsewhere in the pieces."""
    return repeated_at(pieces, [threshold])[0]


def repeated_at(pieces: list[bytes], thresholds: list[int], own: list[int] | None = None) -> list[list[np.ndarray]]:
    """For each threshold (ascending) and each piece, a mask of the starts whose string of that many bytes also starts
    elsewhere in the pieces; only the first ``own[k]`` starts of piece k count, here as elsewhere."""
    count = len(pieces)
    lengths = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    n = int(ends[-1]) + 1 if count else 0
    if not n:
        return [[] for _ in thresholds]
    symbols = np.zeros(n, np.int64)
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    symbols[~is_end] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    left = np.repeat(ends, lengths + 1) - np.arange(n)
    order = suffix_order(symbols, left)
    counts = np.ones(n, bool) if own is None else (np.repeat(lengths, lengths + 1) - left < np.repeat(np.array(own, np.int64), lengths + 1)) & ~is_end
    counts = counts[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = order - 1  # of the first suffix: the last separator, which never extends
    letters = symbols[before].astype(np.int16)
    back = rank[before]
    del rank, left, is_end
    # Two separators in a row don't make a run that extends, so they may count as one.
    new_run = np.concatenate([[True], letters[1:] != letters[:-1]])
    run_of = np.cumsum(new_run, dtype=np.int32) - np.int32(1)
    run_start = np.flatnonzero(new_run)
    run_end = np.concatenate([run_start[1:], [n]])
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    first = symbols[order]
    # Every separator is a symbol of its own.
    lo = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (first[1:] == 0)]))
    hi = np.concatenate([lo[1:], [n]])
    unset[hi] = False
    starts, out, level = ends - lengths, [], 1
    for threshold in thresholds:
        while level < threshold and len(lo):
            lo, hi = _extended(lo, hi, letters, back, run_of, run_start, run_end)
            fresh = unset[hi]
            lo, hi = lo[fresh], hi[fresh]
            unset[hi] = False
            level += 1
        level = max(level, threshold)
        mask = np.zeros(n, bool)
        classes = np.cumsum(~unset[:n]) - 1
        members = np.bincount(classes[counts], minlength=int(classes[-1]) + 1)
        mask[order[counts & (members[classes] > 1)]] = True
        out.append([mask[s:e] for s, e in zip(starts.tolist(), ends.tolist())])
    return out


def _extended(lo, hi, letters, back, run_of, run_start, run_end) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of the strings one symbol longer, by the symbols before them; separators extend nothing."""
    a, b = run_of[lo], run_of[hi - 1]
    single = a == b
    s_lo, s_hi = lo[single], hi[single]
    keep = letters[s_lo] > 0
    next_lo, next_hi = back[s_lo[keep]], back[s_hi[keep] - 1] + 1
    if not single.all():
        m_lo, m_hi, a, b = lo[~single], hi[~single], a[~single], b[~single]
        runs = b - a + 1
        owner = np.repeat(np.arange(len(runs)), runs)
        run = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + a[owner]
        start, stop = np.maximum(run_start[run], m_lo[owner]), np.minimum(run_end[run], m_hi[owner])
        letter = letters[start]
        ok = letter > 0
        owner, start, stop, letter = owner[ok], start[ok], stop[ok], letter[ok]
        if len(owner):
            group = owner * 257 + letter
            sub = np.argsort(group, kind="stable")
            group, start, stop = group[sub], start[sub], stop[sub]
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            tail = np.concatenate([head[1:], [len(group)]]) - 1
            next_lo = np.concatenate([next_lo, back[start[head]]])
            next_hi = np.concatenate([next_hi, back[stop[tail] - 1] + 1])
    return next_lo, next_hi
