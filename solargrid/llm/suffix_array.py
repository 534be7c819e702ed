"""Suffix arrays by induced sorting at every level, without another sorter.

Buckets are filled in waves by numpy, which deal a wave to its buckets by counting (a radix sort of 16-bit symbols). Where
buckets are small, as those of the names of a recursion, or fill one by one, as in long runs of a symbol, suffixes are
placed one at a time. Both are linear and give the same array.
"""

from __future__ import annotations

import numpy as np

from solargrid.llm.shingles import powers

#: A wave costs about as much as so many suffixes placed one at a time.
WAVE = 400


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it. s ends with a unique least symbol."""
    n = len(s)
    d = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(d != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next place where symbols differ
    out = np.ones(n, dtype=bool)
    out[:-1] = d[np.minimum(nearest, n - 2)] > 0
    return out


def leftmost(smaller: np.ndarray) -> np.ndarray:
    """Places of leftmost-smaller suffixes."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def induce(s: np.ndarray, smaller: np.ndarray, order: np.ndarray, sigma: int) -> np.ndarray:
    """The array induced from leftmost-smaller suffixes in the given order."""
    out = induce_waves(s, smaller, order, sigma) if sigma * WAVE <= len(s) and sigma <= 1 << 16 else None
    return induce_each(s, smaller, order, sigma) if out is None else out


def induce_each(s: np.ndarray, smaller: np.ndarray, order: np.ndarray, sigma: int) -> np.ndarray:
    """One suffix at a time."""
    stops = np.cumsum(np.bincount(s, minlength=sigma))
    sa, tail = [-1] * len(s), stops.tolist()
    symbols = s[order].tolist()
    for i, c in zip(order[::-1].tolist(), symbols[::-1], strict=True):
        tail[c] -= 1
        sa[tail[c]] = i
    # Per suffix, the symbol before it if a larger (or smaller) suffix starts there; else, and for empty slots (-1), -1.
    bucket = np.full((2, len(s) + 1), -1, dtype=np.int32)
    bucket[smaller[:-1].astype(np.int8), np.arange(1, len(s))] = s[:-1]
    larger_before, smaller_before = bucket.tolist()
    head = [0, *stops[:-1].tolist()]
    for i in sa:  # what is placed lies further on
        c = larger_before[i]
        if c >= 0:
            k = head[c]
            sa[k] = i - 1
            head[c] = k + 1
    tail = stops.tolist()
    for i in reversed(sa):
        c = smaller_before[i]
        if c >= 0:
            k = tail[c] - 1
            sa[k] = i - 1
            tail[c] = k
    return np.array(sa, dtype=np.int32)


def induce_waves(s: np.ndarray, smaller: np.ndarray, order: np.ndarray, sigma: int) -> np.ndarray | None:
    """What a bucket holds so far is placed at once; None if that takes too many waves."""
    n, left = len(s), len(s) // WAVE + 2 * sigma
    s = s.astype(np.uint16)
    sizes = np.bincount(s, minlength=sigma)
    stop = np.cumsum(sizes)
    start = stop - sizes
    sa = np.full(n, -1, dtype=np.int32)
    by_symbol = order[np.argsort(s[order], kind="stable")]
    lms_sizes = np.bincount(s[order], minlength=sigma)
    lms_stop = np.cumsum(lms_sizes)
    lms_start = lms_stop - lms_sizes
    used = np.flatnonzero(sizes)
    head, tail = start.copy(), stop.copy()

    def place(before: np.ndarray, up: bool) -> None:
        symbols = s[before]
        by = np.argsort(symbols, kind="stable")
        symbols, before = symbols[by], before[by]
        cut = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        count = np.diff(np.append(cut, len(symbols)))
        kinds = symbols[cut]
        within = np.arange(len(symbols)) - np.repeat(cut, count)
        if up:
            sa[np.repeat(head[kinds], count) + within] = before
            head[kinds] += count
        else:
            sa[np.repeat(tail[kinds], count) - 1 - within] = before
            tail[kinds] -= count

    def wave(held: np.ndarray, up: bool) -> None:
        before = held[held > 0] - 1
        before = before[smaller[before] != up]
        if len(before):
            place(before, up)

    # Larger suffixes, symbols upwards: what a bucket holds places the suffixes before it at the heads of their buckets.
    for c in used:
        done = start[c]
        while done < head[c]:
            first, done, left = done, head[c], left - 1
            wave(sa[first:done], True)
            if left < 0:
                return None
        wave(by_symbol[lms_start[c] : lms_stop[c]], True)
    # Smaller suffixes, symbols downwards, from the tails.
    for c in used[::-1]:
        done = stop[c]
        while done > tail[c]:
            last, done, left = done, tail[c], left - 1
            wave(sa[done:last][::-1], False)
            if left < 0:
                return None
        wave(sa[start[c] : head[c]][::-1], False)
    sa[0] = n - 1  # the least symbol's suffix is induced by none
    return sa


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """s: symbols from 0 to sigma - 1, ending with the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int32)
    smaller = smaller_types(s)
    lms = leftmost(smaller).astype(np.int32)
    sa = induce(s, smaller, lms, sigma)
    # Name leftmost-smaller substrings in their order; equal ones share a name.
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    stop = np.append(lms[1:], n - 1)
    length = np.zeros(n, dtype=np.int64)
    length[lms] = stop - lms + 1
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((s.astype(np.uint64) + np.uint64(1)) * powers(n)[0][:n], out=c[1:])
    code = (c[ordered + length[ordered]] - c[ordered]) * powers(n)[1][ordered]
    differs = (code[1:] != code[:-1]) | (length[ordered[1:]] != length[ordered[:-1]])
    names = np.concatenate(([0], np.cumsum(differs)))
    if names[-1] + 1 < len(lms):
        name = np.empty(n, dtype=np.int32)
        name[ordered] = names
        ordered = lms[suffix_array(name[lms], int(names[-1]) + 1)]
    return induce(s, smaller, ordered, sigma)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """At each place, how many symbols its suffix shares with the one before it in the array, up to most.

    A place shares one symbol less than the place to its left, unless the symbols before the two suffixes differ. Only such
    irreducible places are compared (by hashes of stretches); the others follow from the last one to their left.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((s.astype(np.uint64) + np.uint64(1)) * powers(n)[0][:n], out=c[1:])
    inverse = powers(n + 1)[1]
    at = np.arange(n)
    follows = (at > 0) & (before > 0) & (s[at - 1] == s[before - 1])
    a = np.flatnonzero(~follows & (before >= 0))
    b = before[a]
    room = n - np.maximum(a, b)
    shared = np.zeros(len(a), dtype=np.int64)

    def longer(k: np.ndarray, step: int) -> np.ndarray:
        """Which of the places k share another `step` symbols, which are added to what they share."""
        fits = shared[k] + step <= room[k]
        i, j = a[k] + shared[k], b[k] + shared[k]
        i, j = np.where(fits, i, 0), np.where(fits, j, 0)
        same = fits & ((c[np.minimum(i + step, n)] - c[i]) * inverse[i] == (c[np.minimum(j + step, n)] - c[j]) * inverse[j])
        shared[k[same]] += step
        return same

    open_, step = np.arange(len(a)), 8
    while len(open_):  # twice as many in each round, then halves for those that differ
        same = longer(open_, step)
        half, rest = step // 2, open_[~same]
        while half and len(rest):
            longer(rest, half)
            half //= 2
        open_, step = open_[same], step * 2
    known = np.zeros(n, dtype=np.int64)
    known[a] = shared
    last = np.maximum.accumulate(np.where(follows, 0, at))
    return np.minimum(known[last] - (at - last), most)


def repeated(s: np.ndarray, sigma: int, least: int) -> np.ndarray:
    """True at places whose next `least` symbols also start at another place."""
    sa = suffix_array(s, sigma)
    long = permuted_common_prefixes(s, sa, least) >= least
    up = long[sa]  # shares enough with the one before it
    out = np.zeros(len(s), dtype=bool)
    out[sa] = up | np.append(up[1:], False)
    return out
