"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next one. Leftmost S suffixes start substrings that
induced sorting puts in order; their names form a shorter string, whose suffixes are sorted by doubling; from the sorted
leftmost ones the whole array is induced in one pass to the right and one to the left. Bytes have few buckets, so their
passes move whole stretches of a bucket at a time in numpy; the many names have too few suffixes each for that.
"""

from __future__ import annotations

import numpy as np


def smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last position must hold the only 0."""
    step = np.sign(np.diff(text.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(len(text), bool)
    out[:-1] = step[np.minimum(nearest, len(step) - 1)] > 0
    return out


def leftmost(small: np.ndarray) -> np.ndarray:
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _spread(spots: np.ndarray, chars: np.ndarray, waiting: list[list[np.ndarray]]) -> None:
    """Append spots to their characters' buckets, in order."""
    if not len(spots):
        return
    order = np.argsort(chars, kind="stable")
    spots, chars = spots[order], chars[order]
    cuts = np.flatnonzero(np.diff(chars)) + 1
    for part, c in zip(np.split(spots, cuts), chars[np.r_[0, cuts]].tolist()):
        waiting[c].append(part)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int64)


def induced(text: np.ndarray, small: np.ndarray, first: np.ndarray, buckets: int) -> np.ndarray:
    """The suffix array that the leftmost S suffixes ``first``, in their order, induce."""
    starts: list[list[np.ndarray]] = [[] for _ in range(buckets)]
    _spread(first, text[first], starts)
    waiting: list[list[np.ndarray]] = [[] for _ in range(buckets)]
    large: list[np.ndarray] = []
    for c in range(buckets):
        front, done = _joined(waiting[c]), []
        while len(front):
            done.append(front)
            back = front[front > 0] - 1
            back = back[~small[back]]
            chars = text[back]
            same = chars == c
            _spread(back[~same], chars[~same], waiting)
            front = back[same]
        large.append(_joined(done))
        if starts[c]:
            back = _joined(starts[c])
            back = back[back > 0] - 1
            back = back[~small[back]]
            _spread(back, text[back], waiting)
    waiting = [[] for _ in range(buckets)]
    out: list[np.ndarray] = []
    for c in range(buckets - 1, -1, -1):
        front, done = _joined(waiting[c]), []
        while len(front):
            done.append(front)
            back = front[front > 0] - 1
            back = back[small[back]]
            chars = text[back]
            same = chars == c
            _spread(back[~same], chars[~same], waiting)
            front = back[same]
        own = _joined(done)
        if c == 0:
            own = np.array([len(text) - 1], np.int64)  # the end
        back = large[c][::-1] if c else own
        back = back[back > 0] - 1
        back = back[small[back]]
        _spread(back, text[back], waiting)
        out.append(own[::-1])
        out.append(large[c])
    return np.concatenate(out[::-1])


def _words(text: np.ndarray) -> np.ndarray:
    """The four symbols from each position on, as one number (symbols below 2 ** 16)."""
    padded = np.r_[text, np.zeros(3, text.dtype)].astype(np.uint64)
    n = len(text)
    return padded[:n] << np.uint64(48) | padded[1:n + 1] << np.uint64(32) | padded[2:n + 2] << np.uint64(16) | padded[3:n + 3]


def _named(text: np.ndarray, order: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost substrings in text order, given them sorted; how many names."""
    ends = np.r_[spots[1:], len(text) - 1]
    length = np.zeros(len(text), np.int64)
    length[spots] = ends - spots + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    words, open_, at = _words(text), np.flatnonzero(same), 0
    while len(open_):  # four symbols at a time, while they are equal
        left = length[a[open_]] - at
        mask = np.where(left >= 4, np.uint64(0xFFFFFFFFFFFFFFFF), ~np.uint64(0) << (np.uint64(16) * np.maximum(4 - left, 0).astype(np.uint64)))
        differ = ((words[a[open_] + at] ^ words[b[open_] + at]) & mask) != 0
        same[open_[differ]] = False
        open_ = open_[~differ & (left > 4)]
        at += 4
    names = np.empty(len(text), np.int64)
    names[order] = np.r_[0, np.cumsum(~same)]
    return names[spots], int((~same).sum()) + 1


def suffix_array(text: np.ndarray, buckets: int) -> np.ndarray:
    """Sorted suffix starts of ``text``: symbols below ``buckets`` (at most 2 ** 16), the last one the only 0."""
    text = np.asarray(text).astype(np.uint16)  # 16 bits are sorted by radix
    if len(text) == 1:
        return np.zeros(1, np.int64)
    small = smaller(text)
    spots = leftmost(small)
    chosen = np.zeros(len(text), bool)
    chosen[spots] = True
    rough = induced(text, small, spots, buckets)
    order = rough[chosen[rough]]
    names, count = _named(text, order, spots)
    if count < len(spots):
        order = spots[_by_names(names, count)]
    return induced(text, small, order, buckets)


def _by_names(text: np.ndarray, count: int) -> np.ndarray:
    """Suffix order of a string of names below ``count`` that ends in its only 0, by doubling the names compared.

    Suffixes that share their first names are a group. Only groups of several are sorted again, by the ranks of the
    suffixes that follow those names, so a round costs a sort of what is still open, and there are as many rounds as the
    longest common prefix has binary digits.
    """
    n = len(text)
    bits = max(1, (count - 1).bit_length())
    per = 63 // bits  # names in the first number
    padded = np.r_[text, np.zeros(per - 1, np.int64)]
    key = padded[:n].copy()
    for k in range(1, per):
        key = key << bits | padded[k:n + k]
    order, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    places, spots = np.arange(n), np.arange(n)
    step = per
    while True:  # no open suffix has the end among its first names, so there is one ``step`` further on
        by = np.argsort(key)
        key, spots = key[by], spots[by]
        order[places] = spots
        edge = np.r_[True, key[1:] != key[:-1], True]
        rank[spots] = places[np.maximum.accumulate(np.where(edge[:-1], np.arange(len(places)), 0))]
        several = ~(edge[:-1] & edge[1:])
        places, spots = places[several], spots[several]
        if not len(places):
            return order
        key = rank[spots] * n + rank[spots + step]
        step *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position in text order, how many symbols (``most`` at most) its suffix shares with the one before it in the array."""
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    bits = max(1, int(text.max()).bit_length())
    per = 64 // bits  # symbols compared at a time
    padded = np.concatenate([text, np.zeros(most + per, np.int64)]).astype(np.uint64)
    words = np.zeros(len(text) + most, np.uint64)
    for k in range(per):
        words = words << np.uint64(bits) | padded[k:k + len(words)]
    out = np.zeros(len(text), np.int64)
    open_ = np.flatnonzero(before >= 0)
    other = before[open_]
    at = 0
    while at < most and len(open_):
        same = words[open_ + at] == words[other + at]
        stuck, beside = open_[~same], other[~same]
        for k in range(per - 1):  # the last few symbols one by one
            equal = padded[stuck + at + k] == padded[beside + at + k]
            stuck, beside = stuck[equal], beside[equal]
            out[stuck] += 1
        open_, other = open_[same], other[same]
        out[open_] += per
        at += per
    return np.minimum(out, most)
