"""Suffix arrays by induced sorting, and permuted common prefixes, over one shard's bytes; whole arrays at a time.

Suffixes are classified: S if smaller than the one after, else L. An S-suffix after an L-suffix is leftmost-smaller. Their
substrings (each up to the next such place) are sorted by inducing, named, and the string of names is sorted by recursion, until
it is short enough to be sorted by doubling.
From the sorted leftmost-smaller suffixes the L- and then the S-suffixes are induced in one scan each. A scan takes as many
places at a time as are filled already: what a place induces comes after it, so the filled front is final.
"""

from __future__ import annotations

import numpy as np

#: A string of names of up to so many is sorted by doubling; longer ones by recursion.
SHORT = 1 << 19
SEPARATOR = 1  # symbols: 0 ends the whole, 1 ends a passage, a byte is its value plus 2


def _induce(at: np.ndarray, code: np.ndarray, head: np.ndarray) -> None:
    """Fill ``at``, -1 where open, from the left: each place's predecessor goes to the next open place of its bucket.

    code: of each suffix its predecessor's bucket, -1 if that is of the other type or there is none; head: of each bucket
    the first open place.
    """
    p, n, most = 0, len(at), 256
    narrow = len(head) <= 1 << 15
    while p < n:
        items = at[p : p + most]
        open_ = items < 0
        q = int(open_.argmax())
        if open_[q]:
            items = items[:q]
            most = max(256, 2 * q)
        else:
            most = min(2 * most, 1 << 18)
        p += len(items)
        c = code[items]
        good = c >= 0
        c, items = c[good], items[good] - 1
        if not len(c):
            continue
        order = (c.astype(np.int16) if narrow else c).argsort(kind="stable")
        c = c[order]
        changes = np.empty(len(c) + 1, bool)
        changes[0] = changes[-1] = True
        np.not_equal(c[1:], c[:-1], out=changes[1:-1])
        first = changes.nonzero()[0]
        count, first = first[1:] - first[:-1], first[:-1]
        bucket = c[first]
        free = head[bucket]
        at[np.arange(len(c)) + (free - first).repeat(count)] = items[order]
        head[bucket] = free + count


def _spread(shift: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places 0, 1, ... of items of buckets, moved by their bucket's shift."""
    return np.repeat(shift.astype(np.int32), count) + np.arange(int(count.sum()), dtype=np.int32)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of ``t``, integers below ``sigma`` that end with their only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    t = t.astype(np.int32)
    # S or L: as the next place where neighbours differ says
    step = np.append(np.diff(t), np.int32(-1))
    differs = np.flatnonzero(step)
    small = np.repeat(step[differs] > 0, np.diff(np.concatenate([[-1], differs])))
    small[-1] = True
    del step, differs
    left = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if n == 2:
        return np.array([1, 0], np.int32)
    all_, larges = np.bincount(t, minlength=sigma), np.bincount(t[~small], minlength=sigma)
    lefts = np.bincount(t[left], minlength=sigma)
    before = np.concatenate([[-1], t[:-1]]).astype(np.int32)
    code_l = np.where(np.concatenate([[False], ~small[:-1]]), before, -1)
    code_s = np.where(np.concatenate([[False], small[:-1]]), sigma - 1 - before, -1)

    def induced(seeds: np.ndarray) -> np.ndarray:
        """All suffixes, from leftmost-smaller ones that are in order within each bucket of their first symbol."""
        each = larges + lefts
        start = np.cumsum(each) - each
        front = np.full(len(seeds) + int(larges.sum()), -1, np.int32)
        front[_spread(start + larges - (np.cumsum(lefts) - lefts), lefts)] = seeds
        _induce(front, code_l, start.copy())
        is_large = np.repeat(np.tile([True, False], sigma), np.stack([larges, lefts], axis=1).ravel())
        # mirrored: buckets from the last, each with its open S-places before its L-suffixes
        back = np.full(n, -1, np.int32)
        end = np.cumsum(all_)
        mirrored = (n - end)[::-1].copy()
        back[n - 1 - _spread(end - all_ - (np.cumsum(larges) - larges), larges)] = front[is_large]
        back[n - 1] = n - 1
        _induce(back, code_s, mirrored)
        return back[::-1]

    order = induced(left[np.argsort(t[left], kind="stable")])
    is_left = np.zeros(n, bool)
    is_left[left] = True
    order = order[is_left[order]]
    length = np.zeros(n, np.int32)
    length[left] = np.append(np.diff(left), 0) + 1
    new = np.ones(len(order), bool)
    same = np.flatnonzero(length[order[1:]] == length[order[:-1]])
    a, b, i = order[1:][same], order[:-1][same], 0
    while len(same):
        equal = t[a + i] == t[b + i]
        i += 1
        over = equal & (length[a] == i)
        new[same[over] + 1] = False
        equal &= ~over
        same, a, b = same[equal], a[equal], b[equal]
    name = np.zeros(n, np.int32)
    name[order] = np.cumsum(new) - 1
    names = int(new.sum())
    if names < len(left):
        order = left[(_doubled if len(left) <= SHORT else suffix_array)(name[left], names)]
    return induced(order)


def _doubled(t: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of a short string by doubling: where the recursion ends. Ranks are places; only what is not told apart yet
    is sorted again, by what is as far on as is told."""
    n, h = len(t), 1
    key = np.append(t.astype(np.int64) + 1, np.zeros(8, np.int64))
    wide = sigma + 2
    while h < 8 and wide**2 < 1 << 62:
        key[: n + 8 - h] = key[: n + 8 - h] * wide + key[h:]
        wide, h = wide**2, 2 * h
    order = key[:n].argsort()
    key = key[order]
    rank, at = np.empty(n + 1, np.int64), np.arange(n)
    rank[n] = -1
    items = order
    while True:
        new = np.empty(len(items) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        first = new.nonzero()[0]
        size = first[1:] - first[:-1]
        rank[items] = at[first[:-1]].repeat(size)
        more = (size > 1).repeat(size)
        at, items = at[more], items[more]
        if not len(items):
            return order.astype(np.int32)
        key = rank[items] * (n + 1) + rank[np.minimum(items + h, n)] + 1
        sort = key.argsort()
        key, items = key[sort], items[sort]
        order[at] = items
        h *= 2


def permuted_prefixes(t: np.ndarray, order: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Of each place in the text, how many symbols its suffix shares with the one before it in ``order``, ``until`` that many
    at most (symbols to the end of its passage). Only where the symbols before differ, or a passage begins, is anything
    compared; elsewhere it is one less than at the place before.
    """
    n = len(t)
    prior = np.empty(n, np.int32)
    prior[order[1:]] = order[:-1]
    prior[order[0]] = -1
    place = np.arange(n, dtype=np.int32)
    fresh = np.ones(n, bool)
    fresh[1:] = (prior[1:] <= 0) | (t[:-1] != t[np.maximum(prior[1:], 1) - 1]) | (until[:-1] == 0)
    at = place[fresh]
    shared = np.zeros(len(at), np.int32)
    word = np.zeros(n + 8, np.uint64)
    padded = np.concatenate([t.astype(np.uint16), np.zeros(15, np.uint16)])
    for j in range(7):  # seven symbols of nine bits
        word |= padded[j : j + n + 8].astype(np.uint64) << np.uint64(9 * j)
    live = np.flatnonzero(prior[at] >= 0)
    while len(live):
        a = at[live] + shared[live]
        b = prior[at[live]] + shared[live]
        apart = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        low = (apart & (~apart + np.uint64(1))).astype(np.float64)
        gain = np.where(apart == 0, 7, np.frexp(low)[1].astype(np.int64) - 1)
        gain = np.where(apart == 0, 7, gain // 9)
        shared[live] += gain.astype(np.int32)
        live = live[(apart == 0) & (shared[live] < until[at[live]])]
    run = np.diff(np.append(at, n))
    full = np.repeat(shared + at, run) - place
    return np.minimum(np.maximum(full, 0), until)
