"""Exact Levenshtein distances of many pairs at once: 64 cells of a column are a word, and each word of all pairs of a
group is one array (Myers' bit vectors, blocks by Hyyrö). Long or lone pairs take whole columns as integers of Python."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Words of a column, pairs, characters and cells of the tables of a group at most; a group of fewer than FEW pairs is not one.
WORDS, PAIRS, CHARS, CELLS, FEW = 16, 4096, 2_000_000, 4_000_000, 32
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """The pair without its common beginning and end, the shorter one first."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return "", a[most:] or b[most:]
    lo, hi = 0, most  # a[:lo] is common, a[:hi] isn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b)) + 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        same = a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo]
        lo, hi = (mid, hi) if same else (lo, mid)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    return (a, b) if len(a) <= len(b) else (b, a)


def _alone(a: str, b: str) -> int:
    at: dict[str, int] = {}
    bit = 1
    for c in a:
        at[c] = at.get(c, 0) | bit
        bit <<= 1
    full = bit - 1
    pv, mv = full, 0
    for c in b:
        eq = at.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph = ((mv | (full & ~(xh | pv))) << 1 | 1) & full
        mh = ((pv & xh) << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return len(b) + pv.bit_count() - mv.bit_count()


def _codes(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _together(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """Distances of pairs (none empty) in order of the second's length, longest first."""
    m, n = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    a, b = (_codes([p[i] for p in pairs]) for i in (0, 1))
    known, a = np.unique(a, return_inverse=True)
    words, rows = -(-int(m.max()) // 64), np.arange(len(pairs))
    if len(pairs) >= 2 * FEW and len(pairs) * max(len(known), int(n[0]), words * min(len(known), int(m.max()))) > CELLS:
        half = len(pairs) // 2
        return np.r_[_together(pairs[:half]), _together(pairs[half:])]
    place = np.full(int(max(known[-1], b.max())) + 1, -1, np.int32)
    place[known] = np.arange(len(known))
    b = place[b]
    # each pair numbers the characters of its first text; 0: any other
    of_a, of_b = np.repeat(rows, m), np.repeat(rows, n)
    own = np.zeros((len(pairs), len(known) + 1), np.int32)
    own[of_a, a] = 1
    own[:, :-1] = np.where(own[:, :-1] > 0, np.cumsum(own[:, :-1], 1), 0)
    at = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
    size = int(own.max()) + 1
    cell = (at // 64 * len(pairs) + of_a) * size + own[of_a, a]
    order = np.argsort(cell, kind="stable")
    firsts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    eqs = np.zeros(words * len(pairs) * size, np.uint64)
    eqs[cell[order][firsts]] = np.bitwise_or.reduceat(np.uint64(1) << (at[order] % 64).astype(np.uint64), firsts)
    eqs = eqs.reshape(words, -1)
    steps = np.zeros((int(n[0]), len(pairs)), np.int32)
    steps[np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n), of_b] = own[of_b, b]
    steps += (rows * size).astype(np.int32)
    pv, mv = np.full((words, len(pairs)), _ALL), np.zeros((words, len(pairs)), np.uint64)
    left = np.searchsorted(-n, -np.arange(int(n[0])), "left")  # pairs whose second text is longer than that
    one, top = np.uint64(1), np.uint64(63)
    for step, k in zip(steps, left.tolist(), strict=True):
        plus, minus = np.ones(k, np.uint64), np.zeros(k, np.uint64)
        for w in range(words):
            eq, p, v = eqs[w].take(step[:k]), pv[w, :k], mv[w, :k]
            xv = eq | v
            eq |= minus
            xh = eq & p
            xh += p
            xh ^= p
            xh |= eq
            ph = xh | p
            np.invert(ph, ph)
            ph |= v
            xh &= p
            up, down = ph >> top, xh >> top
            ph <<= one
            ph |= plus
            xh <<= one
            xh |= minus
            np.bitwise_and(ph, xv, out=v)
            xv |= ph
            np.invert(xv, xv)
            np.bitwise_or(xh, xv, out=p)
            plus, minus = up, down
    bits = np.clip(m - 64 * np.arange(words)[:, None], 0, 64)
    mask = np.where(bits > 0, _ALL >> (64 - np.maximum(bits, 1)).astype(np.uint64), np.uint64(0))
    return n + np.bitwise_count(pv & mask).sum(0, dtype=np.int64) - np.bitwise_count(mv & mask).sum(0, dtype=np.int64)


def levenshtein(pairs: Sequence[tuple[str, str]]) -> list[int]:
    """Distances by code points."""
    number: dict[tuple[str, str], int] = {}
    asked = [number.setdefault(_trimmed(a, b) if a != b else ("", ""), len(number)) for a, b in pairs]
    out, groups = [0] * len(number), {}
    for i, (a, b) in enumerate(number):
        if not a:
            out[i] = len(b)
        else:
            words = -(-len(a) // 64)
            groups.setdefault((words, len(b).bit_length()) if words <= WORDS else None, []).append((len(b), i))
    kept = list(number)
    for kind, some in groups.items():
        some.sort(reverse=True)
        at = 0
        while at < len(some):
            size = max(1, min(PAIRS, CHARS // some[at][0]))
            ids = [i for _, i in some[at : at + size]]
            at += size
            if kind is None or len(ids) < FEW:
                for i in ids:
                    out[i] = _alone(*kept[i])
            else:
                for i, d in zip(ids, _together([kept[i] for i in ids]).tolist(), strict=True):
                    out[i] = d
    return [out[i] for i in asked]
