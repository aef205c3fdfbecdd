"""Batch kernels of the measures Spark has no expression for.

Edit-distance tables are filled for all pairs of a batch together: a table row is one
array over (pairs, positions), insertions along a row are running minima or maxima.
Strings are given as views with one character per compared unit (byte or code point).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np


def _codes(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts])
    out = np.full((len(texts), max(1, int(n.max(initial=0)))), fill, np.int32)
    for i, t in enumerate(texts):
        if t:
            out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, n


def _batched(kernel, width: int = 1, cells=lambda n: n + 1, most: int = 400_000):
    """Runs a kernel on pairs of like length together, so padding stays small and memory bounded.

    ``cells(n)`` of a pair of length n are held at once, ``most`` by a batch of several pairs.
    """

    def run(a: list[str], b: list[str], *args) -> np.ndarray:
        size = np.array([max(len(x), len(y)) for x, y in zip(a, b)])
        order = np.argsort(size, kind="stable")
        out = np.zeros((len(a), width) if width > 1 else len(a))
        lo = 0
        while lo < len(order):
            hi, top = lo + 1, max(16, 2 * int(size[order[lo]]))
            while hi < len(order) and size[order[hi]] <= top and (hi - lo) * cells(int(size[order[hi]])) < most:
                hi += 1
            at = order[lo:hi]
            out[at] = kernel([a[i] for i in at], [b[i] for i in at], *args)
            lo = hi
        return out

    return run


def _at(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    return rows[np.arange(len(n)), n]


@_batched
def osa_distance(a: list[str], b: list[str]) -> np.ndarray:
    """Edits with transposition of neighbours, no substring edited twice."""
    x, la = _codes(a, -1)
    y, lb = _codes(b, -2)
    j = np.arange(y.shape[1] + 1)
    before, prev = None, np.broadcast_to(j, (len(a), len(j))).copy()
    out = np.where(la == 0, lb, 0)
    for i in range(1, x.shape[1] + 1):
        eq = y == x[:, i - 1 : i]
        cur = np.empty_like(prev)
        cur[:, 0] = i
        cur[:, 1:] = np.minimum(prev[:, 1:] + 1, prev[:, :-1] + ~eq)
        if i > 1:
            swap = (y[:, 1:] == x[:, i - 2 : i - 1]) & (y[:, :-1] == x[:, i - 1 : i])
            cur[:, 2:] = np.where(swap, np.minimum(cur[:, 2:], before[:, :-2] + 1), cur[:, 2:])
        cur = np.minimum.accumulate(cur - j, axis=1) + j
        out = np.where(la == i, _at(cur, lb), out)
        before, prev = prev, cur
    return out


def _full_kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Unrestricted transpositions: each cell may reach back to the last rows of equal characters.

    All rows of a batch's tables are kept, so a cell can fetch the one it reaches back to.
    """
    x, la = _codes(a, -1)
    y, lb = _codes(b, -2)
    n, width = len(a), y.shape[1] + 1
    rows, j = np.arange(n)[:, None], np.arange(width)
    table = np.empty((x.shape[1] + 1, n, width), np.int32)
    table[0] = j
    last_row = np.zeros((n, width - 1), np.int32)  # the last row whose character is that of the column
    col = np.arange(1, width, dtype=np.int32)
    for i in range(1, x.shape[1] + 1):
        eq = y == x[:, i - 1 : i]
        prev, cur = table[i - 1], table[i]
        cur[:, 0] = i
        cur[:, 1:] = np.minimum(prev[:, 1:] + 1, prev[:, :-1] + ~eq)
        # the last column before this one with the row's character
        seen = np.maximum.accumulate(np.where(eq, col, 0), axis=1)
        last_col = np.concatenate([np.zeros((n, 1), np.int32), seen[:, :-1]], axis=1)
        reach = (last_row > 0) & (last_col > 0)
        back = table[np.maximum(last_row - 1, 0), rows, np.maximum(last_col - 1, 0)] + (i - last_row - 1) + 1 + (col - last_col - 1)
        cur[:, 1:] = np.where(reach, np.minimum(cur[:, 1:], back), cur[:, 1:])
        table[i] = np.minimum.accumulate(cur - j, axis=1) + j
        last_row = np.where(eq, i, last_row)
    return table[la, np.arange(n), lb]


full_distance = _batched(_full_kernel, cells=lambda n: (n + 1) ** 2, most=8_000_000)


@_batched
def lcs_length(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence."""
    x, la = _codes(a, -1)
    y, _ = _codes(b, -2)
    prev = np.zeros((len(a), y.shape[1] + 1), np.int32)
    for i in range(x.shape[1]):
        cur = prev.copy()
        np.maximum(cur[:, 1:], prev[:, :-1] + (y == x[:, i : i + 1]), out=cur[:, 1:])
        prev = np.maximum.accumulate(cur, axis=1)
    return prev[:, -1]  # padding matches nothing, so it changes nothing


def indel(a: list[str], b: list[str]) -> np.ndarray:
    """2 * subsequence / total length; both empty 1."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], float)
    return np.where(total == 0, 1.0, 2.0 * lcs_length(a, b) / np.maximum(total, 1))


def common_substrings(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(length, end in a) of the longest common run, the first in ``a`` of equal ones."""
    got = _common(a, b)
    return got[:, 0], got[:, 1]


def _common_kernel(a: list[str], b: list[str]) -> np.ndarray:
    x, _ = _codes(a, -1)
    y, _ = _codes(b, -2)
    prev = np.zeros((len(a), y.shape[1] + 1), np.int32)
    best, end = np.zeros(len(a), int), np.zeros(len(a), int)
    for i in range(x.shape[1]):
        cur = np.zeros_like(prev)
        cur[:, 1:] = np.where(y == x[:, i : i + 1], prev[:, :-1] + 1, 0)
        top = cur.max(1)
        better = top > best
        best, end = np.where(better, top, best), np.where(better, i + 1, end)
        prev = cur
    return np.stack([best, end], 1)


_common = _batched(_common_kernel, 2)


@_batched
def local_alignment(a: list[str], b: list[str], match: float, mismatch: float, gap_open: float, gap_extend: float) -> np.ndarray:
    """Best cell of the match table under affine gaps, all three tables floored at zero."""
    x, _ = _codes(a, -1)
    y, _ = _codes(b, -2)
    shape = (y.shape[1] + 1, len(a))
    m, ix, iy, best = np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(len(a))
    for i in range(x.shape[1]):
        s = np.where(y.T == x[:, i], match, mismatch)
        dead = (y.T == -2) | (x[:, i] == -1)
        nm, nx, ny = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        nm[1:] = np.maximum(0.0, np.maximum(np.maximum(m[:-1] + s, ix[:-1] + s), iy[:-1] + s))
        nm[1:][dead] = 0.0
        nx[1:] = np.maximum(0.0, np.maximum(m[1:] + gap_open, ix[1:] + gap_extend))
        for j in range(1, shape[0]):
            ny[j] = np.maximum(0.0, np.maximum(nm[j - 1] + gap_open, ny[j - 1] + gap_extend))
        best = np.maximum(best, nm.max(0))
        m, ix, iy = nm, nx, ny
    return best


def _jaro_parts(a: list[str], b: list[str]):
    """Matched flags of both sides: greedy from the left, each within the window."""
    x, la = _codes(a, -1)
    y, lb = _codes(b, -2)
    window = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    j = np.arange(y.shape[1])
    in_a, in_b = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    rows = np.arange(len(a))
    for i in range(x.shape[1]):
        ok = (y == x[:, i : i + 1]) & ~in_b & (np.abs(j - i)[None, :] <= window[:, None])
        hit = ok.any(1)
        in_b[rows[hit], ok.argmax(1)[hit]] = True
        in_a[hit, i] = True
    return x, la, in_a, y, lb, in_b


def _halved_swaps(x, in_a, y, in_b, m) -> np.ndarray:
    front = lambda v, f: np.take_along_axis(v, np.argsort(~f, axis=1, kind="stable"), 1)
    k = min(x.shape[1], y.shape[1])
    p, q = front(x, in_a)[:, :k], front(y, in_b)[:, :k]
    return ((p != q) & (np.arange(k)[None, :] < m[:, None])).sum(1) // 2


@_batched
def jaro(a: list[str], b: list[str]) -> np.ndarray:
    x, la, in_a, y, lb, in_b = _jaro_parts(a, b)
    m = in_a.sum(1)
    t = _halved_swaps(x, in_a, y, in_b, m)
    fm = np.maximum(m, 1).astype(float)
    out = (fm / np.maximum(la, 1) + fm / np.maximum(lb, 1) + (fm - t) / fm) / 3.0
    out = np.where(m == 0, 0.0, out)
    same = np.array([p == q for p, q in zip(a, b)])
    return np.where(same, 1.0, out)


def _prefix(a: list[str], b: list[str], most: int = 4) -> np.ndarray:
    out = np.zeros(len(a), int)
    for i, (p, q) in enumerate(zip(a, b)):
        k = 0
        while k < min(most, len(p), len(q)) and p[k] == q[k]:
            k += 1
        out[i] = k
    return out


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    j = jaro(a, b)
    boosted = j + _prefix(a, b) * 0.1 * (1.0 - j)
    return np.where((j >= 0.7) & (j < 1.0), boosted, j)


# Character pairs that count as similar in the 1994 comparator.
SIMILAR = (
    "AE", "AI", "AO", "AU", "BV", "EI", "EO", "EU", "IO", "IU", "OU", "IY", "EY", "CG", "EF", "WU", "WV", "XK",
    "SZ", "XS", "QC", "UV", "MN", "LI", "QO", "PR", "IJ", "2Z", "5S", "8B", "1I", "1L", "0O", "0Q", "CK", "GJ",
)
_ALIKE = {frozenset(p) for p in SIMILAR}


@_batched
def strcmp95(a: list[str], b: list[str]) -> np.ndarray:
    x, _, in_a, y, _, in_b = _jaro_parts(a, b)
    ms = in_a.sum(1)
    ts = _halved_swaps(x, in_a, y, in_b, ms)
    pre = _prefix(a, b)
    out = np.zeros(len(a))
    up = lambda c: c.upper() if "a" <= c <= "z" else c
    for r, (p, q) in enumerate(zip(a, b)):
        if p == q:
            out[r] = 1.0
            continue
        m, t, la, lb = int(ms[r]), int(ts[r]), len(p), len(q)
        if not m:
            continue
        free = [j for j in range(lb) if not in_b[r, j]]
        credit = 0.0
        for i in range(la):
            if not in_a[r, i]:
                k = next((j for j in free if frozenset((up(p[i]), up(q[j]))) in _ALIKE), None)
                if k is not None:
                    free.remove(k)
                    credit += 0.3
        c = m + credit
        s = min(1.0, (c / la + c / lb + (c - t) / c) / 3.0)
        k = 0
        if s >= 0.7:
            k = int(pre[r])
            s += k * 0.1 * (1.0 - s)
        short = min(la, lb)
        if short > 4 and m > k + 1 and 2 * m >= short + k:
            s += (1.0 - s) * (m - k - 1) / ((la + lb - 2 * k) + m)
        out[r] = min(1.0, max(0.0, s))
    return out


def ratcliff_obershelp(a: list[str], b: list[str]) -> np.ndarray:
    return np.array([1.0 if p == q else SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(a, b)])


def partial_ratio(a: list[str], b: list[str]) -> np.ndarray:
    """Best Indel ratio of the shorter text with any window of the longer that it may overlap.

    All windows of all pairs are compared in one batch. Windows whose outer character the
    shorter text lacks are never better than one without it.
    """
    out = np.zeros(len(a))
    left, right, owner = [], [], []
    for r, (p, q) in enumerate(zip(a, b)):
        if p == q:
            out[r] = 1.0
        elif p and q:
            for s, t in ([(p, q), (q, p)] if len(p) == len(q) else [(p, q) if len(p) < len(q) else (q, p)]):
                chars, m, n = set(s), len(s), len(t)
                spans = [(0, i) for i in range(1, m) if t[i - 1] in chars]
                spans += [(i, i + m) for i in range(n - m + 1) if t[i + m - 1] in chars]
                spans += [(i, n) for i in range(n - m, n) if t[i] in chars]
                left += [s] * len(spans)
                right += [t[i:j] for i, j in spans]
                owner += [r] * len(spans)
    if left:
        np.maximum.at(out, owner, indel(left, right))
    return out


@_batched
def levenshtein_distance(a: list[str], b: list[str]) -> np.ndarray:
    x, la = _codes(a, -1)
    y, lb = _codes(b, -2)
    j = np.arange(y.shape[1] + 1)
    prev = np.broadcast_to(j, (len(a), len(j))).copy()
    out = np.where(la == 0, lb, 0)
    for i in range(1, x.shape[1] + 1):
        cur = np.empty_like(prev)
        cur[:, 0] = i
        cur[:, 1:] = np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (y != x[:, i - 1 : i]))
        prev = np.minimum.accumulate(cur - j, axis=1) + j
        out = np.where(la == i, _at(prev, lb), out)
    return out
