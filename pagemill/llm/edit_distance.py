"""Banded bit-parallel edit distance over many pairs of lines at once.

One 64-bit word per pair holds the vertical differences of the band around the diagonal.
Per character of the longer line the word is updated by additions and shifts, as in
Myers' algorithm with a band that slides down one row per column; all pairs of a block
advance together in numpy.
"""

from __future__ import annotations

import numpy as np

WIDTH = 62  # widest band that fits one word with its carry


def codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points laid end to end and where each line starts (with the end)."""
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)


def histograms(lines: list[str]) -> np.ndarray:
    """Counts of 64 classes of characters per line; one edit changes two counts at most."""
    flat, at = codes(lines)
    owner = np.repeat(np.arange(len(lines)), np.diff(at))
    return np.bincount(owner * 64 + (flat & 63), minlength=len(lines) * 64).reshape(len(lines), 64).astype(np.int32)


def trimmed(x: str, y: str) -> tuple[str, str]:
    """The two lines without their common beginning and end, which cost no edit."""

    def shared(most: int, same) -> int:
        low = 0
        while low < most:
            mid = (low + most + 1) // 2
            low, most = (mid, most) if same(mid) else (low, mid - 1)
        return low

    head = shared(min(len(x), len(y)), lambda n: x[:n] == y[:n])
    x, y = x[head:], y[head:]
    tail = shared(min(len(x), len(y)), lambda n: x[len(x) - n:] == y[len(y) - n:])
    return x[: len(x) - tail], y[: len(y) - tail]


def within(a: list[str], b: list[str], limit: int) -> np.ndarray:
    """True where the edit distance of a[i] and b[i] is at most `limit`.

    Lengths and character counts, which bound the distance from below, decide first.
    """
    if 2 * limit + 1 > WIDTH:
        raise ValueError(f"limit is at most {(WIDTH - 1) // 2}")
    out = np.zeros(len(a), bool)
    pairs = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if abs(len(x) - len(y)) <= limit]
    left = []
    for lo in range(0, len(pairs), 512):
        part = pairs[lo:lo + 512]
        differ = np.abs(histograms([a[i] for i in part]) - histograms([b[i] for i in part])).sum(1)
        left += [part[i] for i in np.flatnonzero(differ <= 2 * limit)]
    cores = [sorted(trimmed(a[i], b[i]), key=len) for i in left]
    order = sorted(range(len(left)), key=lambda i: len(cores[i][1]))
    for lo in range(0, len(order), 4096):
        short, long = ([cores[i][side] for i in order[lo:lo + 4096]] for side in (0, 1))
        n, m = (np.array([len(x) for x in side], np.int64) for side in (short, long))
        out[[left[i] for i in order[lo:lo + 4096]]] = _block(short, long, n, m, limit)
    return out


def _block(short: list[str], long: list[str], n: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Pairs ordered by length of the longer line.

    Column j of the matrix (j characters of the long line) keeps rows j-k .. j+k; bit w of
    the words stands for row j-k+w. `score` follows the matrix value at the band's lowest
    row while that row exists, then along the last row n.
    """
    flat_s, at_s = codes(short)
    flat_l, at_l = codes(long)
    if not len(flat_l):
        return np.ones(len(n), bool)
    flat_s = np.append(flat_s, np.uint32(0xFFFFFFFF))
    one, width = np.uint64(1), 2 * k + 1
    top = one << np.uint64(width - 1)
    full = (top << one) - one
    # before the first column rows -k .. k: D = |row|, below zero the values fall, above they grow
    vp = np.full(len(n), np.uint64(((1 << k) - 1) << (k + 1)))
    vn = np.full(len(n), np.uint64((1 << (k + 1)) - 1))  # rows up to zero count down towards it
    score = np.minimum(n, k)  # column 0 at row k, or at the last row of a shorter line
    offsets = np.arange(width) - k
    for j in range(1, int(m.max()) + 1):
        live = slice(int(np.searchsorted(m, j)), None)
        c = flat_l[np.minimum(at_l[:-1][live] + j - 1, len(flat_l) - 1)]
        eq = np.zeros(len(c), np.uint64)
        for w, o in enumerate(offsets):
            row = j + o  # 1-based row of the short line
            if row < 1:
                continue
            inside = row <= n[live]
            s = flat_s[np.where(inside, at_s[:-1][live] + row - 1, len(flat_s) - 1)]
            eq |= np.where(inside & (s == c), one << np.uint64(w), np.uint64(0))
        # the band moves down a row: old bit w + 1 is the same row as new bit w
        p, q = (vp[live] >> one) | top, vn[live] >> one  # and a row enters below, one more
        d0 = ((((eq & p) + p) ^ p) | eq | q) & full
        hp = (q | ~(d0 | p)) & full
        hn = d0 & p
        above = hp << one
        vn[live] = d0 & above & full
        vp[live] = ((hn << one) | ~(d0 | above)) & full
        # lowest row of the band: diagonal step until the last row is reached, then along it
        last = j + k
        on = last <= n[live]
        diagonal = ((d0 & top) == 0).astype(np.int64)
        bit = (n[live] - (j - k)).clip(0, width - 1).astype(np.uint64)
        step = ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64)
        score[live] += np.where(on, diagonal, step)
    return score <= k
