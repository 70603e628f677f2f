"""Levenshtein distance of many pairs of texts, 64 rows of the table at a time (Myers 1999, Hyyrö 2003).

A column of the table is kept as two bit vectors, of the rows where it grows and where it falls. Pairs
of about one length move through their tables together, one character a step, as numpy arrays, each 64 rows
one column behind those above; a pair of long texts goes alone, with Python's integers as bit vectors. What both texts begin and end with does not change
their distance and is left out of the table. All distances are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Characters of a text that goes through numpy; cells of a chunk's table of masks. None of these changes a result.
SHORT, CELLS = 4096, 1 << 20
#: Words looked ahead for a place where two texts agree again; blocks that move together at least.
LOOK, FILLED = 8, 1024

_U = np.uint64
_ONE, _TOP = _U(1), _U(63)
_AHEAD = [(p, s - p) for s in range(1, LOOK + 1) for p in range(s + 1)]


def _codes(texts: Sequence[str], lengths: np.ndarray) -> np.ndarray:
    """Code points, a row for each text, filled up with 0."""
    out = np.zeros((len(texts), int(lengths.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer(
        "".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32
    )
    return out


def _together(x: Sequence[str], y: Sequence[str], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distances of pairs that move together; every `x` fills the same number of 64-bit blocks, one at least."""
    rows, columns = _codes(x, m), _codes(y, n)
    pairs, blocks, width = len(x), -(-rows.shape[1] // 64), rows.shape[1]
    # every pair has masks for its own characters only
    own = np.concatenate([rows, columns], axis=1) | np.arange(pairs)[:, None] << 21
    alphabet, named = np.unique(own, return_inverse=True)
    named = np.ascontiguousarray(named.reshape(own.shape).T)
    masks, at = np.zeros((blocks, len(alphabet)), _U), named[width:]
    for i in range(width):
        masks[i // 64, named[i, i < m]] |= _ONE << _U(i % 64)
    masks, offsets = masks.ravel(), np.arange(blocks)[:, None] * len(alphabet)
    bit = ((m - 1) % 64).astype(_U)
    up, down = np.full((blocks, pairs), ~_U(0)), np.zeros((blocks, pairs), _U)
    # what a block passes on to the next, which is one column behind it
    plus, minus = np.zeros((blocks + 1, pairs), _U), np.zeros((blocks + 1, pairs), _U)
    plus[0], score = _ONE, m.copy()
    for step in range(len(at) + blocks - 1):
        low, high = max(0, step - len(at) + 1), min(blocks, step + 1)
        equal = masks.take(at[step - high + 1 : step - low + 1][::-1] + offsets[low:high])
        p, v = up[low:high], down[low:high]
        vertical = equal | v
        equal |= minus[low:high]
        across = equal & p
        across += p
        across ^= p
        across |= equal
        falls = p & across
        across |= p
        rises = v | ~across
        if high == blocks:
            change = ((rises[-1] >> bit) & _ONE).view(np.int64) - ((falls[-1] >> bit) & _ONE).view(np.int64)
            score += np.where(step - blocks + 1 < n, change, 0)
        next_plus, next_minus = rises >> _TOP, falls >> _TOP
        rises <<= _ONE
        rises |= plus[low:high]
        falls <<= _ONE
        falls |= minus[low:high]
        np.bitwise_and(rises, vertical, out=v)
        vertical |= rises
        np.bitwise_or(falls, ~vertical, out=p)
        plus[low + 1 : high + 1], minus[low + 1 : high + 1] = next_plus, next_minus
    return score


def _alone(x: str, y: str, most: int) -> int:
    """The distance, or any number above `most` if it is above."""
    codes = _codes([x], np.array([len(x)]))[0]
    masks = {
        chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little")
        for c in np.unique(codes).tolist()
    }
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, score = full, 0, len(x)
    for left, c in zip(range(len(y) - 1, -1, -1), y):
        equal = masks.get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        rises, falls = down | (full & ~(across | up)), up & across
        score += bool(rises & top) - bool(falls & top)
        if score - left > most:
            return score - left
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        up, down = falls | (full & ~(vertical | rises)), rises & vertical
    return score


def _same(x: str, y: str) -> int:
    """Number of characters that both texts begin with."""
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def differing(x: str, y: str) -> tuple[str, str]:
    """The two texts less what both begin and, of the rest, end with; their distance is the same."""
    begin = _same(x, y)
    x, y = x[begin:], y[begin:]
    end = _same(x[::-1], y[::-1])
    return (x[:-end], y[:-end]) if end else (x, y)


def _aligned(x: str, y: str, most: int) -> bool:
    """Whether changing the words of one text to the other's, in order, takes at most `most` edits.

    After a difference, the texts go on where they next agree, up to `LOOK` words on; what lies before is
    replaced as a whole. That is one way of many, so the distance may be smaller, never larger.
    """
    a, b = x.split(" "), y.split(" ")
    i = j = cost = 0
    while i < len(a) and j < len(b) and cost <= most:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        p, q = next(
            ((p, q) for p, q in _AHEAD if i + p < len(a) and j + q < len(b) and a[i + p] == b[j + q]), (1, 1)
        )
        cost += max(sum(map(len, a[i : i + p])) + p, sum(map(len, b[j : j + q])) + q)
        i, j = i + p, j + q
    left = max(sum(map(len, a[i:])) + len(a) - i, sum(map(len, b[j:])) + len(b) - j)
    return cost + left <= most


def within(x: Sequence[str], y: Sequence[str], most: np.ndarray) -> np.ndarray:
    """Which pairs of texts have a distance of at most `most`. Characters are code points."""
    rest = [differing(s, t) for s, t in zip(x, y)]
    x, y = [s for s, _ in rest], [t for _, t in rest]
    m = np.fromiter(map(len, x), np.int64, len(x))
    n = np.fromiter(map(len, y), np.int64, len(y))
    out = np.abs(m - n) <= most
    longest = np.maximum(m, n)
    # no distance is above the longer length; beyond it, neither text is empty
    todo = np.flatnonzero(out & (longest > most))
    todo = np.array([i for i in todo.tolist() if not _aligned(x[i], y[i], int(most[i]))], np.int64)
    for i in todo[longest[todo] > SHORT].tolist():
        out[i] = _alone(x[i], y[i], int(most[i])) <= most[i]
    todo = todo[longest[todo] <= SHORT]
    filled = -(-m // 64)
    todo = todo[np.lexsort((n[todo], -filled[todo]))]
    begin = 0
    while begin < len(todo):
        blocks = int(filled[todo[begin]])
        own = todo[begin : begin + max(1, CELLS // (32 * blocks))]
        # a few shorter texts join in, lengthened by the same beginning in both
        own = own[: max(int((filled[own] == blocks).sum()), FILLED // blocks)]
        own = own[2 * filled[own] >= blocks]
        different = np.cumsum([len(set(x[i] + y[i])) + 1 for i in own.tolist()])
        own = own[: max(1, int(np.searchsorted(different, CELLS // blocks, "right")))]
        more = 64 * (blocks - filled[own])
        both = [(" " * k + x[i], " " * k + y[i]) for i, k in zip(own.tolist(), more.tolist())]
        score = _together([s for s, _ in both], [t for _, t in both], m[own] + more, n[own] + more)
        out[own] = score <= most[own]
        begin += len(own)
    return out
