"""The order-sensitive matching ratio of many pairs of texts at once.

The ratio takes the longest common part (the first in the left text, then in the right) and goes on left and right of
it, as difflib does. All pairs of a batch take each step together: a part of one pair is one column of the arrays.
"""

from difflib import SequenceMatcher

import numpy as np

#: From this length on difflib leaves frequent characters of the right text out; such pairs are left to it.
LONG = 200
#: So many parts are compared at once, which keeps the arrays in the processor's cache.
PARTS = 2048


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all texts in a row, where each text begins, lengths)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    characters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return characters, np.cumsum(sizes) - sizes, sizes


def _spelled(characters, first, size, longest, pad):
    """One column per part, filled up with ``pad``."""
    at = first + np.arange(longest)[:, None]
    inside = np.arange(longest)[:, None] < size
    return np.where(inside, characters[np.where(inside, at, 0)], characters.dtype.type(pad))


def _longest_common(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, end in the left part, end in the right part) of the first longest common part of each column."""
    count = left.shape[1]
    best, left_end, right_end = (np.zeros(count, dtype=np.int64) for _ in range(3))
    best = best.astype(np.uint8)
    run = np.zeros((right.shape[0] + 1, count), dtype=np.uint8)
    for i, character in enumerate(left):
        run[1:] = (run[:-1] + np.uint8(1)) * (right == character)
        most = run.max(axis=0)
        longer = np.flatnonzero(most > best)
        if longer.size:
            best[longer] = most[longer]
            left_end[longer] = i + 1
            right_end[longer] = run[:, longer].argmax(axis=0)
    return best.astype(np.int64), left_end, right_end


def matching_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """The matching ratio of each pair (left[i], right[i])."""
    ratios = np.empty(len(left))
    many = np.fromiter((len(a) < LONG and len(b) < LONG for a, b in zip(left, right)), dtype=bool, count=len(left))
    for i in np.flatnonzero(~many):
        ratios[i] = SequenceMatcher(None, left[i], right[i]).ratio()
    rows = np.flatnonzero(many)
    if not rows.size:
        return ratios
    a, a_first, a_size = _codes([left[i] for i in rows])
    b, b_first, b_size = _codes([right[i] for i in rows])
    seen = np.zeros(max(a.max(initial=0), b.max(initial=0)) + 1, dtype=bool)
    seen[a] = seen[b] = True
    # 0 and 1 fill columns up; they never equal a character nor each other.
    numbers = np.cumsum(seen) + 1
    numbers = numbers.astype(np.uint8 if numbers[-1] < 256 else np.uint32)
    a, b = numbers[a], numbers[b]
    matched = np.zeros(rows.size, dtype=np.int64)
    pair, total = np.arange(rows.size), a_size + b_size
    while pair.size:
        kept = np.flatnonzero((a_size > 0) & (b_size > 0))
        kept = kept[np.lexsort((b_size[kept], a_size[kept]))]
        pair, a_first, a_size, b_first, b_size = (x[kept] for x in (pair, a_first, a_size, b_first, b_size))
        parts = []
        for start in range(0, pair.size, PARTS):
            p, af, an, bf, bn = (x[start : start + PARTS] for x in (pair, a_first, a_size, b_first, b_size))
            size, a_end, b_end = _longest_common(_spelled(a, af, an, an.max(), 0), _spelled(b, bf, bn, bn.max(), 1))
            np.add.at(matched, p, size)
            f = size > 0
            p, af, an, bf, bn, size, a_end, b_end = (x[f] for x in (p, af, an, bf, bn, size, a_end, b_end))
            parts.append((p, af, a_end - size, bf, b_end - size))
            parts.append((p, af + a_end, an - a_end, bf + b_end, bn - b_end))
        pair, a_first, a_size, b_first, b_size = (np.concatenate(x) for x in zip(*parts)) if parts else [pair] * 5
    ratios[rows] = np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)
    return ratios
