"""Hashes of the words and word shingles of many texts at once, in numpy.

Texts are taken as UTF-8 with A-Z lowered; words are runs of bytes other than space and tab to carriage return. A word's hash is a
polynomial over its bytes and its length modulo 2^64, mixed; a shingle's hash combines the mixed hashes of its words by position and is mixed again.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers (any would do) and the finaliser's constants.
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_M = (1 << 64) - 1
#: Bytes between words: space, and tab to carriage return.
GAP = np.isin(np.arange(256), [32, *range(9, 14)])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and where each text's words start (len(texts) + 1 numbers)."""
    return words_with_ends(texts)[:2]


def words_with_ends(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, and a number for the last two bytes of each word."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8) if raw else np.zeros(0, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
    gap = np.ones(len(data) + 2, bool)
    np.take(GAP, data, out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _power(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.multiply(data, up[:len(data)], out=total[1:])
    np.cumsum(total, out=total)
    hashes = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(STEP))
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts = np.searchsorted(begin, np.concatenate(([0], ends)), side="left")
    last = data[end - 1].astype(np.int64) * 256 + np.where(end - begin > 1, data[np.maximum(end - 2, 0)], 0)
    return hashes, starts, last


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles (of the whole sequence if it has fewer words, none without words)."""
    words, starts = word_hashes(texts)
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    step = 1
    for j in range(width):
        step = step * STEP & _M
        if len(rolled):
            rolled += words[j:j + len(rolled)] * np.uint64(step)
    rolled = mix(rolled)
    out = []
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            short, step = np.uint64(b - a), 1
            for w in words[a:b]:
                step = step * STEP & _M
                short = short + w * np.uint64(step)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
