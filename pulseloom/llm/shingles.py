"""Word shingles of whole texts as sorted 64-bit hashes, vectorised over a batch of documents."""

from __future__ import annotations

import numpy as np

from pulseloom.llm.common import LOWER_BYTES

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's number of words. Lower-cases A-Z."""
    buf = np.frombuffer(b" " + b" ".join(t.translate(LOWER_BYTES) for t in texts) + b" ", np.uint8)
    starts = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    gap = _SPACE[buf]
    begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * _powers(_BASE, len(buf)), out=sums[1:])
    words = mix((sums[end] - sums[begin]) * _powers(_INVERSE, len(buf))[begin] + (end - begin).astype(U) * U(0xD6E8FEB86659FD93))
    owner = np.searchsorted(starts, begin, side="right") - 1
    return words, np.bincount(owner, minlength=len(texts))


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of k-word shingles; fewer words: the whole sequence as one; none: empty."""
    words, counts = word_hashes(texts)
    odd = [U((0x8CB92BA72F3D8DD7 * (2 * i + 1) + 0x632BE59BD9B4E019 * i) & (2**64 - 1) | 1) for i in range(k)]
    n = max(len(words) - k + 1, 0)
    grams = np.zeros(n, U)
    for i in range(k):
        grams += words[i : i + n] * odd[i]
    grams = mix(grams)
    out, at = [], 0
    for c in counts:
        if c >= k:
            out.append(np.unique(grams[at : at + c - k + 1]))
        elif c:
            few = np.array([c], U) * U(0xA0761D6478BD642F)
            for i in range(c):
                few = mix(few + words[at + i : at + i + 1] * odd[i])
            out.append(few)
        else:
            out.append(np.zeros(0, U))
        at += c
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed 64-bit numbers; the first is never 0."""
    with np.errstate(over="ignore"):
        one, two = mix(s + U(0x9FB21C651E98DF25)), mix(s ^ U(0xE7037ED1A0B428DB))
        ends = mix(np.array([one.sum(dtype=U) + U(len(s)), two.sum(dtype=U) ^ U(len(s) * 31)], U)).view(np.int64)
    return int(ends[0]) or 1, int(ends[1])
