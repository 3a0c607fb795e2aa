"""Words of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240601)
BYTE = _rng.integers(1, 2**63, 256, dtype=U) | U(1)
POWER = _rng.integers(1, 2**63, 4096, dtype=U) | U(1)
SHINGLE = _rng.integers(1, 2**63, 64, dtype=U) | U(1)

# The separators of the two word definitions.
SPACES = [0x20, *range(0x09, 0x0E)]
NOT_ALNUM = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]


def table(separators: list[int]) -> np.ndarray:
    """For each byte whether it belongs to a word, after A-Z are lower-cased."""
    ok = np.ones(256, bool)
    ok[separators] = False
    return ok[lower_table()]


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


SPACE_WORDS, ALNUM_WORDS, LOWER = table(SPACES), table(NOT_ALNUM), lower_table()
LOWER_BYTE = BYTE[LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def tokens(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); words don't cross texts."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.empty(0, U), np.zeros(n_texts, np.int64)
    inside = word[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begin[edges] = inside[edges]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.empty(0, U), np.zeros(n_texts, np.int64)
    first = np.searchsorted(at, starts)
    lens = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lens)
    long = place >= len(POWER)
    factor = POWER[np.where(long, place % len(POWER), place)]
    if long.any():
        factor = np.where(long, mix(factor + place.astype(U)), factor)
    h = np.add.reduceat(LOWER_BYTE[data[at]] * factor, first)
    counts = np.diff(np.searchsorted(starts, offsets))
    return mix(h + lens.astype(U)), counts


def shingles(h: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every k-word shingle; a text of fewer words has its whole sequence as one."""
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, U)
    ends = np.cumsum(counts)
    begins = ends - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    s = np.zeros(len(h), U)
    for j in range(k):
        s[: len(h) - j] += h[j:] * SHINGLE[j]
    full = np.arange(len(h)) + k <= ends[doc]
    out_doc, out = doc[full], mix(s[full])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([sum((int(h[begins[i] + j]) * int(SHINGLE[j]) for j in range(counts[i])), int(counts[i]) * 0xD1B54A32D192ED03) & (2**64 - 1) for i in short], U)
        out_doc, out = np.concatenate([out_doc, short]), np.concatenate([out, mix(extra)])
    return out_doc, out
