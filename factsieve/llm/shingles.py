"""Sets of word shingles as 64-bit numbers, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
_RANDOM = np.random.default_rng(20240101)
#: A number for each byte; A-Z have those of a-z.
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _RANDOM.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base))
    p[:1] = 1
    return np.multiply.accumulate(p)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts in one array and the place of each text (and the end). No text is null."""
    size, bits = (4, np.int32) if texts.type == pa.string() else (8, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], bits, len(texts) + 1, texts.offset * size).astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number per word, A-Z taken as a-z, and the place of each text's first word (and the end)."""
    data, at = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    ends = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts])
    return words, np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Per text its distinct shingles, ascending: of ``WORDS`` words, or of all words if there are fewer; none without words."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    joined = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        joined += words[k : len(words) - WORDS + 1 + k] * _PLACES[k] if len(joined) else 0
    joined = mixed(joined)
    out = []
    for i, size in enumerate(n.tolist()):
        if size >= WORDS:
            out.append(np.unique(joined[at[i] : at[i + 1] - WORDS + 1]))
        elif size:
            few = sum(int(w) * int(p) for w, p in zip(words[at[i] : at[i + 1]], _PLACES, strict=False)) + size * int(_PLACES[-1])
            out.append(mixed(np.array([few % (1 << 64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
