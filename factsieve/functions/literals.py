"""Where the words of a vocabulary stand: one pass of an Aho-Corasick automaton over the lines of many documents.

A pattern can match only where one of the words it needs stands, so the patterns of a pack become a sparse list of (pattern, line) to be
tried, however many patterns the pack holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
#: Characters that one pass looks at (one document at least).
STEP_CHARS = 1 << 19


@lru_cache(maxsize=8)
def automaton(needs: tuple[tuple[str, ...], ...]):
    """(automaton over all words, owners of each word one after the other, where each word's owners start)."""
    import ahocorasick

    owners: dict[str, list[int]] = {}
    for i, words in enumerate(needs):
        for w in words:
            owners.setdefault(w, []).append(i)
    machine = ahocorasick.Automaton()
    for k, w in enumerate(owners):
        machine.add_word(w, k)
    machine.make_automaton()
    sizes = np.array([len(v) for v in owners.values()], np.int64)
    return machine, np.array([i for v in owners.values() for i in v], np.int64), np.cumsum(sizes) - sizes, sizes


def spots(texts: list[str], needs: tuple[tuple[str, ...], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end of each text's spots, owner, line) for texts whose lines are joined by line feeds; by text, owner and line, each once."""
    machine, owners, first, sizes = automaton(needs)
    whole = "\n".join(texts)
    found = np.array([*machine.iter(whole)], np.int64).reshape(-1, 2) if len(machine) and whole else np.zeros((0, 2), np.int64)
    breaks = np.flatnonzero(np.frombuffer(whole.encode("utf-32-le"), "<u4") == 10)
    line = np.searchsorted(breaks, found[:, 0])
    lines = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    many = sizes[found[:, 1]]
    owner = owners[np.arange(many.sum()) + np.repeat(first[found[:, 1]] - np.cumsum(many) + many, many)]
    line = np.repeat(line, many)
    start = np.cumsum(lines) - lines
    text = np.searchsorted(start, line, side="right") - 1
    order = np.lexsort((line, owner, text))
    text, owner, line = text[order], owner[order], line[order]
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(owner) != 0) | (np.diff(line) != 0)
    text, owner, line = text[new], owner[new], line[new]
    return np.searchsorted(text, np.arange(len(texts)), side="right"), owner, line - start[text]


def row_steps(sizes: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Rows from and to of steps of about ``size`` (one row at least)."""
    step = (np.cumsum(sizes, dtype=np.int64) - 1) // size
    starts = np.flatnonzero(np.diff(step, prepend=-2))
    return zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)], strict=True) if len(sizes) else iter(())


def byte_sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def text_steps(texts: pa.Array, size: int) -> Iterator[list[str | None]]:
    """A batch of texts as lists of about ``size`` bytes (one text at least), so that no batch is ever whole in Python."""
    for i, j in row_steps(byte_sizes(texts), size):
        yield texts.slice(i, j - i).to_pylist()
