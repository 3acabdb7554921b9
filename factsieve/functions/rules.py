"""Rules tried on the distinct lines of a batch of documents.

Documents of one kind repeat their lines, so a batch's lines are numbered by their text first; which rules hold is asked once per text and
handed to every place where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factsieve.functions.literals import STEP_CHARS, byte_sizes, row_steps, spots, text_steps
from factsieve.functions.text import compiled
from factsieve.packs.model import RulePack

#: Bytes of lines that are numbered together; of the distinct ones ``STEP_CHARS`` at a time become Python strings.
STEP_BYTES = 1 << 22


def line_rules(pack: RulePack) -> tuple:
    """(needed words, pattern, (pattern that rules a line out, pattern that overrides that)) per criterion."""
    apart = (pack.workday_line, pack.holiday_line)
    return tuple((c.needs, c.line, apart if pack.rest_topic and c.topic == pack.rest_topic else None) for c in pack.criteria)


def rules_held(lines: list[str], rules: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(line, rule) of every rule that holds on a line, by line and rule."""
    ends, rule, _ = spots(lines, tuple(needs for needs, _, _ in rules))
    line = np.repeat(np.arange(len(lines)), np.diff(ends, prepend=0))
    always = np.array([i for i, (needs, _, _) in enumerate(rules) if not needs], np.int64)
    line = np.concatenate([line, np.repeat(np.arange(len(lines)), len(always))])
    rule = np.concatenate([rule, np.tile(always, len(lines))])
    tests = [(compiled(pattern).search, apart and [compiled(p).search for p in apart]) for _, pattern, apart in rules]

    def holds(text: str, search, apart) -> bool:
        return bool(search(text)) and not (apart and apart[0](text) and not apart[1](text))

    held = np.fromiter((holds(lines[i], *tests[r]) for i, r in zip(line.tolist(), rule.tolist(), strict=True)), bool, len(line))
    line, rule = line[held], rule[held]
    order = np.lexsort((rule, line))
    return line[order], rule[order]


def hits(lists: pa.ListArray, rules: tuple) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For steps of documents, given as lists of lines: (documents, distinct texts, document, rule, line from 0, text) of every hit, in that order."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, flat = np.cumsum(lengths), pc.fill_null(lists.flatten(), "")
    upto = np.concatenate([[0], np.cumsum(byte_sizes(flat), dtype=np.int64)])
    for i, j in row_steps(upto[ends] - upto[ends - lengths] + 1, STEP_BYTES):
        first, count = ends[i] - lengths[i], lengths[i:j]
        coded = flat.slice(first, ends[j - 1] - first).dictionary_encode()
        texts, text = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at, rule, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for part in text_steps(texts, STEP_CHARS):
            a, r = rules_held(part, rules)
            at.append(a + before)
            rule.append(r)
            before += len(part)
        at, rule = np.concatenate(at), np.concatenate(rule)
        many = np.bincount(at, minlength=len(texts))  # rules that hold on a text
        n = many[text]
        place = np.repeat(np.arange(len(text)), n)
        rule = rule[np.arange(n.sum()) + np.repeat((np.cumsum(many) - many)[text] - np.cumsum(n) + n, n)]
        doc = np.repeat(np.arange(j - i), count)[place]
        order = np.lexsort((place, rule, doc))
        doc, rule, place = doc[order], rule[order], place[order]
        yield j - i, texts, doc, rule, place - (np.cumsum(count) - count)[doc], text[place]
