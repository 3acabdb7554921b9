"""Edits of a text as maps that compose, and what they do to marked spans.

An edit maps places of the old text to places of the new one. A map is a row of pieces, each a stretch of the old text or inserted text, and
the cuts by which stretches were removed or split. Maps compose in any grouping (``then`` is associative), so the edits of a document are joined
pairwise, and batches of them give the same as one by one. A span is untouched while it lies in one piece; the earliest cut in it says what became of it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate
from typing import NamedTuple

# How large an edit may be and still count as an edit of one spot
LOCAL_EDIT_MAX, LOCAL_MARGIN = 60, 10
#: Length of the last piece: the text goes on.
REST = 1 << 60


class Edit(NamedTuple):
    """Old places ``start`` to ``old_end`` became ``text``; ``at`` is its place among the events."""

    at: int
    start: int
    old_end: int
    text: str

    @property
    def removed(self) -> int:
        return self.old_end - self.start

    @property
    def local(self) -> bool:
        return max(self.removed, len(self.text)) <= LOCAL_EDIT_MAX

    def touches(self, start: int, end: int) -> bool:
        return self.start < end and self.old_end > start


class Confirm(NamedTuple):
    at: int
    span_id: int


class Piece(NamedTuple):
    """``size`` characters, those from ``old`` on; None: inserted."""

    old: int | None
    size: int


class Cut(NamedTuple):
    """Old characters ``low`` to ``high`` went, or were split at ``low`` if both are equal."""

    low: int
    high: int
    edit: Edit


class EditMap:
    def __init__(self, pieces: Sequence[Piece], cuts: Sequence[Cut]):
        self.pieces, self.cuts = [p for p in pieces if p.size], list(cuts)
        self.ends = list(accumulate(p.size for p in self.pieces))

    @classmethod
    def of(cls, edit: Edit) -> EditMap:
        pieces = [Piece(0, edit.start), Piece(None, len(edit.text)), Piece(edit.old_end, REST)]
        return cls(pieces, [Cut(edit.start, edit.old_end, edit)])

    def between(self, low: int, high: int) -> list[Piece]:
        """The pieces of the new text from ``low`` to ``high``."""
        out, k = [], bisect_right(self.ends, low)
        while k < len(self.pieces) and (begin := self.ends[k] - self.pieces[k].size) < high:
            a, b = max(low, begin), min(high, self.ends[k])
            old = self.pieces[k].old
            out.append(Piece(old if old is None else old + a - begin, b - a))
            k += 1
        return out

    def _back(self, cut: Cut) -> list[Cut]:
        """A cut of the new text as cuts of the old one; inserted text and places already split are none."""
        if cut.low < cut.high:
            return [Cut(p.old, p.old + p.size, cut.edit) for p in self.between(cut.low, cut.high) if p.old is not None]
        both = self.between(cut.low - 1, cut.low + 1) if cut.low else []
        return [Cut(both[0].old + 1, both[0].old + 1, cut.edit)] if len(both) == 1 and both[0].old is not None else []

    def then(self, later: EditMap) -> EditMap:
        pieces = [q for p in later.pieces for q in ([p] if p.old is None else self.between(p.old, p.old + p.size))]
        return EditMap(pieces, [*self.cuts, *(b for c in later.cuts for b in self._back(c))])

    def place(self, old: int) -> int:
        """New place of a character that is still there."""
        return next(e - p.size + old - p.old for p, e in zip(self.pieces, self.ends, strict=True) if p.old is not None and p.old <= old < p.old + p.size)


def joined(edits: Sequence[Edit]) -> EditMap:
    """All edits as one map, composed pairwise."""
    if len(edits) < 2:
        return EditMap.of(edits[0]) if edits else EditMap([Piece(0, REST)], [])
    half = len(edits) // 2
    return joined(edits[:half]).then(joined(edits[half:]))


def _rest_of_range(span: dict, edits: Sequence[Edit], until: int) -> tuple[dict | None, int | None]:
    """A range without known content after the edits, and the edit that ended it. Local edits inside make it wider and renew its text."""
    start, end, text = span["start"], span["end"], span["text"] or ""
    for e in edits:
        if e.at > until:
            break
        if e.touches(start, end):
            if not e.local:
                return None, e.at
            text = text[: max(0, e.start - start)] + e.text + (text[e.old_end - start :] if e.old_end < end else "")
            start = min(start, e.start)
            end = start + len(text)
        elif e.old_end <= start:
            start, end = start + len(e.text) - e.removed, end + len(e.text) - e.removed
    return {**span, "start": start, "end": end, "text": text}, None


def after_events(spans: list[dict], next_id: int, events: Sequence[Edit | Confirm]) -> tuple[list[dict], int]:
    """Spans and next free number after edits and confirmations, given in order.

    A pending span that a small local edit touches is ``edited`` (``edited_to``: what was put there); by any other edit its place is ``lost``, and what that
    edit inserted is a new ``untracked`` range. A confirmation settles the span of that number if it is still pending.
    """
    edits = [e for e in events if isinstance(e, Edit)]
    confirmed = {}
    for e in events:
        if isinstance(e, Confirm):
            confirmed.setdefault(e.span_id, e.at)
    whole, never = joined(edits), len(events)
    by_at = {e.at: e for e in edits}
    out, lost_at, ranges = [], set(), []
    for s in spans:
        until = confirmed.get(s["span_id"], never)
        if s["state"] != "pending":
            out.append(s)
        elif s["start"] is not None and s["kind"] == "untracked":
            ranges.append(s)
        else:
            hits = [] if s["start"] is None else [c.edit for c in whole.cuts if c.low < s["end"] and c.high > s["start"]]
            first = min(hits, key=lambda e: e.at, default=None)
            if first is not None and first.at < until:
                if first.local and first.removed <= s["end"] - s["start"] + LOCAL_MARGIN:
                    out.append({**s, "state": "edited", "start": None, "end": None, "edited_to": first.text})
                    continue
                lost_at.add(first.at)
                s = {**s, "kind": "lost", "start": None, "end": None}
            if until < never:
                s = {**s, "state": "confirmed", "start": None, "end": None}
            elif s["start"] is not None:
                start = whole.place(s["start"])
                s = {**s, "start": start, "end": start + s["end"] - s["start"]}
            out.append(s)

    def follow(span: dict, later: Sequence[Edit]) -> None:
        until = confirmed.get(span["span_id"], never)
        left, ended = _rest_of_range(span, later, until)
        if ended is not None:
            lost_at.add(ended)
        elif until < never:
            out.append({**span, "state": "confirmed", "start": None, "end": None, "text": left["text"]})
        else:
            out.append(left)

    for s in ranges:
        follow(s, edits)
    while lost_at:  # each opens at most one range, which can only end later
        at = min(lost_at)
        lost_at.remove(at)
        e = by_at[at]
        if e.text:
            follow({"span_id": next_id, "kind": "untracked", "state": "pending", "start": e.start, "end": e.start + len(e.text), "text": e.text, "edited_to": None},
                   [x for x in edits if x.at > at])
            next_id += 1
    return out, next_id
