"""Edit maps against an edited list of characters that know where they come from."""

import random

from factsieve.operators import spans
from factsieve.operators.editmap import Confirm, Edit, after_events, joined
from factsieve.streaming import jobs
from tests.test_follow_up_rules import _Value


def edits_of(rng, n, size):
    """Edits that fit one after another, and the characters of the last text (numbers: those of the first)."""
    chars, out = list(range(size)), []
    for at in range(n):
        a = rng.randint(0, len(chars))
        b = min(len(chars), a + rng.choice([0, 0, 1, 3, 12, 80]))
        text = "".join(rng.choice("xyz") for _ in range(rng.choice([0, 1, 2, 9, 70])))
        if a == b and not text:
            text = "q"
        chars[a:b] = list(text)
        out.append(Edit(at, a, b, text))
    return out, chars


def watched(span, events, size):
    """One span by its own characters, edit by edit: what it becomes and the event that takes its place away."""
    chars, mine = list(range(size)), list(range(span["start"], span["end"]))
    state, kind, taken = "pending", span["kind"], None
    for e in events:
        if isinstance(e, Confirm):
            state = "confirmed" if e.span_id == span["span_id"] and state == "pending" else state
            continue
        here = [i for i, c in enumerate(chars) if c in set(mine)] if state == "pending" and kind == "ocr" else []
        chars[e.start : e.old_end] = list(e.text)
        now = [i for i, c in enumerate(chars) if c in set(mine)]
        if here and (len(now) < len(mine) or now[-1] - now[0] >= len(mine)):
            if e.old_end - e.start <= min(60, len(mine) + 10) and len(e.text) <= 60:
                state = "edited"
            else:
                kind, taken = "lost", e.at
    at = [i for i, c in enumerate(chars) if c in set(mine)]
    return kind, state, at[0] if state == "pending" and kind == "ocr" else None, taken


def test_maps_compose_in_any_grouping():
    rng = random.Random(11)
    for _ in range(60):
        edits, chars = edits_of(rng, rng.randint(1, 12), 150)
        one = joined(edits)
        k = rng.randint(0, len(edits))
        two = joined(edits[:k]).then(joined(edits[k:]))
        assert set(one.cuts) == set(two.cuts)
        for m in (one, two):
            for i, c in enumerate(chars):
                if isinstance(c, int):
                    assert m.place(c) == i


def test_spans_after_events_in_batches_of_any_size():
    rng = random.Random(7)
    for _ in range(150):
        size = 160
        edits, _ = edits_of(rng, rng.randint(0, 10), size)
        seeds = [{"span_id": i, "kind": "ocr", "state": "pending", "start": s, "end": s + rng.randint(1, 9), "text": "t", "edited_to": None}
                 for i, s in enumerate(sorted(rng.sample(range(size - 10), 8)))]
        events = []
        for e in edits:
            events.append(e._replace(at=len(events)))
            if rng.random() < 0.3:
                events.append(Confirm(len(events), rng.randint(0, 9)))
        whole, _ = after_events(seeds, 100, events)
        taken = set()
        for s in seeds:
            got = next(x for x in whole if x["span_id"] == s["span_id"])
            kind, state, start, lost = watched(s, events, size)
            assert (got["kind"], got["state"], got["start"]) == (kind, state, start)
            taken |= {lost} - {None}
        k = rng.randint(0, len(events))
        half, next_id = after_events(seeds, 100, events[:k])
        again, _ = after_events(half, next_id, [e._replace(at=i) for i, e in enumerate(events[k:])])
        plain = lambda rows: sorted((x["kind"], x["state"], x["start"] or 0, x["end"] or 0, x["text"], x["edited_to"] or "") for x in rows)
        assert plain(again) == plain(whole)
        if not any(e.text for e in events if isinstance(e, Edit) and e.at in taken):
            assert not any(x["kind"] == "untracked" for x in whole)


def test_a_range_of_unknown_content_is_renewed_by_edits_in_it():
    seeds = [{"span_id": 1, "kind": "ocr", "state": "pending", "start": 5, "end": 8, "text": "abc", "edited_to": None}]
    events = [Edit(0, 0, 100, "n" * 80), Edit(1, 10, 12, "LOCAL"), Edit(2, 0, 0, ">>")]
    got = {s["kind"]: s for s in after_events(seeds, 2, events)[0]}
    assert got["lost"]["start"] is None and got["lost"]["state"] == "pending"
    assert got["untracked"]["text"] == "n" * 10 + "LOCAL" + "n" * 68 and (got["untracked"]["start"], got["untracked"]["end"]) == (2, 85)
    gone = after_events(seeds, 2, [events[0], Edit(1, 3, 90, "")])[0]
    assert [s["kind"] for s in gone] == ["lost"]


def test_edits_and_confirmations_by_batch_and_by_stream(spark, monkeypatch):
    import pandas as pd

    texts = ["0123456789 abc def", "0123456789 aXc def", "0123456789 aXc def", None]
    seeds = spark.createDataFrame([("d", 1, "ocr", "pending", 11, 14, "abc"), ("d", 2, "ocr", "pending", 15, 18, "def"), ("e", 1, "unlocated", "pending", None, None, "zz"),
                                   (None, 5, "ocr", "pending", 0, 2, "01")],
                                  "doc_id string, span_id bigint, kind string, state string, start int, end int, text string")
    edits = spark.createDataFrame([("d", 1, texts[0], texts[1], None), ("d", 2, texts[1], texts[2], 2), ("d", 3, texts[2], texts[3], 1), (None, 1, None, "ab", None)],
                                  "doc_id string, rev bigint, before string, after string, confirm_id bigint")
    want = {("d", 1, "edited", "X", None), ("d", 2, "confirmed", None, None), ("e", 1, "pending", None, None), (None, 5, "pending", None, 2)}
    assert {(r.doc_id, r.span_id, r.state, r.edited_to, r.start) for r in spans.apply_edits(seeds, edits).collect()} == want
    assert spans.apply_edits(seeds.limit(0), edits.limit(0)).count() == 0

    keeper = jobs.SpanKeeper()
    keeper.spans = _Value()
    columns = ["rev", "span_id", "kind", "state", "start", "end", "new_end", "text"]
    first = pd.DataFrame([(-1, 1, "ocr", "pending", 11, 14, None, "abc"), (-1, 2, "ocr", "pending", 15, 18, None, "def"), (1, None, None, None, 12, 13, 13, "X")], columns=columns)
    then = pd.DataFrame([(2, 2, "confirm", None, None, None, None, None), (3, 1, "confirm", None, None, None, None, None)], columns=columns)
    next(keeper.handleInputRows(("d",), iter([first]), None))
    out = next(keeper.handleInputRows(("d",), iter([then]), None))
    assert sorted(zip(out.span_id, out.state, strict=True)) == [(1, "edited"), (2, "confirmed")]
