"""States of what the keyword rules say, worked out for whole batches of documents.

The rules of ``verify`` and ``status`` hold for any claims. Those of the keyword rules are of one plain form: a criterion quotes one whole line or is
absent, so no quote is wrong, no topic is held and nothing is calculated. What is left of the rules are tables of small numbers, documents by criteria;
texts are looked at once per distinct wording of a batch. ``criteria`` and ``topics`` equal those of ``status.evaluate`` in all fields (``tests`` hold
them against each other); claims of any other source, and diagnostics, go through ``status.evaluate``. No shuffle.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve import schemas
from factsieve.functions.readings import NONE, Reading, reading
from factsieve.functions.rules import hits, line_rules
from factsieve.functions.text import compiled
from factsieve.operators.extract import findings_of, texts_at, wordings
from factsieve.packs import korean as K
from factsieve.packs.model import RulePack

CRITERIA = (
    f"array<struct<criterion_id:string,topic_id:string,status:string,evidence:array<{schemas.QUOTE}>,source_value:string,finding:string,term_type:string,"
    f"derived:array<{schemas.DERIVED}>,value_kind:string,reason:string,basis:string,required:boolean,provisional:string,sources:array<string>,core:boolean>>")
TOPICS = (
    "array<struct<topic_id:string,visible:boolean,status:string,notes:array<string>,unconfirmed:array<string>,links:array<string>,"
    f"applicability_links:array<string>,value:string,first_evidence:{schemas.QUOTE},core_confirmed:int,core_open:int,extra_open:int,conflicts:int>>")
FACETS = (
    "array<struct<facet_id:string,item_id:string,facet_no:int,first:boolean,side:string,presence:string,status:string,finding:string,comparable:boolean,"
    f"grp:string,val:string,num:double,tax:string,value:string,evidence:array<{schemas.QUOTE}>>>")
QUOTE = pa.struct([("line", pa.int32()), ("text", pa.string())])

# what numbers stand for
FINDINGS = ("absent", "specific", "coarse", "undecided", "negated")
ABSENT, SPECIFIC, COARSE, UNDECIDED, NEGATED = range(5)
STATUSES = ("CONFIRMED", "PARTIAL", "UNCLEAR", "MISSING", "UNAVAILABLE", "NOT_APPLICABLE")
CONFIRMED, PARTIAL, UNCLEAR, MISSING, UNAVAILABLE, NOT_APPLICABLE = range(6)
TERMS = ("fixed", "indefinite")
REASONS = ("indefinite_term", "no_probation", "no_leave", "ocr_low_confidence", "ocr_low_confidence_related")
SIDES = ("concrete", "vague", "vague", "missing", "unavailable", "na")  # by status
PRESENT, ABSENT_SIDE, UNKNOWN = range(3)
PRESENCES = ("present", "missing", "unavailable")
TOPIC_STATES = ("MAIN_UNAVAILABLE", "MAIN_FOUND", "MAIN_PARTIAL", "MAIN_MISSING")


def named(names, codes: np.ndarray) -> pa.Array:
    """Strings for numbers, null for -1."""
    return pa.array([*names, None], pa.string()).take(pa.array(np.where(codes < 0, len(names), codes).ravel()))


def listed(mask: np.ndarray, values: pa.Array) -> pa.ListArray:
    """One list per element of ``mask``, of no or one value; ``values`` are those of the set ones."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(mask.ravel())), pa.int32()), values)


def says(texts: pa.Array, which: np.ndarray, test) -> np.ndarray:
    """``test`` of the texts of these numbers, asked once for each; not so for -1."""
    distinct, back = np.unique(which, return_inverse=True)
    return np.array([t is not None and bool(test(t)) for t in texts_at(texts, distinct)], bool)[back].reshape(which.shape)


def pattern(p: str):
    return compiled(p).search


def excluded(pack: RulePack):
    """Whether a line is no evidence for a criterion, as in ``verify``: it names nothing specific, or a workday where a rest day is asked for."""
    blanks = compiled(r"\s+")

    def told(rest: bool, text: str) -> bool:
        if pack.catch_all_head and pattern(pack.catch_all_tail)(text) and pattern(pack.catch_all_head)(blanks.sub(" ", text).strip(" ")) and not pattern(pack.condition_word)(text):
            return True
        return bool(rest and pack.workday and pattern(pack.workday)(text) and not pattern(pack.holiday_word)(text))

    return told


def judged(step, pack: RulePack, marks=None) -> SimpleNamespace:
    """The criteria of a step of documents (``rules.hits``) as tables, documents by criteria.

    ``marks``, if any, tells of uncertain ranges (``uncertain``): documents by criteria whose quote is touched, and documents by topics that are affected.
    """
    n, texts, doc, rule, line, text = step
    ids, width = pack.criterion_ids, len(pack.criteria)
    at = {c: i for i, c in enumerate(ids)}
    told, barred = findings_of(pack), excluded(pack)
    head, which, of, one, other = wordings(texts, doc, rule, text)
    words = [told(r, a if b is None else f"{a} {b}") for r, a, b in zip(of.tolist(), texts_at(texts, one), texts_at(texts, other), strict=True)]
    rest = [bool(pack.rest_topic) and c.startswith(f"{pack.rest_topic}-") for c in ids]
    out = np.array([barred(rest[r], a) for r, a in zip(of.tolist(), texts_at(texts, one), strict=True)], bool)
    finding_of = np.where(out, ABSENT, np.array([FINDINGS.index(f) for f, _ in words], np.int64)) if words else np.zeros(0, np.int64)
    term_of = np.array([TERMS.index(t) if t else -1 for _, t in words], np.int64)
    slot = doc[head] * width + rule[head]

    def place(values: np.ndarray, empty: int) -> np.ndarray:
        table = np.full(n * width, empty, np.int64)
        table[slot] = values
        return table.reshape(n, width)

    s = SimpleNamespace(n=n, texts=texts, finding=place(finding_of[which], ABSENT), term=place(term_of[which], -1), line=place(line[head] + 1, 0))
    s.text = np.where(s.finding == ABSENT, -1, place(text[head], -1))
    base = np.tile(np.array([MISSING, CONFIRMED, PARTIAL, UNCLEAR, UNAVAILABLE]), (width, 1))
    for c, (to, _) in pack.negation_status.items():
        base[at[c], NEGATED] = STATUSES.index(to)
    s.base = base[np.arange(width), s.finding]
    touched, affected = marks(s) if marks else (np.zeros((n, width), bool), np.zeros((n, len(pack.topics)), bool))
    topic_of = np.array([pack.topic_ids.index(c.topic) for c in pack.criteria])
    core = np.array([c.role == "C" for c in pack.criteria])
    related = affected[:, topic_of]

    status = s.base.copy()
    none = np.zeros(n, bool)
    s.probation, s.no_probation, s.bound, s.part_time = ~none, none, none, none
    s.reason = np.where(touched, 3, np.where(related & core, 4, -1))
    own = s.reason >= 0
    not_applicable = np.full((n, width), -1)
    holds = {}
    if pack.name == "employment_ko":
        stated = lambda cid, p: says(texts, s.text[:, at[cid]], pattern(p))
        specific = lambda cid: s.finding[:, at[cid]] == SPECIFIC
        limited = {  # as ``status.boundary_limits``
            "01-b": (MISSING, specific("01-b") & ~stated("01-b", K.WAGE_UNIT) & ~stated("01-a", K.WAGE_UNIT)),
            "02-a": (PARTIAL, specific("02-a") & ~stated("02-a", K.STATED_HOURS)),
            "09-a": (PARTIAL, specific("09-a") & stated("09-a", K.REST_DAY) & ~stated("09-a", K.DESIGNATED_HOLIDAY)),
            "10-a": (PARTIAL, specific("10-a") & stated("10-a", K.EXTERNAL_REFERENCE) & ~stated("10-a", K.GRANT_WORD))}
        for c, (to, test) in limited.items():
            status[test, at[c]] = to
        kind = s.text[:, [at[c] for c in ("05-a", "06-a", "06-b")]]
        triples, back = np.unique(kind, axis=0, return_inverse=True)
        joined = [" ".join(t for t in ts if t is not None) for ts in zip(*(texts_at(texts, column) for column in triples.T), strict=True)]
        each = lambda p: np.array([bool(pattern(p)(t)) for t in joined], bool)[back.ravel()]
        s.part_time = each(K.PART_TIME)
        s.bound = s.part_time | each(K.FIXED_TERM) | (s.term[:, at["06-a"]] == 0)

        def sure(cid: str) -> np.ndarray:
            i = at[cid]
            state = (s.base[:, i] == CONFIRMED) & ~(limited[cid][1] if cid in limited else none)
            return state & ~touched[:, i] & ~related[:, i]

        negated = lambda cid: s.finding[:, at[cid]] == NEGATED
        term = np.where(sure("06-a"), s.term[:, at["06-a"]], -1)
        s.probation, s.no_probation = sure("07-a") & ~negated("07-a"), sure("07-a") & negated("07-a")
        holds = {"fixed_term": term == 0, "probation_applies": s.probation, "leave_granted": sure("10-a") & ~negated("10-a")}
        for i, (cid, test) in enumerate((("06-b", term == 1), ("07-b", s.no_probation), ("10-b", sure("10-a") & negated("10-a")))):
            not_applicable[test, at[cid]] = i

    s.na = not_applicable >= 0
    s.live = ~s.na & ~own
    s.known = np.where(s.na | ~own, s.finding, -1)
    s.reason = np.where(s.na, not_applicable, s.reason)
    s.before = status
    s.status = np.where(s.na, NOT_APPLICABLE, np.where(own, UNAVAILABLE, status))
    s.quoted = s.live & (s.text >= 0)
    s.required = np.stack([holds[c.condition] if c.condition else np.full(n, c.role == "C") for c in pack.criteria], 1) if n else np.zeros((0, width), bool)
    s.core, s.topic_of = core, topic_of
    return s


def quotes_of(s: SimpleNamespace, mask: np.ndarray) -> pa.StructArray:
    """The quotes of the criteria that are set in ``mask``."""
    return pa.StructArray.from_arrays([pa.array(s.line[mask], pa.int32()), s.texts.take(pa.array(s.text[mask]))], fields=list(QUOTE))


def criteria_of(s: SimpleNamespace, pack: RulePack) -> pa.ListArray:
    """The tables as rows of ``criteria``."""
    n, width = s.n, len(pack.criteria)
    every = lambda values: np.tile(np.array(values), n)
    numbers = np.arange(width)
    ids = pack.criterion_ids
    nothing = np.full(n * width, -1)
    basis = np.where(s.reason >= 0, s.reason, np.where(s.known == NEGATED, len(REASONS) + NEGATED, np.where(s.before == UNCLEAR, np.where(s.known >= 0, len(REASONS) + s.known, -1), -1)))
    tags = [pack.negation_status.get(c, (None, None))[1] for c in ids]
    hours = np.array([bool(pack.hours_id) and c == pack.hours_id for c in ids])
    sources = pa.array([list(x) for c in pack.criteria for x in (
        c.codes, c.codes_fixed_or_part_time or c.codes, c.codes_part_time or c.codes_fixed_or_part_time or c.codes)], pa.list_(pa.string()))
    variant = np.where(s.part_time, 2, np.where(s.bound, 1, 0))[:, None]
    fields = {
        "criterion_id": named(ids, every(numbers)), "topic_id": named(pack.topic_ids, every(s.topic_of)), "status": named(STATUSES, s.status),
        "evidence": listed(s.quoted, quotes_of(s, s.quoted)), "source_value": named((), nothing), "finding": named(FINDINGS, s.known),
        "term_type": named(TERMS, np.where(s.live & (s.before == CONFIRMED), s.term, -1)),
        "derived": pa.nulls(n * width, pa.list_(pa.struct([("label", pa.string()), ("value", pa.string()), ("derivation", pa.string())]))),
        "value_kind": named(("quoted",), np.where(s.live & hours & (s.base == CONFIRMED), 0, -1)), "reason": named(REASONS, s.reason),
        "basis": named((*REASONS, *FINDINGS), basis), "required": pa.array(s.required.ravel()),
        "provisional": named(tags, np.where(s.live & (s.finding == NEGATED), numbers, -1)), "sources": sources.take(pa.array((3 * numbers + variant).ravel())),
        "core": pa.array(every(s.core))}
    rows = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), rows)


def topics_of(s: SimpleNamespace, pack: RulePack) -> pa.ListArray:
    """The tables as rows of ``topics``."""
    n, many = s.n, len(pack.topics)
    first = np.searchsorted(s.topic_of, np.arange(many))
    some = lambda mask: np.logical_or.reduceat(mask, first, axis=1)
    count = lambda mask: np.add.reduceat(mask.astype(np.int64), first, axis=1)
    open_ = (s.status == MISSING) | (s.status == UNCLEAR)
    done = (s.status == CONFIRMED) | (s.status == NOT_APPLICABLE)
    need = s.required
    state = np.where(some(need & (s.status == UNAVAILABLE)), 0, np.where(~some(need & ~done), 1, np.where(some(s.quoted), 2, 3)))
    visible = np.stack([s.probation if t.conditional else np.ones(n, bool) for t in pack.topics], 1)
    denied = (s.known == NEGATED) & (s.status != UNAVAILABLE)
    among = lambda ids: some(denied & np.array([c in ids for c in pack.criterion_ids]))
    applicability = among(pack.applicability_targets)
    hold = np.stack([~s.probation & ~s.no_probation if t.id == "07" and pack.name == "employment_ko" else np.zeros(n, bool) for t in pack.topics], 1)
    notes = (among(pack.neutral_targets) + 2 * applicability + 4 * hold) * visible
    wordings_ = pa.array([[w for i, w in enumerate(("neutral", "applicability", "probationHold")) if k >> i & 1] for k in range(8)], pa.list_(pa.string()))
    links = pa.array([[], *([pack.links[k] for k in t.links] for t in pack.topics), [pack.links[k] for k in pack.applicability_links]], pa.list_(pa.string()))
    numbers = np.arange(many)
    shown_links = links.take(pa.array(np.where(visible, numbers + 1, 0).ravel()))
    more = links.take(pa.array(np.where(visible & applicability, many + 1, 0).ravel()))
    listed_ids = open_ & visible[:, s.topic_of]
    unconfirmed = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(count(listed_ids).ravel())), pa.int32()),
        named(pack.criterion_ids, np.broadcast_to(np.arange(len(pack.criteria)), listed_ids.shape)[listed_ids]))
    # a quote of what is needed goes before others
    rank = np.where(s.quoted, np.arange(len(pack.criteria)) + np.where(need, 0, 1000), 10**6)
    best = np.minimum.reduceat(rank, first, axis=1)
    cited = (best < 10**6) & visible
    column = np.where(cited, best % 1000, 0)
    rows_ = np.arange(n)[:, None]
    hidden = ~visible.ravel()
    evidence = pa.StructArray.from_arrays(
        [pa.array(s.line[rows_, column].ravel(), pa.int32()), s.texts.take(pa.array(s.text[rows_, column].ravel(), mask=~cited.ravel()))],
        fields=list(QUOTE), mask=pa.array(~cited.ravel()))
    number = lambda values: pa.array(values.ravel(), pa.int32(), mask=hidden)
    fields = {
        "topic_id": named(pack.topic_ids, np.tile(numbers, n)), "visible": pa.array(visible.ravel()), "status": named(TOPIC_STATES, np.where(visible, state, -1)),
        "notes": wordings_.take(pa.array(notes.ravel())), "unconfirmed": unconfirmed, "links": shown_links, "applicability_links": more,
        "value": pa.nulls(n * many, pa.string()), "first_evidence": evidence, "core_confirmed": number(count(need & (s.status == CONFIRMED))),
        "core_open": number(count(need & ~done)), "extra_open": number(count(open_ & ~s.core)), "conflicts": number(np.zeros((n, many), np.int64))}
    rows = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * many, pa.int32()), rows)


def facets_of(s: SimpleNamespace, pack: RulePack, items, quotes: bool) -> pa.ListArray:
    """The tables as rows of ``facets`` (C2, C3, R2); each distinct text of a facet is read once."""
    n, at = s.n, {c: i for i, c in enumerate(pack.criterion_ids)}
    facets = [(facet, item, kind, nth == 0) for item, _, fs in items for nth, (facet, _, kind) in enumerate(fs)]
    of = np.array([at[f] for f, *_ in facets])
    many, status, known = len(facets), s.status[:, of], s.known[:, of]
    none_applies = ((s.status[:, at["07-a"]] == CONFIRMED) & (s.known[:, at["07-a"]] == NEGATED))[:, None] & np.array([f == "08-a" for f, *_ in facets])
    side = np.where(none_applies, NOT_APPLICABLE, status)
    presence = np.where(status == UNAVAILABLE, UNKNOWN, np.where((status == MISSING) & ~none_applies, ABSENT_SIDE, PRESENT))
    text = np.where(s.quoted, s.text, -1)
    term = np.where(s.live & (s.before == CONFIRMED), s.term, -1)
    readings: list[Reading] = [NONE]
    which = np.zeros((n, many), np.int64)
    for j, (facet, _, kind, _) in enumerate(facets):
        i, rows = at[facet], np.flatnonzero(side[:, j] == CONFIRMED)
        about = [text[rows, at[c]] if kind == "money" else np.full(len(rows), -1) for c in ("01-a", "01-b", "01-g")]
        own = [term[rows, i] if kind == "term" else np.full(len(rows), -1), known[rows, j] == NEGATED]
        distinct, back = np.unique(np.stack([text[rows, i], *about, *own], 1), axis=0, return_inverse=True)
        which[rows, j] = len(readings) + back.ravel()
        words = zip(*(texts_at(s.texts, column) for column in distinct[:, :4].T), strict=True)
        for (t, a, b, g), (kept, negated) in zip(words, distinct[:, 4:].tolist(), strict=True):
            joined = lambda *parts: "\n".join(p for p in parts if p is not None)
            readings.append(reading(kind, t or "", TERMS[kept] if kept >= 0 else None, bool(negated), joined(a, b), joined(a, g)))
    grp, val, num, tax = (list(column) for column in zip(*readings, strict=True))
    taken = pa.array(which.ravel())
    told = lambda column: pa.array(column, pa.string()).take(taken)
    stands = s.quoted[:, of] if quotes else np.zeros((n, many), bool)
    rows_ = SimpleNamespace(line=s.line[:, of], text=s.text[:, of], texts=s.texts)
    every = lambda values: np.tile(np.array(values), n)
    numbers, item_ids = np.arange(many), [i for _, i, *_ in facets]
    fields = {
        "facet_id": named([f for f, *_ in facets], every(numbers)), "item_id": named(item_ids, every(numbers)), "facet_no": pa.array(every(numbers), pa.int32()),
        "first": pa.array(every([f for *_, f in facets])), "side": named(SIDES, side), "presence": named(PRESENCES, presence), "status": named(STATUSES, status),
        "finding": named(FINDINGS, known), "comparable": pa.array(np.array([v is not None and g is not None for g, v, *_ in readings])[which].ravel()),
        "grp": told([g if v is not None else None for g, v, *_ in readings]), "val": told(val), "num": pa.array(num, pa.float64()).take(taken), "tax": told(tax),
        "value": pa.nulls(n * many, pa.string()), "evidence": listed(stands, quotes_of(rows_, stands))}
    rows = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * many, pa.int32()), rows)


def around(text: str, a: int, b: int) -> str:
    """A part of a line, widened to word edges plus one word each side."""
    words = compiled(r"\S*\s*\S*").match
    return words(text[:a][::-1]).group()[::-1] + text[a:b] + words(text[b:]).group()


def as_digits(text: str) -> str:
    """``text.as_digits`` of one text."""
    for letters, digit in (("Oo", "0"), ("Il|", "1"), ("S", "5")):
        text = compiled(rf"(?<=\d)[{letters}]|[{letters}](?=\d)").sub(digit, text)
    return text


def uncertain(pack: RulePack, texts: pa.Array, starts: pa.Array, ends: pa.Array, ranges: pa.Array):
    """What uncertain ranges bear on, for ``judged`` (E4-E7): lists of lines and ranges of the documents of a step."""
    cores = [pattern(t.core) for t in pack.topics]
    seen: dict[tuple[str, int, int], list[bool]] = {}

    def topics_at(text: str, a: int, b: int) -> list[bool]:
        if (text, a, b) not in seen:
            context = around(text, a, b)
            seen[text, a, b] = [bool(core(context) or core(as_digits(context))) for core in cores]
        return seen[text, a, b]

    def numbers(lists: pa.Array) -> np.ndarray:
        return pc.fill_null(lists, 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def marks(s: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
        width, many = len(pack.criteria), len(pack.topics)
        touched, affected = np.zeros((s.n, width), bool), np.zeros((s.n, many), bool)
        doc, spots = np.repeat(np.arange(s.n), numbers(pc.list_value_length(ranges))), ranges.flatten()
        low, high = numbers(spots.field("start")), numbers(spots.field("end"))
        real = pc.fill_null(pc.greater(spots.field("end"), spots.field("start")), False).to_numpy(zero_copy_only=False).astype(bool)
        doc, low, high = doc[real], low[real], high[real]
        if not len(doc):
            return touched, affected
        count = numbers(pc.list_value_length(texts))
        offset = np.cumsum(count) - count
        start, end = numbers(starts.flatten()), numbers(ends.flatten())
        # quotes of the criteria that a range lies on
        cited = s.text[doc] >= 0
        line = np.where(cited, offset[doc][:, None] + s.line[doc] - 1, 0)
        on = cited & (low[:, None] < np.append(end, 0)[line]) & (np.append(start, 0)[line] < high[:, None])
        np.logical_or.at(touched, doc, on)
        # topics that the words around a range name, where it lies on none of their own core quotes
        topic_of = np.array([pack.topic_ids.index(c.topic) for c in pack.criteria])
        core = np.array([c.role == "C" for c in pack.criteria])
        spoken = np.logical_or.reduceat(on & core, np.searchsorted(topic_of, np.arange(many)), axis=1)
        of = np.repeat(np.arange(len(doc)), count[doc])
        each = np.arange(len(of)) - np.repeat(np.cumsum(count[doc]) - count[doc], count[doc]) + offset[doc][of]
        met = (end[each] > low[of]) & (start[each] < high[of])
        of, each = of[met], each[met]
        a, b = np.maximum(low[of], start[each]) - start[each], np.minimum(high[of], end[each]) - start[each]
        named_ = np.zeros((len(doc), many), bool)
        told = [topics_at(*x) for x in zip(texts_at(texts.flatten(), each), a.tolist(), b.tolist(), strict=True)]
        np.logical_or.at(named_, of, np.array(told, bool).reshape(-1, many))
        np.logical_or.at(affected, doc, named_ & ~spoken)
        return touched, affected

    return marks


def tables(pack: RulePack, ddl: str, make):
    """An Arrow function from the lines of documents, and where uncertain ranges lie if asked, to the rows that ``make`` gets from their tables."""
    rules = line_rules(pack)

    @F.arrow_udf(ddl)
    def rows(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([make(judged(step, pack), pack) for step in hits(lists, rules)] or [make(judged(none_of(lists), pack), pack)])

    @F.arrow_udf(ddl)
    def marked(lists: pa.Array, starts: pa.Array, ends: pa.Array, ranges: pa.Array) -> pa.Array:
        parts, at = [], 0
        for step in hits(lists, rules):
            marks = uncertain(pack, *(x.slice(at, step[0]) for x in (lists, starts, ends, ranges)))
            parts.append(make(judged(step, pack, marks), pack))
            at += step[0]
        return pa.concat_arrays(parts or [make(judged(none_of(lists), pack), pack)])

    lines = F.col("lines")
    return lambda ranges=None: (rows.asNondeterministic()(lines["text"]) if ranges is None else
                                marked.asNondeterministic()(lines["text"], lines["start"], lines["end"], F.col(ranges)))


def judge(docs: DataFrame, pack: RulePack, ranges: str | None = None) -> DataFrame:
    """Adds ``criteria`` and ``topics`` to documents with ``lines``; what a query does not use of the two is not worked out."""
    return docs.withColumns({"criteria": tables(pack, CRITERIA, criteria_of)(ranges), "topics": tables(pack, TOPICS, topics_of)(ranges)})


def judge_facets(docs: DataFrame, pack: RulePack, items=K.RELATE_ITEMS, quotes: bool = True, ranges: str | None = None) -> DataFrame:
    """Adds ``facets`` to documents with ``lines``, those of ``facets.with_facets``; without ``quotes`` their ``evidence`` is left empty."""
    return docs.withColumn("facets", tables(pack, FACETS, lambda s, pack: facets_of(s, pack, items, quotes))(ranges))


def none_of(lists: pa.Array) -> tuple:
    """The step of no documents."""
    return 0, pa.array([], pa.string()), *(np.zeros(0, np.int64),) * 4
