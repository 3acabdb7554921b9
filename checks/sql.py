"""SQL (for another engine) that states what the registered queries have to return."""

from __future__ import annotations

from factsieve.functions.text import SPACE_CHARS, portable
from factsieve.packs import korean as K
from factsieve.packs import rule_pack
from factsieve.sources.derived import notices_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(portable(pattern))})"


def norm(col: str) -> str:
    return f"trim(regexp_replace({col}, {q(portable(r'\s+'))}, ' ', 'g'))"


DOCS_EN = "docs AS (SELECT cast(doc_id AS VARCHAR) AS doc_id, text FROM documents)"
DOCS_KO = f"docs AS ({notices_sql()})"

# lines of texts in which no line is longer than the limit
LINES = r"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
                   unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
lines AS (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS line_no,
                 trim(t) AS text FROM raw WHERE trim(t) <> '')"""

# the shipped splitter: rows of over 100 characters are cut behind sentence ends and before bullets; offsets from running lengths
_WS = "[" + SPACE_CHARS + "]"
CUT_LINES = f"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
placed AS (SELECT doc_id, pos, t, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0,
  regexp_replace(t, '\\r$', '') AS r FROM raw),
marked AS (SELECT doc_id, pos, s0, CASE WHEN length(r) > 100 THEN string_split(regexp_replace(regexp_replace(r,
  '([^0-9{SPACE_CHARS}][.!?。])({_WS}+)', '\\1' || chr(1) || '\\2', 'g'), '({_WS}+[•■▶※□◆●○])', chr(1) || '\\1', 'g'), chr(1)) ELSE [r] END AS parts FROM placed),
cut AS (SELECT doc_id, pos, s0, unnest(parts) AS p, unnest(range(len(parts))) AS k FROM marked),
stood AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s1,
  regexp_replace(p, '^{_WS}+', '') AS tail, regexp_replace(regexp_replace(p, '^{_WS}+', ''), '{_WS}+$', '') AS text FROM cut),
lines AS (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS INTEGER) AS line_no, text,
  cast(s0 + s1 + length(p) - length(tail) AS INTEGER) AS start, cast(s0 + s1 + length(p) - length(tail) + length(text) AS INTEGER) AS "end" FROM stood WHERE text <> '')"""


def hits(pack) -> str:
    parts = []
    for c in pack.criteria:
        cond = rx("text", c.line)
        if pack.rest_topic and c.topic == pack.rest_topic:
            cond += f" AND NOT ({rx('text', pack.workday_line)} AND NOT {rx('text', pack.holiday_line)})"
        parts.append(f"SELECT doc_id, '{c.id}' AS criterion_id, line_no, text FROM lines WHERE {cond}")
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


def claims(pack) -> str:
    negatable = ", ".join(q(c) for c in pack.negation_status)
    hours = f" WHEN criterion_id = '{pack.hours_id}' AND NOT {rx('ctext', pack.hours)} THEN 'coarse'" if pack.hours_id else ""
    catch = "false"
    if pack.catch_all_head:
        catch = (f"{rx(norm('quote'), pack.catch_all_head)} AND {rx('quote', pack.catch_all_tail)} "
                 f"AND NOT {rx('quote', pack.condition_word)}")
    workday = "false"
    if pack.workday:
        workday = (f"substr(criterion_id, 1, 2) = '{pack.rest_topic}' AND {rx('quote', pack.workday)} "
                   f"AND NOT {rx('quote', pack.holiday_word)}")
    term = f"CASE WHEN criterion_id = '06-a' AND finding = 'specific' THEN CASE WHEN {rx('ctext', pack.indefinite)} THEN 'indefinite' ELSE 'fixed' END END" if pack.indefinite else "NULL"
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, criterion_id ORDER BY line_no) AS rn FROM hits),
two AS (SELECT doc_id, criterion_id, string_agg(text, ' ' ORDER BY line_no) AS ctext, min(line_no) AS line,
               min(CASE WHEN rn = 1 THEN text END) AS quote FROM ranked WHERE rn <= 2 GROUP BY 1, 2),
found AS (SELECT *, CASE WHEN criterion_id IN ({negatable}) AND {rx('ctext', pack.negated)} THEN 'negated'
      WHEN {rx('ctext', pack.undecided)} THEN 'undecided' WHEN {rx('ctext', pack.external)} THEN 'coarse'{hours}
      ELSE 'specific' END AS finding FROM two),
entries AS (SELECT doc_id, criterion_id, line, quote, finding, {term} AS term_type
      FROM found WHERE NOT ({catch}) AND NOT ({workday}))"""


def states(pack) -> str:
    korean = pack.name == "employment_ko"
    grid = ", ".join(f"('{c.id}', '{c.topic}', '{c.role}', {q(c.condition) if c.condition else 'NULL'})" for c in pack.criteria)
    negation = " ".join(f"WHEN e.finding = 'negated' AND g.criterion_id = '{c}' THEN '{s}'" for c, (s, _) in pack.negation_status.items())
    if korean:
        limits = f"""CASE WHEN base = 'CONFIRMED' AND criterion_id = '01-b' AND NOT (coalesce({rx('quote', K.WAGE_UNIT)}, false) OR coalesce({rx('wage', K.WAGE_UNIT)}, false)) THEN 'MISSING'
      WHEN base = 'CONFIRMED' AND criterion_id = '02-a' AND NOT {rx('quote', K.STATED_HOURS)} THEN 'PARTIAL'
      WHEN base = 'CONFIRMED' AND criterion_id = '09-a' AND {rx('quote', K.REST_DAY)} AND NOT {rx('quote', K.DESIGNATED_HOLIDAY)} THEN 'PARTIAL'
      WHEN base = 'CONFIRMED' AND criterion_id = '10-a' AND finding <> 'negated' AND {rx('quote', K.EXTERNAL_REFERENCE)} AND NOT {rx('quote', K.GRANT_WORD)} THEN 'PARTIAL'
      ELSE base END"""
    else:
        limits = "base"
    sure = lambda cid, cond: f"coalesce(bool_or(criterion_id = '{cid}' AND s1 = 'CONFIRMED' AND {cond}), false)"
    visible = "CASE WHEN topic_id = '08' THEN probation ELSE true END" if korean else "true"
    neutral = ", ".join(q(c) for c in pack.neutral_targets) or "''"
    applic = ", ".join(q(c) for c in pack.applicability_targets) or "''"
    hold = "CASE WHEN topic_id = '07' AND NOT probation AND NOT no_probation THEN 'probationHold' END" if korean else "NULL"
    return f"""grid(criterion_id, topic_id, role, cond) AS (VALUES {grid}),
base AS (SELECT d.doc_id, g.*, coalesce(e.finding, 'absent') AS finding, e.line, e.quote, e.term_type, w.quote AS wage,
      CASE WHEN e.finding = 'specific' THEN 'CONFIRMED' WHEN e.finding = 'coarse' THEN 'PARTIAL'
      WHEN e.finding IN ('undecided', 'conflict') THEN 'UNCLEAR' {negation} ELSE 'MISSING' END AS base
      FROM (SELECT doc_id FROM docs) d CROSS JOIN grid g
      LEFT JOIN entries e ON e.doc_id = d.doc_id AND e.criterion_id = g.criterion_id
      LEFT JOIN entries w ON w.doc_id = d.doc_id AND w.criterion_id = '01-a'),
limited AS (SELECT *, {limits} AS s1 FROM base),
flags AS (SELECT doc_id, {sure('06-a', "term_type = 'indefinite'")} AS indefinite, {sure('06-a', "term_type = 'fixed'")} AS fixed,
      {sure('07-a', "finding <> 'negated'")} AS probation, {sure('07-a', "finding = 'negated'")} AS no_probation,
      {sure('10-a', "finding <> 'negated'")} AS leave, {sure('10-a', "finding = 'negated'")} AS no_leave
      FROM limited GROUP BY 1),
named AS (SELECT l.*, f.* EXCLUDE (doc_id), CASE WHEN criterion_id = '06-b' AND indefinite THEN 'indefinite_term'
      WHEN criterion_id = '07-b' AND no_probation THEN 'no_probation' WHEN criterion_id = '10-b' AND no_leave THEN 'no_leave' END AS na
      FROM limited l JOIN flags f ON l.doc_id = f.doc_id),
crit AS (SELECT doc_id, criterion_id, topic_id, role, finding, term_type, probation, no_probation,
      CASE WHEN na IS NOT NULL {"" if korean else "AND false"} THEN 'NOT_APPLICABLE' ELSE s1 END AS status,
      CASE WHEN na IS NULL THEN line END AS line, CASE WHEN na IS NULL THEN quote END AS quote, na,
      CASE WHEN na IS NOT NULL THEN na WHEN finding = 'negated' THEN 'negated' WHEN s1 = 'UNCLEAR' THEN finding END AS basis,
      role = 'C' AND (cond IS NULL OR (cond = 'fixed_term' AND fixed) OR (cond = 'probation_applies' AND probation)
        OR (cond = 'leave_granted' AND leave)) AS required FROM named),
topics AS (SELECT doc_id, topic_id, any_value({visible}) AS visible,
      CASE WHEN bool_and(NOT required OR status IN ('CONFIRMED', 'NOT_APPLICABLE')) THEN 'MAIN_FOUND'
           WHEN bool_or(quote IS NOT NULL) THEN 'MAIN_PARTIAL' ELSE 'MAIN_MISSING' END AS tstatus,
      concat_ws(',', CASE WHEN bool_or(criterion_id IN ({neutral}) AND finding = 'negated') THEN 'neutral' END,
        CASE WHEN bool_or(criterion_id IN ({applic}) AND finding = 'negated') THEN 'applicability' END, any_value({hold})) AS notes,
      coalesce(string_agg(CASE WHEN status IN ('MISSING', 'UNCLEAR') THEN criterion_id END, ',' ORDER BY criterion_id), '') AS unconfirmed
      FROM crit GROUP BY 1, 2)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def pipeline(pack_name: str) -> str:
    pack = rule_pack(pack_name)
    docs = DOCS_KO if pack_name == "employment_ko" else DOCS_EN
    return with_(docs, LINES if pack_name == "employment_ko" else CUT_LINES, hits(pack), claims(pack), states(pack))


def readings() -> str:
    """Facet readings of the notices, one value per document and facet."""
    allx = lambda col, p, g: f"regexp_extract_all({col}, {q(portable(p))}, {g})"
    one = lambda lst: f"CASE WHEN len(list_distinct({lst})) = 1 THEN list_distinct({lst})[1] END"
    num = lambda s: f"cast(replace({s}, ',', '') AS BIGINT)"
    amounts = f"list_transform({allx('t', K.AMOUNT, 1)}, lambda x: CASE WHEN contains(x, '만') THEN {num(f'regexp_extract(x, {q(chr(92) + "d[" + chr(92) + "d,]*")})')} * 10000 ELSE {num('trim(x)')} END)"
    units = " || ".join(f"CASE WHEN {rx('wage_ctx', p)} THEN ['{k}'] ELSE [] END" for k, p in K.PAY_UNITS)
    kinds = "concat_ws(',', " + ", ".join(f"CASE WHEN {rx('t', p)} THEN {q(k)} END" for k, p in K.EMPLOYMENT_KINDS) + ")"
    nt = f"regexp_replace(t, {q(portable(chr(94) + r'[^:：\n]{1,15}[:：]\s*'))}, '')"
    place = f"regexp_replace(regexp_replace({nt}, '(특별자치시|특별자치도|특별시|광역시)', '', 'g'), '(경기|강원|충청북|충청남|전라북|전라남|경상북|경상남|제주)도', '\\1', 'g')"
    strip = lambda c: f"lower(regexp_replace({c}, {q(portable(chr(91) + r'\s.,·()\[\]{}' + chr(39) + chr(34) + '“”‘’' + chr(92) + '-–~/]'))}, '', 'g'))"
    clean = f"regexp_replace(t, {q(portable(K.BREAK_CLAUSE))}, '', 'g')"
    rng = lambda c: f"regexp_extract_all({c}, '\\d\\d:\\d\\d~\\d\\d:\\d\\d')"
    mins = f"list_transform(list_zip({allx('t', K.BREAK_LENGTH, 1)}, {allx('t', K.BREAK_LENGTH, 2)}), lambda x: cast(x[1] AS BIGINT) * CASE WHEN x[2] = '시간' THEN 60 ELSE 1 END) || list_transform({rng('t')}, lambda r: (cast(substr(r, 7, 2) AS BIGINT) - cast(substr(r, 1, 2) AS BIGINT)) * 60 + cast(substr(r, 10, 2) AS BIGINT) - cast(substr(r, 4, 2) AS BIGINT))"
    days = f"list_distinct(CASE WHEN contains(t, '말일') THEN ['말일'] ELSE [] END || list_transform(list_filter(list_zip({allx('t', K.PAYDAY, 0)}, {allx('t', K.PAYDAY, 1)}), lambda x: {rx('x[1]', K.PAYDAY_CONTEXT)}), lambda x: x[2] || '일'))"
    dates = f"list_transform(list_zip({allx('t', K.DATE, 1)}, {allx('t', K.DATE, 2)}, {allx('t', K.DATE, 3)}), lambda x: x[1] || '-' || lpad(x[2], 2, '0') || '-' || lpad(x[3], 2, '0'))"
    months = one(f"list_transform(list_zip({allx('t', K.MONTHS, 1)}, {allx('t', K.MONTHS, 2)}), lambda x: cast(x[1] AS BIGINT) * CASE WHEN x[2] = '년' THEN 12 ELSE 1 END)")
    facets = ", ".join(f"('{item}', '{f}', '{kind}', {n == 0})" for item, _, fs in K.RELATE_ITEMS for n, (f, _, kind) in enumerate(fs))
    order = {f: i for i, f in enumerate(f for _, _, fs in K.RELATE_ITEMS for f, _, _ in fs)}
    hours = lambda g: one(allx("t", K.HOURS, g))
    return f"""facet_dim(item_id, facet_id, kind, first) AS (VALUES {facets}),
ctx AS (SELECT doc_id, concat_ws(chr(10), max(CASE WHEN criterion_id = '01-a' THEN quote END), max(CASE WHEN criterion_id = '01-b' THEN quote END)) AS wage_ctx,
      concat_ws(chr(10), max(CASE WHEN criterion_id = '01-a' THEN quote END), max(CASE WHEN criterion_id = '01-g' THEN quote END)) AS tax_ctx
      FROM crit GROUP BY 1),
fc AS (SELECT d.doc_id, d.record_id, d.seq, d.doc_type, fd.*, c.status, c.finding, c.term_type, coalesce(c.quote, '') AS t, c.quote, x.wage_ctx, x.tax_ctx,
      CASE WHEN fd.facet_id = '08-a' AND c.no_probation THEN 'na' WHEN c.status = 'CONFIRMED' THEN 'concrete'
      WHEN c.status IN ('PARTIAL', 'UNCLEAR') THEN 'vague' WHEN c.status = 'MISSING' THEN 'missing' ELSE 'na' END AS side,
      CASE WHEN fd.facet_id = '08-a' AND c.no_probation THEN 'present' WHEN c.status = 'MISSING' THEN 'missing' ELSE 'present' END AS presence
      FROM docs d JOIN crit c ON c.doc_id = d.doc_id JOIN facet_dim fd ON fd.facet_id = c.criterion_id JOIN ctx x ON x.doc_id = d.doc_id),
reads AS (SELECT *, CASE
        WHEN kind = 'money' THEN CASE WHEN len({units}) = 1 THEN ({units})[1] END
        WHEN kind = 'hours' THEN CASE {hours(1)} WHEN '주' THEN 'week' ELSE 'day' END
        WHEN kind = 'times' THEN 'clock' WHEN kind = 'break' THEN 'minutes' WHEN kind = 'payday' THEN 'day'
        WHEN kind = 'place' THEN {strip(place)} WHEN kind = 'text' THEN {strip(nt)} WHEN kind = 'employment' THEN 'form'
        WHEN kind = 'term' THEN 'term' WHEN kind = 'probation' THEN 'probation'
        WHEN kind = 'period' THEN CASE WHEN len({dates}) = 2 THEN 'dates' WHEN len({dates}) = 0 THEN 'months' END
        WHEN kind = 'duration' THEN {one(allx('t', K.DURATION, 2))}
        WHEN kind = 'probation_pay' THEN CASE WHEN {one(allx('t', K.PERCENT, 1))} IS NOT NULL THEN 'percent' WHEN {one(amounts)} IS NOT NULL THEN 'amount' END END AS g0,
      CASE
        WHEN kind = 'money' THEN cast({one(amounts)} AS VARCHAR) WHEN kind = 'hours' THEN {hours(2)}
        WHEN kind = 'times' THEN nullif(array_to_string(list_sort(list_distinct({rng(clean)})), ','), '')
        WHEN kind = 'break' THEN cast({one(mins)} AS VARCHAR)
        WHEN kind = 'payday' THEN {one(days)}
        WHEN kind = 'place' THEN nullif({strip(place)}, '') WHEN kind = 'text' THEN nullif({strip(nt)}, '')
        WHEN kind = 'employment' THEN nullif({kinds}, '') WHEN kind = 'term' THEN term_type
        WHEN kind = 'probation' THEN CASE WHEN finding = 'negated' THEN 'none' ELSE 'applies' END
        WHEN kind = 'period' THEN CASE WHEN len({dates}) = 2 THEN ({dates})[1] || '~' || ({dates})[2] WHEN len({dates}) = 0 THEN cast({months} AS VARCHAR) END
        WHEN kind = 'duration' THEN {one(allx('t', K.DURATION, 1))}
        WHEN kind = 'probation_pay' THEN coalesce({one(allx('t', K.PERCENT, 1))}, cast({one(amounts)} AS VARCHAR)) END AS v0,
      CASE WHEN kind = 'money' THEN CASE WHEN {rx('tax_ctx', K.BEFORE_TAX)} AND NOT {rx('tax_ctx', K.AFTER_TAX)} THEN 'pre'
        WHEN {rx('tax_ctx', K.AFTER_TAX)} AND NOT {rx('tax_ctx', K.BEFORE_TAX)} THEN 'post' END END AS tax0 FROM fc),
facets AS (SELECT * EXCLUDE (g0, v0, tax0), side = 'concrete' AND g0 IS NOT NULL AND v0 IS NOT NULL AS comparable,
      CASE WHEN side = 'concrete' AND v0 IS NOT NULL AND g0 IS NOT NULL THEN g0 END AS grp,
      CASE WHEN side = 'concrete' AND g0 IS NOT NULL THEN v0 END AS val, CASE WHEN side = 'concrete' THEN tax0 END AS tax FROM reads)"""


def pair_state(a: str = "a", b: str = "b") -> str:
    return f"""CASE WHEN {a}.side = 'missing' AND {b}.side = 'missing' THEN 'both_missing'
      WHEN ({a}.side = 'missing' AND {b}.side = 'na') OR ({a}.side = 'na' AND {b}.side = 'missing') THEN 'not_applicable'
      WHEN ({a}.side = 'missing' AND {a}.doc_type = 'offer') OR ({b}.side = 'missing' AND {b}.doc_type = 'offer') THEN 'not_comparable'
      WHEN {a}.side = 'missing' THEN 'added' WHEN {b}.side = 'missing' THEN 'missing_one'
      WHEN {a}.side = 'na' AND {b}.side = 'na' THEN 'not_applicable'
      WHEN {a}.side = 'vague' OR {b}.side = 'vague' THEN 'unclear' WHEN {a}.side = 'na' OR {b}.side = 'na' THEN 'changed'
      WHEN NOT ({a}.comparable AND {b}.comparable) OR {a}.grp <> {b}.grp OR coalesce({a}.tax <> {b}.tax, false) THEN 'unclear'
      WHEN {a}.val = {b}.val THEN 'same' ELSE 'changed' END"""


def rank_of(col: str, order) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(order)) + " END"


def pairs() -> str:
    """Two documents per request: orders 2n and 2n + 1; the earlier stage is A."""
    items = ", ".join(q(i) for i, _, _ in K.COMPARE_ITEMS)
    return f"""sided AS (SELECT cast(floor(cast(doc_id AS BIGINT) / 2) AS BIGINT) AS pair_id,
        CASE doc_type WHEN 'job_posting' THEN 0 WHEN 'offer' THEN 1 ELSE 2 END AS stage, * FROM facets WHERE item_id IN ({items})),
paired AS (SELECT a.pair_id, a.item_id, a.facet_id, a.first, a.doc_id AS doc_a, b.doc_id AS doc_b, {pair_state()} AS state,
        cast(a.val AS VARCHAR) AS val_a, cast(b.val AS VARCHAR) AS val_b FROM sided a JOIN sided b
        ON a.pair_id = b.pair_id AND a.facet_id = b.facet_id AND a.stage < b.stage)"""


def relations() -> str:
    """By counting every pair of documents of a record."""
    rel = "CASE state WHEN 'changed' THEN 'different_stated' WHEN 'unclear' THEN 'incomparable' WHEN 'same' THEN 'same' END"
    return f"""rel_pairs AS (SELECT a.record_id, a.item_id, a.facet_id, {pair_state()} AS state FROM facets a JOIN facets b
        ON a.record_id = b.record_id AND a.facet_id = b.facet_id AND a.seq < b.seq
        AND a.presence = 'present' AND b.presence = 'present'),
rel_n AS (SELECT record_id, facet_id, count(*) FILTER (state = 'same') AS same_pairs, count(*) FILTER (state = 'changed') AS changed_pairs,
        count(*) FILTER (state = 'unclear') AS incomparable_pairs FROM rel_pairs GROUP BY 1, 2),
rel_d AS (SELECT record_id, item_id, facet_id, count(*) AS docs, count(*) FILTER (presence = 'present') AS present_docs,
        count(*) FILTER (presence = 'present' AND side <> 'na') AS stated_docs,
        min(seq) FILTER (presence = 'present') AS fp, min(seq) FILTER (presence = 'missing') AS fm,
        arg_max(presence, seq) AS last_kind FROM facets GROUP BY 1, 2, 3),
rel AS (SELECT d.record_id, d.item_id, d.facet_id, docs, present_docs, stated_docs, coalesce(same_pairs, 0) AS same_pairs,
        coalesce(changed_pairs, 0) AS changed_pairs, coalesce(incomparable_pairs, 0) AS incomparable_pairs,
        CASE WHEN docs < 2 THEN NULL WHEN changed_pairs > 0 THEN 'different_stated' WHEN incomparable_pairs > 0 THEN 'incomparable'
          WHEN present_docs > 0 AND fm < fp THEN 'newly_stated' WHEN present_docs > 0 AND last_kind = 'missing' THEN 'not_mentioned_later'
          WHEN same_pairs > 0 THEN 'same' END AS relation
        FROM rel_d d LEFT JOIN rel_n n ON n.record_id = d.record_id AND n.facet_id = d.facet_id)"""


def follow_ups() -> str:
    lst = lambda v: ", ".join(q(x) for x in v)
    firsts = lst([f[0][0] for _, _, f in K.RELATE_ITEMS])
    return f"""shown AS (SELECT t.*, d.record_id, d.seq, d.doc_type FROM topics t JOIN docs d ON d.doc_id = t.doc_id WHERE visible),
single AS (SELECT s.record_id, s.topic_id, CASE
        WHEN s.tstatus = 'MAIN_PARTIAL' AND s.doc_type = 'contract' THEN 'contract_unclear'
        WHEN s.tstatus = 'MAIN_PARTIAL' AND EXISTS (SELECT 1 FROM shown o WHERE o.record_id = s.record_id AND o.topic_id = s.topic_id AND o.seq > s.seq AND o.tstatus = 'MAIN_FOUND') THEN NULL
        WHEN s.tstatus = 'MAIN_PARTIAL' AND s.doc_type = 'offer' AND s.topic_id IN ({lst(K.OFFER_CORE)}) THEN 'offer_unclear'
        WHEN s.tstatus = 'MAIN_PARTIAL' THEN 'partial'
        WHEN s.tstatus = 'MAIN_MISSING' AND NOT EXISTS (SELECT 1 FROM shown o WHERE o.record_id = s.record_id AND o.topic_id = s.topic_id AND o.doc_id <> s.doc_id AND o.tstatus IN ('MAIN_FOUND', 'MAIN_PARTIAL'))
          THEN CASE WHEN s.doc_type = 'contract' THEN CASE WHEN s.topic_id IN ({lst(K.CONTRACT_CORE)}) THEN 'contract_missing' ELSE 'missing' END
                    WHEN s.doc_type = 'offer' AND s.topic_id IN ({lst(K.OFFER_MISSING_ASK)}) THEN 'missing' END END AS kind FROM shown s),
last_type AS (SELECT record_id, arg_max(doc_type, seq) AS lt FROM docs GROUP BY 1),
between_ AS (SELECT r.record_id, r.item_id AS topic_id, CASE WHEN relation IN ('different_stated', 'incomparable') THEN relation
        WHEN relation = 'newly_stated' AND stated_docs > 0 AND item_id IN ({lst(K.NEW_CONDITION_ITEMS)}) THEN relation
        WHEN relation = 'not_mentioned_later' AND stated_docs > 0 AND facet_id IN ({firsts}) AND lt = 'contract' THEN relation END AS kind
        FROM rel r JOIN last_type l ON l.record_id = r.record_id),
cands AS (SELECT * FROM single WHERE kind IS NOT NULL UNION ALL SELECT * FROM between_ WHERE kind IS NOT NULL),
keyed AS (SELECT c.*, CASE WHEN topic_id IN ('07', '08') AND (SELECT count(DISTINCT topic_id) FROM cands x WHERE x.record_id = c.record_id AND x.topic_id IN ('07', '08')) = 2
        THEN '07+08' ELSE topic_id END AS key FROM cands c),
merged AS (SELECT record_id, key, count(*) AS candidates, min({rank_of('kind', K.FOLLOW_UP_ORDER)}) AS kr, bool_or(kind IN ({lst(K.PRIMARY_KINDS)})) AS prim FROM keyed GROUP BY 1, 2),
follow AS (SELECT record_id, key, candidates, kr, prim, row_number() OVER (PARTITION BY record_id ORDER BY prim DESC, kr, key) AS rank FROM merged)"""
