"""A corpus of Korean job notices worked out from the ``orders`` table, one per order.

The test tables hold no Korean text. A notice is rendered from an order's own columns
with plain SQL expressions, so the corpus grows with the table and another SQL engine
can render the same one. A customer is a record, an order is one document of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# one row per line of a notice: (multiplier, shift, variants). A variant is an SQL string
# expression; None leaves the line out. The order's key picks the variant.
_K = "o_orderkey"
_MAN = f"(2400 + ((o_custkey * 7) % 30) * 100 + ({_K} % 3) * 100)"


def _text(n: str) -> str:
    return f"cast(cast({n} AS BIGINT) AS STRING)"


def _comma(n: str) -> str:
    return f"concat({_text(f'floor(({n}) / 1000)')}, ',', lpad({_text(f'({n}) % 1000')}, 3, '0'))"


LINES = [
    (1, 0, ["concat('[공고] 제', " + _text(_K) + ", '호')", "'근로조건 안내'", "concat('회사명: 가온', " + _text("o_custkey % 500") + ")",
            "concat('(주)다온', " + _text("o_custkey % 300") + ", ' 채용 안내')"]),
    (3, 1, [f"concat('임금: 세전 연봉 ', {_comma(_MAN)}, '만원')", f"concat('급여: 월급 ', {_text('200 + (o_custkey % 20) * 10')}, '만원')",
            f"concat('급여 ', {_text('200 + (o_custkey % 9) * 10')}, '만원')", "'급여 협의'",
            f"concat('시급 ', {_comma('10030 + (o_custkey % 7) * 100')}, '원')", "'연봉 3,000~5,000만원, 경력 따라 협의'", None,
            "'연봉은 회사 내규에 따름'", f"concat('제안 연봉은 ', {_comma(_MAN)}, '만원입니다.')"]),
    (5, 2, [f"concat('급여는 매월 ', {_text('5 + (o_custkey % 4) * 5')}, '일 지급')", "'지급일: 말일'", None, "'지급일 추후 안내'", "''"]),
    (7, 3, ["'소정근로시간: 주 40시간'", "'소정근로시간: 주 35시간'", "'근무시간: 1일 8시간'", "'근무시간은 협의'", None, "'월~금 주 5일 근무'"]),
    (11, 1, ["'출퇴근: 09:00~18:00'", "'출퇴근 10:00~19:00'", "'09:30~18:30 근무'", None]),
    (13, 2, ["'휴게시간 60분'", "'휴게 12:00~13:00'", "'휴게시간 없음'", None, "'휴게 1시간'"]),
    (17, 3, [f"concat('근무지: 서울특별시 마포구 서교로 ', {_text('1 + o_custkey % 90')})",
             f"concat('근무 장소: 서울 마포구 서교로 ', {_text('1 + o_custkey % 90')})", "'근무 장소: 판교 오피스'", "'근무지 추후 협의'", None]),
    (19, 4, ["'재택 근무 가능'", None, "'출장 있음'", None]),
    (23, 5, ["'담당업무: 서비스 정책 문서 작성'", "'수행 업무: 고객 응대 및 상담 기록 관리'", None, "'담당 업무는 입사 후 결정'"]),
    (29, 6, ["'고용형태: 정규직'", "'고용형태: 계약직'", "'기간제 근로자'", "'인턴 채용'", "'고용 형태 협의'", None]),
    (31, 7, ["concat('계약기간: 2026년 ', " + _text(f"1 + {_K} % 9") + ", '월 1일부터 2027년 1월 31일까지')", "'기간의 정함이 없는 근로계약'",
             "concat('계약기간 ', " + _text("6 + (o_custkey % 3) * 6") + ", '개월')", None, "'계약기간은 추후 안내'", None]),
    (37, 8, ["concat('수습기간 ', " + _text("1 + o_custkey % 3") + ", '개월')", "'수습 없음'", "'수습 여부 추후 결정'", None,
             "concat('수습 ', " + _text("1 + o_custkey % 3") + ", '개월 적용')"]),
    (41, 9, ["'수습 중 급여 90%'", "'수습 기간 급여는 정규 급여와 동일'", None, "'수습 중 급여 80%'", None, None]),
    (43, 1, ["'주휴일: 매주 일요일(유급)'", "'토·일 휴무'", "'휴일은 회사 내규에 따름'", "'휴일 없음'", None, "'주 5일 근무'", "'주휴일 매주 일요일'"]),
    (47, 2, ["'연차 15일 부여'", "'연차 없음'", "'연차는 법령에 따름'", "'연차 유급휴가: 1개월 개근 시 1일'", None]),
    (53, 3, ["'기타 사항은 별도 안내'", None, "'급여는 본인 명의 계좌로 이체'", "'   '", "'기본급과 식대로 구성'"]),
]

_DAY = {"spark": "unix_date(cast(o_orderdate AS DATE))",
        "duckdb": "date_diff('day', DATE '1970-01-01', cast(o_orderdate AS DATE))"}


def _line(mult: int, shift: int, variants: list[str | None]) -> str:
    whens = " ".join(f"WHEN {i} THEN {v or 'NULL'}" for i, v in enumerate(variants))
    return f"CASE ({_K} * {mult} + {shift} + floor({_K} / {len(variants)})) % {len(variants)} {whens} END"


def notice_columns(dialect: str = "spark") -> list[str]:
    """SQL select list that renders notices from ``orders``."""
    body = "concat_ws(chr(10), " + ", ".join(_line(*spec) for spec in LINES) + ")"
    return [
        f"{_text(_K)} AS doc_id",
        f"{_text('o_custkey')} AS record_id",
        f"cast({_DAY[dialect]} AS BIGINT) * 10000000000000 + {_K} AS seq",
        f"CASE {_K} % 3 WHEN 0 THEN 'job_posting' WHEN 1 THEN 'offer' ELSE 'contract' END AS doc_type",
        f"{body} AS text",
        "'paste' AS input_source",
        "o_orderdate AS registered_at",
    ]


def notices(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(*notice_columns("spark"))


def notices_sql() -> str:
    """The same corpus as a query of another engine over the ``orders`` view."""
    return "SELECT " + ", ".join(notice_columns("duckdb")) + " FROM orders"


# Stored answers to four criteria of each notice, in twelve shapes, most of them wrong in one way.
# Each criterion is given as text of its claim; L1 is the first line of the notice.
_GOOD = '"source_value":null,"term_type":null,"value_kind":null,"calc":null}'


def _claim(cid: str, finding: str, quotes: str, rest: str = _GOOD) -> str:
    return f'{{"id":"{cid}","finding":"{finding}","quotes":[{quotes}],{rest}'


def _shapes() -> list[tuple[str, list[tuple[str | None, str]]]]:
    """(claims with @ for the first line, errors as (criterion, code))."""
    ok = lambda cid: _claim(cid, "absent", "")
    quote, spaced = '{"line":1,"text":"@"}', '{"line":1,"text":"  @ "}'
    rest = [ok("01-b"), ok("02-c"), ok("09-a")]
    value = lambda v: f'"source_value":"{v}","term_type":null,"value_kind":null,"calc":null}}'
    join = lambda cs: '{"criteria":[' + ",".join(cs) + "]}"
    return [
        (join([_claim("01-a", "specific", quote), *rest]), []),
        (join([_claim("01-a", "specific", spaced), *rest]), []),
        (join([_claim("01-a", "specific", '{"line":1,"text":"@ 아님"}'), *rest]), [("01-a", "quote_not_in_line")]),
        (join([_claim("01-a", "specific", '{"line":999,"text":"@"}'), *rest]), [("01-a", "unknown_line")]),
        (join([_claim("01-a", "specific", '{"line":1,"text":" "}'), *rest]), [("01-a", "empty_quote")]),
        (join([_claim("01-a", "specific", ""), *rest]), [("01-a", "no_quotes")]),
        (join([_claim("01-a", "absent", quote), *rest]), [("01-a", "absent_with_quotes")]),
        (join([_claim("01-a", "negated", quote), *rest]), [("01-a", "negated_not_allowed")]),
        (join([_claim("01-a", "conflict", quote + "," + spaced), *rest]), [("01-a", "conflict_needs_two")]),
        (join([_claim("01-a", "specific", quote, value("다른 값")), ok("99-z"), *rest[1:], ok("09-a")]),
         [("01-a", "source_value_not_in_quote"), ("01-b", "missing_criterion"), ("09-a", "duplicate_criterion")]),
        ("not json {", [(None, "ai_call_failed:invalid_json")]),
        ('{"answer":[]}', [(None, "malformed_response")]),
    ]


def _body(dialect: str) -> str:
    first = "split(trim(text), chr(10))[0]" if dialect == "spark" else "string_split(trim(text), chr(10))[1]"
    whens = " ".join(
        f"WHEN {i} THEN replace('" + shape.replace("'", "''") + f"', '@', trim({first}))" for i, (shape, _) in enumerate(_shapes()))
    return f"CASE cast(doc_id AS BIGINT) % {len(_shapes())} {whens} END"


def stored_responses(orders: DataFrame) -> DataFrame:
    """doc_id, body: a stored answer per notice."""
    return notices(orders).selectExpr("doc_id", f"{_body('spark')} AS body")


def stored_responses_sql() -> str:
    """The errors a verifier has to report for them."""
    rows = ", ".join(
        f"({i}, {'NULL' if cid is None else repr(cid)}, '{code}')" for i, (_, errs) in enumerate(_shapes()) for cid, code in errs)
    return (f"WITH e(shape, criterion_id, code) AS (VALUES {rows}) SELECT cast(o_orderkey AS VARCHAR) AS doc_id, criterion_id, code "
            f"FROM orders JOIN e ON e.shape = o_orderkey % {len(_shapes())}")
