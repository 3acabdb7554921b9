"""Employment documents in Korean: 10 topics, 32 criteria.

Everything in this file is a FIXED VALUE: identifiers, labels, word lists and patterns
have to be these for results to agree. ``\\s`` is expanded by ``functions.text.portable``.
"""

from factsieve.packs.model import Criterion, RulePack, Topic


def core(id, label, line, **more):
    return Criterion(id, label, "C", line, **more)


def extra(id, label, line, **more):
    return Criterion(id, label, "D", line, **more)


TOPICS = (
    Topic(
        "01", "wage", "임금",
        (
            core("01-a", "금액", r"(급여|임금|연봉|월급|시급|시간급|보수|만\s*원)", codes=("S",), needs=("급여", "임금", "연봉", "월급", "시급", "시간급", "보수", "만")),
            core("01-b", "급여 단위", r"(연봉|월급|시급|시간급|월\s*보수|월\s*\d|연\s*\d)", codes=("S",), needs=("시급", "시간급", "보수", "월", "연")),
            extra("01-c", "임금 구성항목", r"(기본급|수당|식대|구성)", codes=("L-W",), needs=("기본급", "수당", "식대", "구성")),
            extra("01-d", "계산방법", r"(계산|산정|곱하)", codes=("L-W",), needs=("계산", "산정", "곱하")),
            extra("01-e", "지급방법", r"(계좌|이체|입금|현금)", codes=("L-W",), needs=("계좌", "이체", "입금", "현금")),
            extra("01-f", "지급일", r"(매월\s*\d+\s*일|지급일|말일|\d+\s*일\s*지급)", codes=("F",), needs=("매월", "말일", "지급")),
            extra("01-g", "세전·세후 구분", r"(세전|세후)", codes=("S",), needs=("세",)),
        ),
        core=r"(\d[\d,.]*\s*(만\s*|천\s*)?원|연봉|월급|시급|시간급|일급|주급|월\s*보수)",
        links=("lsa17", "standardContract"),
    ),
    Topic(
        "02", "work_hours", "근무시간",
        (
            core("02-a", "소정근로시간",
                 r"(\d+\s*시간|근무\s*시간|근로\s*시간|\d{1,2}:\d{2}\s*[~\-∼]|주\s*\d+(\.\d+)?\s*일)", codes=("L-W",), needs=("시간", "근무", "근로", ":", "주")),
            extra("02-b", "출퇴근 시각", r"\d{1,2}:\d{2}\s*[~\-∼]\s*\d{1,2}:\d{2}", codes=("F",), needs=(":",)),
            extra("02-c", "휴게시간", r"휴게", codes=("F", "S"), codes_fixed_or_part_time=("L-W",), needs=("휴게",)),
            extra("02-d", "근로일·근로일별 시간", r"(근로일|월요일|월·|월~|월\s*[~\-]\s*[목금])", codes=("S",),
                  codes_part_time=("L-W",), needs=("근로일", "월")),
        ),
        core=r"(\d+(\.\d+)?\s*시간|\d{1,2}\s*:\s*\d{2}|주\s*\d+(\.\d+)?\s*일)",
        links=("lsa17", "fixedTerm17", "standardContract"),
    ),
    Topic(
        "03", "workplace", "근무장소",
        (
            core("03-a", "근무 장소",
                 r"(근무\s*(장소|지)|근무지|취업\s*장소|배치\s*장소|근무할\s*곳|사업장|본사|사무실|오피스|사옥)",
                 codes=("L-M",), codes_fixed_or_part_time=("L-W",), needs=("근무", "취업", "배치", "사업장", "본사", "사무실", "오피스", "사옥")),
            extra("03-b", "재택·원격·파견·출장 여부", r"(재택|원격|파견|출장)", codes=("S",), needs=("재택", "원격", "파견", "출장")),
            extra("03-c", "근무 장소 변경 조건", r"(근무지\s*변경|장소\s*변경|전보)", codes=("S",), needs=("근무지", "장소", "전보")),
        ),
        core=r"(근무\s*(장소|지)|근무지|취업\s*장소|배치\s*장소|사업장|본사|지점|사무실|오피스|사옥|매장"
             r"|[가-힣]+(특별시|광역시|시|도|구|군)\s|[가-힣\d]+(로|길)\s*\d)",
        links=("lsaDecree8", "fixedTerm17"),
    ),
    Topic(
        "04", "duties", "담당업무",
        (
            core("04-a", "업무 내용", r"(담당\s*업무|업무\s*내용|수행\s*업무|담당\s*직무|맡을\s*일|모집\s*직무|직무)",
                 codes=("L-M",), codes_fixed_or_part_time=("L-W",), needs=("담당", "업무", "수행", "맡을", "모집", "직무")),
            extra("04-b", "추가 업무 범위", r"(그\s*밖의\s*담당|추가\s*업무|부수\s*업무)", codes=("S",), needs=("밖의", "추가", "부수")),
        ),
        core=r"(업무|직무|담당)",
        links=("lsaDecree8", "fixedTerm17"),
    ),
    Topic(
        "05", "employment_type", "고용형태",
        (
            core("05-a", "계약 형태",
                 r"(정규직|계약직|기간제|단시간|인턴|고용\s*형태|고용\s*방식|계약\s*(형태|유형))", codes=("S",), needs=("정규직", "기간제", "단시간", "인턴", "고용", "계약")),
            extra("05-b", "정규직 전환 조건", r"(정규직\s*전환|전환\s*(조건|논의|평가))", codes=("S",), needs=("정규직", "전환")),
        ),
        core=r"(정규직|계약직|기간제|단시간|인턴|파견|고용\s*(형태|방식)|계약\s*(형태|유형))",
    ),
    Topic(
        "06", "contract_period", "계약기간",
        (
            core("06-a", "기간의 정함 유무",
                 r"(계약\s*기간|근로계약\s*기간|기간의\s*정함|기간제|계약\s*존속|계약\s*종료)",
                 codes=("S",), codes_fixed_or_part_time=("L-W",), needs=("계약", "기간의", "기간제")),
            core("06-b", "시작일·종료일", r"(\d{4}\s*년.*(부터|~).*(까지|\d{4}\s*년)|계약\s*기간\s*[:：]?\s*\d)",
                 condition="fixed_term", codes=("S",), codes_fixed_or_part_time=("L-W",), needs=("년", "계약")),
            extra("06-c", "갱신 기준", r"(갱신|재계약)", codes=("S",), needs=("갱신", "재계약")),
        ),
        core=r"(계약\s*기간|기간의\s*정함|기간제|기간을\s*정|\d{4}\s*년|\d+\s*(개월|년)|종료)",
        links=("fixedTerm17", "standardContract"),
    ),
    Topic(
        "07", "probation_period", "수습기간",
        (
            core("07-a", "수습 적용 여부", r"수습", codes=("S",), needs=("수습",)),
            core("07-b", "수습 기간", r"수습.*(\d+\s*개월|\d+\s*주)", condition="probation_applies", codes=("S",), needs=("수습",)),
            extra("07-c", "평가·전환 기준", r"수습.*(평가|전환)", codes=("S",), needs=("수습",)),
        ),
        core=r"(수습|시용)",
    ),
    Topic(
        "08", "probation_pay", "수습 중 급여",
        (
            core("08-a", "수습 중 지급 기준", r"수습.*(급여|임금|보수|%|동일|차감)", codes=("S",), needs=("수습",)),
            extra("08-b", "수습 종료 후 임금", r"(종료\s*후|수습\s*후)\s*.*(월|만\s*원)", codes=("S",), needs=("종료", "수습")),
        ),
        core=r"(수습|시용|\d+\s*%)",
        conditional=True,
    ),
    Topic(
        "09", "holidays", "휴일",
        (
            core("09-a", "지정된 휴일", r"(휴일|주휴|휴무)", codes=("L-W", "S"), needs=("휴일", "주휴", "휴무")),
            extra("09-b", "유급 여부", r"(유급|무급)", codes=("S",), needs=("유급", "무급")),
            extra("09-c", "추가 공휴일 조건", r"공휴일", codes=("S",), needs=("공휴일",)),
        ),
        core=r"(휴일|휴무|주휴|공휴)",
        links=("lsa17", "standardContract"),
    ),
    Topic(
        "10", "annual_leave", "연차 유급휴가",
        (
            core("10-a", "부여 여부", r"(연차|유급\s*휴가)", codes=("L-W", "S"), needs=("연차", "유급")),
            core("10-b", "적용 대상·부여 일수·산정방법", r"(연차|유급\s*휴가).*(\d+\s*일|개근)",
                 condition="leave_granted", codes=("L-W", "S"), needs=("연차", "유급")),
            extra("10-c", "사용·신청 방식", r"(연차|휴가).*(신청|사용)", codes=("S",), needs=("연차", "휴가")),
        ),
        core=r"(연차|유급\s*휴가)",
        links=("lsa17", "standardContract"),
    ),
)

PACK = RulePack(
    name="employment_ko",
    topics=TOPICS,
    undecided=r"(협의|추후|미정|결정|입사\s*(시|후|전)|확정\s*(후|시)|별도\s*안내|안내\s*(예정|합니다|드립니다)|공유|지정)",
    external=r"(내규|규정|법령|관계\s*법)",
    negated=r"(없음|없습니다|미부여|부여하지\s*않|적용하지\s*않|두지\s*않|미적용|미지급)",
    negation_status={
        "02-c": ("PARTIAL", "D04"),
        "07-a": ("CONFIRMED", None),
        "08-a": ("PARTIAL", "probation_pay_negation"),
        "09-a": ("PARTIAL", None),
        "10-a": ("CONFIRMED", None),
    },
    fixed_term_id="06-a",
    indefinite=r"(기간의\s*정함이\s*없|정하지\s*않)",
    hours_id="02-a",
    hours=r"\d+\s*시간",
    workday=r"(주\s*\d+(?:\.\d+)?\s*일|월\s*[~\-∼]\s*금|월요일부터\s*금요일)",
    workday_line=r"주\s*\d+(\.\d+)?\s*일",
    holiday_line=r"(휴일|휴무|주휴)",
    holiday_word=r"(휴일|휴무|쉬|주휴|공휴|휴가)",
    rest_topic="09",
    catch_all_head=r"^(?:[-•·*]\s*)?(기타|그\s*밖의?|그\s*외|나머지|세부|상세)",
    catch_all_tail=r"(별도|추후|개별|공통\s*정책|입사\s*시|확정\s*시|안내|공지|고지|참고)",
    condition_word=r"(급여|임금|연봉|월급|시급|보수|근무\s*시간|근로\s*시간|휴게|출퇴근|장소|근무지|사업장|사무실|오피스"
                   r"|사옥|업무|직무|담당|고용\s*형태|계약\s*기간|계약\s*형태|수습|휴일|휴무|연차|휴가)",
    presence_only=("06-a", "07-a", "10-a"),
    neutral_targets=("07-a", "08-a", "09-a", "10-a"),
    applicability_targets=("09-a", "10-a"),
    applicability_links=("lsa18", "lsa11", "lsaDecree7", "lsaDecreeTable1"),
    links={
        "lsa17": "근로기준법 제17조",
        "lsaDecree8": "근로기준법 시행령 제8조",
        "fixedTerm17": "기간제 및 단시간근로자 보호 등에 관한 법률 제17조",
        "standardContract": "고용노동부 개정 표준근로계약서(2025.03.07 게시)",
        "lsa18": "근로기준법 제18조",
        "lsa11": "근로기준법 제11조",
        "lsaDecree7": "근로기준법 시행령 제7조",
        "lsaDecreeTable1": "근로기준법 시행령 별표 1",
    },
)

# Boundary rules of single criteria
WAGE_UNIT = r"(시급|시간급|시간당|일급|일당|주급|월급|월\s*보수|월\s*\d|연봉|연\s*\d|연간|매월|월\s*환산)"
STATED_HOURS = r"\d+(?:\.\d+)?\s*시간"
REST_DAY = r"휴무"
DESIGNATED_HOLIDAY = r"(휴일|주휴|공휴)"
HOLIDAY_LABEL = r"(휴무|휴일|주휴|공휴)"
EXTERNAL_REFERENCE = r"(법령|법|내규|규정|규칙|정책)\s*(에|을|를)?\s*(따|의|준|참고)"
GRANT_WORD = r"(부여|지급|\d+\s*일)"
BREAK_WORD = r"휴게"
NO_BREAK = r"휴게[^\n]{0,15}(없|두지\s*않|미부여)"
PART_TIME = r"단시간"
FIXED_TERM = r"(기간제|기간을\s*정한)"

# Document types in their order of stage
DOC_TYPES = {"job_posting": "채용공고", "offer": "오퍼·합격 안내", "contract": "근로계약서"}
STAGE = {"job_posting": 0, "offer": 1, "contract": 2}

# Items and facets that are compared between documents: (item, label, [(facet, label, kind)])
COMPARE_ITEMS = (
    ("01", "급여 및 지급 조건", (("01-a", "급여 금액", "money"), ("01-f", "지급일", "payday"))),
    ("02", "근무시간 및 휴게시간",
     (("02-a", "소정근로시간", "hours"), ("02-b", "출퇴근 시각", "times"), ("02-c", "휴게시간", "break"))),
    ("03", "근무장소 및 근무형태", (("03-a", "근무장소", "place"), ("03-b", "재택·파견 등 근무형태", "text"))),
    ("04", "담당업무", (("04-a", "업무 내용", "text"),)),
    ("05", "고용형태", (("05-a", "계약 형태", "employment"),)),
    ("06", "계약기간", (("06-a", "기간의 정함", "term"), ("06-b", "시작일·종료일", "period"))),
    ("07", "수습기간", (("07-a", "수습 적용", "probation"), ("07-b", "수습 기간", "duration"))),
    ("08", "수습기간 중 급여", (("08-a", "수습 중 지급 기준", "probation_pay"),)),
)
RELATE_ITEMS = COMPARE_ITEMS + (
    ("09", "휴일", (("09-a", "지정된 휴일", "text"),)),
    ("10", "연차 유급휴가", (("10-a", "연차 부여", "text"),)),
)

# Representative states and relations: the first that occurs wins
STATE_ORDER = ("changed", "unavailable", "not_comparable", "missing_one", "unclear", "added", "both_missing", "same",
               "not_applicable")
RELATION_ORDER = ("different_stated", "incomparable", "unavailable", "newly_stated", "not_mentioned_later", "same")
FOLLOW_UP_ORDER = ("different_stated", "conflict", "contract_unclear", "offer_unclear", "contract_missing",
                   "incomparable", "newly_stated", "not_mentioned_later", "partial", "missing")
PRIMARY_KINDS = ("different_stated", "conflict", "contract_unclear", "offer_unclear", "contract_missing")
PRIMARY_LIMIT = 3
CONTRACT_CORE = ("01", "02", "03", "04", "05", "06", "07")
OFFER_CORE = ("01", "02", "03", "04", "05", "07", "08")
OFFER_MISSING_ASK = ("01", "02", "03", "04")
NEW_CONDITION_ITEMS = ("06", "07", "08")

# Words in which values are written
PAY_UNITS = (
    ("annual", r"(연봉|연\s*급여|연간\s*(급여|보수|임금)|연\s*\d|년\s*\d[\d,]*\s*(만|원))"),
    ("monthly", r"(월급|월\s*(급여|보수|임금)|월\s*\d[\d,.]*\s*(만|천|원))"),
    ("hourly", r"(시급|시간급|시간당)"),
    ("daily", r"(일급|일당)"),
    ("weekly", r"주급"),
)
EMPLOYMENT_KINDS = (
    ("정규직", r"(정규직|정규\s*채용|무기\s*계약)"),
    ("기간제(계약직)", r"(계약직|기간제|기간을\s*정한|프로젝트\s*계약)"),
    ("인턴", r"인턴"),
    ("단시간", r"(단시간|파트\s*타임|시간제|아르바이트)"),
    ("파견", r"파견"),
)
BEFORE_TAX, AFTER_TAX = r"세전", r"세후|실수령"
AMOUNT = r"((?:\d[\d,]*(?:\.\d+)?\s*|(?:억|천|백|만)\s*)+)원"
AMOUNT_TOKEN = r"(\d[\d,]*(?:\.\d+)?)|(억|만|천|백)"
HOURS = r"(주|1\s*일|하루|일)\s*(?:당\s*)?(?:소정\s*)?(?:근로|근무)?\s*(?:시간)?\s*[:：]?\s*(\d+(?:\.\d+)?)\s*시간"
CLOCK_RANGE = r"(\d{1,2}):(\d{2})\s*(?:~|-|–|∼|부터)\s*(\d{1,2}):(\d{2})"
SPOKEN_RANGE = r"(\d{1,2})\s*시\s*(?:(\d{1,2})\s*분)?\s*(?:~|-|부터)\s*(\d{1,2})\s*시\s*(?:(\d{1,2})\s*분)?"
BREAK_CLAUSE = r"휴게\s*(?:시간)?\s*[:：]?\s*[^,)\n]*"
BREAK_LENGTH = r"(\d+(?:\.\d+)?)\s*(시간|분)"
MONTH_END = r"말일"
PAYDAY = r"(?:매월|익월|당월)?\s*(\d{1,2})\s*일\s*(?:에\s*)?(?:지급|입금)?"
PAYDAY_CONTEXT = r"(지급|입금|매월|익월|당월)"
DATE = r"(\d{4})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})\s*일?"
MONTHS = r"(\d+)\s*(년|개월)"
DURATION = r"(\d+)\s*(개월|주|일)"
PERCENT = r"(\d+(?:\.\d+)?)\s*%"

# Company names
NAME_FIELD = r"(?:회사명|회사\s*이름|기업명|상호|사업체명|사업장명)\s*[:：]\s*([^\n,·|/]{2,30})"
CORPORATION = r"((?:\(주\)|㈜|주식회사) ?[가-힣A-Za-z0-9&]{2,20}|[가-힣A-Za-z0-9&]{2,20} ?(?:\(주\)|㈜|주식회사))"
CORPORATE_FORM = r"\(주\)|㈜|주식회사|\s"
DEFAULT_ALIAS = "새 입사 기록"
ALIAS_MAX = 40
NOTE_MAX = 2000
