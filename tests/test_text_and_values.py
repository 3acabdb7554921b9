from pyspark.sql import functions as F

from factsieve.functions import text as T
from factsieve.functions import values as V
from factsieve.operators import segment


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("x")).first()["x"]


def test_normalisation(spark):
    t = F.col("t")
    assert one(spark, " a 　 b\n", T.norm_ws(t)) == "a b"
    assert one(spark, "  x \r\n\n\n\n y ", T.tidy_text(t)) == "x\n\ny"
    assert one(spark, "근무지 _ _ 서울 | file_name", T.strip_ocr_junk(t)) == "근무지 서울 file_name"
    assert one(spark, "4,0O0만 1l:00", T.as_digits(t)) == "4,000만 11:00"
    assert one(spark, "지급일", T.josa(t, "이", "가")) == "지급일이"
    assert one(spark, "근무장소", T.josa(t, "이", "가")) == "근무장소가"
    same = T.normalize_condition_text(t, place=True)
    assert one(spark, "근무장소: 서울 강남구 길 100", same) == one(spark, "서울특별시 강남구 길 100", same)


def test_needles_are_necessary():
    import re

    from factsieve.packs import korean as K

    for c in K.PACK.criteria:
        for sample in ("임금: 세전 연봉 3,600만원", "소정근로시간: 주 40시간", "수습 3개월 평가", "연차 15일", "계약기간 1년", "매월 25일 지급"):
            if re.search(c.line, sample):
                assert any(w in sample for w in c.needs), (c.id, sample)


def test_values(spark):
    t = F.col("t")
    for written, won in (("연봉 3,600만원", [36_000_000]), ("연 36,000,000원", [36_000_000]), ("3천만 원", [30_000_000]),
                         ("2억 4천만원", [240_000_000]), ("기본급 200만원, 식대 20만원", [2_000_000, 200_000]), ("1 2 3", [])):
        assert one(spark, written, V.amounts(t)) == won
    assert one(spark, "연봉 3,600만원(월 300만원)", V.pay_unit(t)) is None
    assert one(spark, "시급 10,030원", V.pay_unit(t)) == "hourly"
    assert [tuple(x) for x in one(spark, "주 40시간, 1일 8시간", V.hours(t))] == [("week", 40.0), ("day", 8.0)]
    assert one(spark, "9시~18시 휴게 12:00~13:00", V.time_ranges(t, True)) == ["09:00~18:00"]
    assert one(spark, "휴게 12:00~13:00", V.break_minutes(t)) == [60]
    assert one(spark, "매월 25일", V.paydays(t)) == ["25일"]
    assert tuple(one(spark, "2026년 11월 1일부터 2027년 10월 31일까지", V.period(t))) == ("dates", "2026-11-01~2027-10-31")
    assert one(spark, "2026.1.1", V.period(t)) is None
    assert one(spark, "세전, 세후", V.tax_basis(t)) is None


def test_segmentation_round_trip(spark):
    long = "저희 회사는 성장하는 곳입니다. 담당업무는 고객 응대이며 상담 기록을 관리합니다. 급여는 월 2.5백만원이고 매월 25일에 지급합니다. " * 2
    texts = [("a", "급여\n\n월 250만원\n근무지: 서울"), ("b", "  근로\r\n10시\r\n\t00분  \n"), ("c", long), ("d", "　넓은 칸　"), ("e", " \n "),
             ("f", "😀 첫 줄\n둘째")]
    docs = segment.with_lines(spark.createDataFrame(texts, "doc_id string, text string"))
    rows = {r.doc_id: r for r in docs.collect()}
    for r in rows.values():
        assert [x.line_no for x in r.lines] == list(range(1, len(r.lines) + 1))
        for x in r.lines:
            assert r.text[x.start : x.end] == x.text
    assert [x.text for x in rows["a"].lines] == ["급여", "월 250만원", "근무지: 서울"]
    assert len(rows["c"].lines) == 6 and rows["e"].lines == []


def test_line_spans():
    """The splitter against one written from the rule, character by character; and its cost."""
    import random
    import re
    import time

    from factsieve.operators.segment import _space, line_spans

    space = set(_space())

    def by_rule(text, limit):
        out, start = [], 0
        for row in text.split("\n"):
            bare = row[:-1] if row.endswith("\r") else row
            edges = {0, len(row)}
            i = 0
            while i < len(bare) and len(bare) > limit:
                j = i
                while j < len(bare) and bare[j] in space:
                    j += 1
                sentence = i > 1 and bare[i - 1] in ".!?。" and bare[i - 2] not in space and not re.match("[0-9]", bare[i - 2])
                bullet = j < len(bare) and bare[j] in "•■▶※□◆●○"
                if j > i and (sentence or bullet):
                    edges.add(i)
                i = max(j, i + 1)
            edges = sorted(edges)
            for a, b in zip(edges, edges[1:], strict=False):
                while a < b and row[a] in space:
                    a += 1
                while b > a and row[b - 1] in space:
                    b -= 1
                if b > a:
                    out.append((start + a, start + b))
            start += len(row) + 1
        return out

    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b.", "3.", "! ", " ", "　", "\n", "\r\n", "• ", "■x", "다.", "é"]) for _ in range(rng.randint(0, 120)))
        for limit in (0, 5, 20):
            assert line_spans(text, limit) == by_rule(text, limit), (text, limit)
    seconds = []
    for n in (500_000, 1_000_000):
        t0 = time.process_time()
        line_spans("some words here. and more text\n" * (n // 31), 20)
        seconds.append(time.process_time() - t0)
    assert seconds[1] < 4 * seconds[0]


def test_spots():
    """The automaton against a search for each word; patterns that need a word are never missed."""
    import random

    from factsieve.functions.literals import spots

    rng = random.Random(5)
    needs = (("ab", "b"), ("ca",), (), ("é", "abc"), ("ab",))
    texts = ["\n".join("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 5))) for _ in range(80)] + ["", "\n\n", "abc"]
    ends, owner, line = spots(texts, needs)
    got = [sorted(zip(owner[a:b].tolist(), line[a:b].tolist(), strict=True)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert got == [sorted((i, k) for i, words in enumerate(needs) for k, row in enumerate(t.split("\n")) if any(w in row for w in words)) for t in texts]
