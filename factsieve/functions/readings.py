"""What ``functions.values`` reads from a text, for one text in Python: the same patterns, the same values.

Used where a text stands in many documents of a batch and is read once (``operators.judge``).
"""

from __future__ import annotations

import math
import re

from factsieve.functions.text import compiled
from factsieve.functions.values import _AMOUNT
from factsieve.packs import korean as K

#: group and value, what a number is worth, and the basis of tax
Reading = tuple[str | None, str | None, float | None, str | None]
NONE: Reading = (None, None, None, None)
_LARGEST = 2**63 - 1


def single(values: list):
    """The value if there is exactly one distinct value, else none."""
    distinct = set(values)
    return values[0] if len(distinct) == 1 else None


def says(pattern: str, text: str) -> bool:
    return compiled(pattern).search(text) is not None


def groups(pattern: str, text: str, *wanted: int) -> list[tuple[str, ...]]:
    return [tuple(m.group(g) or "" for g in wanted) for m in compiled(pattern).finditer(text)]


def _whole(text: str) -> int | None:
    """A number of 64 bits, if it is one."""
    n = int(text)
    return n if n <= _LARGEST else None


def number_text(n: float | None) -> str | None:
    """40.0 -> '40', 37.5 -> '37.5'."""
    if n is None:
        return None
    if n == math.floor(n):
        return str(min(math.floor(n), _LARGEST))
    if 1e-3 <= n < 1e7:
        return repr(n)
    digits = repr(n).split("e")[0].replace(".", "").strip("0")  # the shortest that name the number
    return f"{digits[0]}.{digits[1:] or '0'}E{math.floor(math.log10(n))}"


def _number(text: str) -> float:
    return float(text.replace(",", ""))


def _below_large_unit(part: str) -> float:
    total = 0.0
    for n, unit in groups(r"(?:(\d[\d.,]*) )?([천백])", part, 1, 2):
        total += (_number(n) if n else 1.0) * (1000.0 if unit == "천" else 100.0)
    last = compiled(r"(\d[\d.,]*) ?$").search(part)
    return total + (_number(last.group(1)) if last else 0.0)


def won_value(written: str) -> int | None:
    spelled = " ".join(m.group() for m in compiled(K.AMOUNT_TOKEN).finditer(compiled(r"\s+").sub("", written)))
    if not says(r"\d", spelled) or says(r"[\d,] \d", spelled):
        return None
    total = 0.0
    for part, unit in groups("([^억만]+)([억만]?)", spelled, 1, 2):
        total += _below_large_unit(part) * {"억": 1e8, "만": 1e4}.get(unit, 1.0)
    value = min(math.floor(total + 0.5), _LARGEST)
    return value if value > 0 else None


def amounts(text: str) -> list[int]:
    return [v for m in compiled(_AMOUNT).finditer(text) if (v := won_value(m.group(1))) is not None]


def pay_unit(text: str) -> str | None:
    hits = [k for k, p in K.PAY_UNITS if says(p, text)]
    return hits[0] if len(hits) == 1 else None


def tax_basis(text: str) -> str | None:
    before, after = says(K.BEFORE_TAX, text), says(K.AFTER_TAX, text)
    return "pre" if before and not after else "post" if after and not before else None


def _pad2(text: str) -> str:
    return str(int(text or "0")).rjust(2, "0")


def time_ranges(text: str) -> list[str]:
    found = groups(K.CLOCK_RANGE, text, 1, 2, 3, 4) + groups(K.SPOKEN_RANGE, text, 1, 2, 3, 4)
    return sorted({"{}:{}~{}:{}".format(*map(_pad2, m)) for m in found})


def break_minutes(text: str) -> list[int]:
    lengths = [math.floor(float(n) * (60 if unit == "시간" else 1) + 0.5) for n, unit in groups(K.BREAK_LENGTH, text, 1, 2)]
    minutes = lambda clock: int(clock[:2]) * 60 + int(clock[3:5])
    return lengths + [m for r in time_ranges(text) if (m := minutes(r[6:11]) - minutes(r[:5])) > 0]


def paydays(text: str) -> list[str]:
    named = ["말일"] if says(K.MONTH_END, text) else []
    return named + [f"{int(day)}일" for whole, day in groups(K.PAYDAY, text, 0, 1) if says(K.PAYDAY_CONTEXT, whole)]


def condition_text(text: str, place: bool) -> str | None:
    out = compiled(r"^[^:：\n]{1,15}[:：]\s*").sub("", text)
    if place:
        out = re.sub("(특별자치시|특별자치도|특별시|광역시)", "", out)
        out = re.sub("(경기|강원|충청북|충청남|전라북|전라남|경상북|경상남|제주)도", r"\1", out)
    return compiled(r"[\s.,·()\[\]{}'\"“”‘’\-–~/]").sub("", out).lower() or None


def period(text: str) -> tuple[str | None, str | None]:
    dates = [f"{y}-{m.rjust(2, '0')}-{d.rjust(2, '0')}" for y, m, d in groups(K.DATE, text, 1, 2, 3)]
    if len(dates) == 2:
        return "dates", "~".join(dates)
    if dates:
        return None, None
    months = single([None if (n := _whole(m)) is None else n * (12 if unit == "년" else 1) for m, unit in groups(K.MONTHS, text, 1, 2)])
    return (None, None) if months is None else ("months", str(months))


def reading(kind: str, text: str, term: str | None, negated: bool, wage_ctx: str, tax_ctx: str) -> Reading:
    """What one concrete facet says, as ``facets._reading`` of a criterion without derived values."""
    if kind == "money":
        amount, unit = single(amounts(text)), pay_unit(wage_ctx)
        return unit, str(amount) if unit and amount is not None else None, None if amount is None else float(amount), tax_basis(tax_ctx)
    if kind == "hours":
        h = single([("week" if per == "주" else "day", float(n)) for per, n in groups(K.HOURS, text, 1, 2)])
        return (h[0], number_text(h[1]), h[1], None) if h else NONE
    if kind == "times":
        return "clock", ",".join(time_ranges(compiled(K.BREAK_CLAUSE).sub("", text))) or None, None, None
    if kind == "break":
        m = single(break_minutes(text))
        return "minutes", None if m is None else str(m), None if m is None else float(m), None
    if kind == "payday":
        return "day", single(paydays(text)), None, None
    if kind in ("place", "text"):
        norm = condition_text(text, kind == "place")
        return norm, norm, None, None
    if kind == "employment":
        return "form", ",".join(k for k, p in K.EMPLOYMENT_KINDS if says(p, text)) or None, None, None
    if kind == "term":
        return "term", term, None, None
    if kind == "period":
        return *period(text), None, None
    if kind == "probation":
        return "probation", "none" if negated else "applies", None, None
    if kind == "duration":
        d = single([(_whole(n), unit) for n, unit in groups(K.DURATION, text, 1, 2)])
        return (d[1], None if d[0] is None else str(d[0]), None if d[0] is None else float(d[0]), None) if d else NONE
    percent, amount = single([float(p) for (p,) in groups(K.PERCENT, text, 1)]), single(amounts(text))
    return ("percent" if percent is not None else "amount" if amount is not None else None, number_text(percent) or (None if amount is None else str(amount)),
            percent if percent is not None else None if amount is None else float(amount), None)
