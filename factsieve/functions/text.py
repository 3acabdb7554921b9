"""Text normalisation as Spark column expressions."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from factsieve.functions.arrays import let

# The white space characters that count as a space.
# Written so that both the JVM's and other regular expression engines accept them.
SPACE_CHARS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = f"[{SPACE_CHARS}]"


def portable(pattern: str) -> str:
    """Expand ``\\s`` and ``\\S`` so that no-break and wide spaces match as well."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(SPACE_CHARS if in_class else SPACE)
        elif pair == r"\S" and not in_class:
            out.append(f"[^{SPACE_CHARS}]")
        elif pair[:1] == "\\":
            out.append(pair)
        else:
            in_class = (in_class or pair[0] == "[") and pair[0] != "]"
            out.append(pair[0])
            i += 1
            continue
        i += 2
    return "".join(out)


@lru_cache(maxsize=1024)
def compiled(pattern: str) -> re.Pattern:
    """``pattern`` for Python's engine, so that ``search`` finds what ``matches`` does: the same digits, white space and line ends."""
    spelled = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), portable(pattern))
    out, in_class = [], False
    for part in re.findall(r"\\.|[^\\]", spelled, re.DOTALL):
        if not in_class and part == ".":
            part = "[^\n\r\x85\u2028\u2029]"
        elif not in_class and part == "$":
            part = "(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z)"
        else:
            in_class = (in_class or part == "[") and part != "]"
        out.append(part)
    return re.compile("".join(out), re.ASCII)


def matches(col: Column, pattern: str) -> Column:
    return F.rlike(col, F.lit(portable(pattern)))


def replace(col: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(col, portable(pattern), by)


def extract_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(portable(pattern)), F.lit(group))


def trim_space(col: Column) -> Column:
    return replace(col, r"^\s+|\s+$")


def norm_ws(col: Column) -> Column:
    """Runs of white space become one blank; edges are trimmed."""
    return F.trim(replace(col, r"\s+", " "))


def squeeze(col: Column) -> Column:
    return replace(col, r"\s+")


def count_chars(col: Column) -> Column:
    return F.length(squeeze(col))


def has_text(col: Column) -> Column:
    return matches(col, r"\S")


def tidy_text(col: Column) -> Column:
    """Blank edges off every line, at most one empty line in a row, trimmed."""
    unix = F.regexp_replace(col, r"\r?\n", "\n")
    edges = F.regexp_replace(unix, r"(?md)^[ \t\x{A0}]+|[ \t\x{A0}]+$", "")
    return trim_space(F.regexp_replace(edges, r"\n{3,}", "\n\n"))


def strip_ocr_junk(col: Column) -> Column:
    """Drop stand-alone frame fragments; keep signs attached to other characters."""
    alone = F.regexp_replace(col, r"(?md)(^|[ \t])[_|¦、]+(?=[ \t]|$)", "$1")
    return F.regexp_replace(alone, r"[ \t]{2,}", " ")


def clip(col: Column, n: int = 60) -> Column:
    return let(norm_ws(F.coalesce(col, F.lit(""))), lambda flat: F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat))


def as_digits(col: Column) -> Column:
    """Letters that look like digits, next to a digit, read as digits. For matching only."""
    out = F.regexp_replace(col, r"(?<=\d)[Oo]|[Oo](?=\d)", "0")
    out = F.regexp_replace(out, r"(?<=\d)[Il|]|[Il|](?=\d)", "1")
    return F.regexp_replace(out, r"(?<=\d)S|S(?=\d)", "5")


def josa(col: Column, with_final: str, without: str) -> Column:
    """Append the particle that fits the final consonant of the last Hangul syllable."""
    code = F.ascii(F.right(col, F.lit(1))) - F.lit(0xAC00)
    closed = code.between(0, 11171) & (code % 28 != 0)
    return F.concat(col, F.when(closed, F.lit(with_final)).otherwise(F.lit(without)))


def josa_of(word: str, with_final: str, without: str) -> str:
    """``josa`` of one word."""
    code = ord(word[-1]) - 0xAC00
    return word + (with_final if 0 <= code <= 11171 and code % 28 else without)


def normalize_condition_text(col: Column, place: bool = False) -> Column:
    """Spelling-independent form of a condition: no leading label, blanks or punctuation."""
    out = replace(F.coalesce(col, F.lit("")), r"^[^:：\n]{1,15}[:：]\s*")
    if place:
        # Administrative suffixes that do not change which place is meant
        out = F.regexp_replace(out, "(특별자치시|특별자치도|특별시|광역시)", "")
        out = F.regexp_replace(out, "(경기|강원|충청북|충청남|전라북|전라남|경상북|경상남|제주)도", "$1")
    return F.lower(replace(out, r"[\s.,·()\[\]{}'\"“”‘’\-–~/]"))


def scrub_log(col: Column, limit: int = 300) -> Column:
    """Take key-like values out of a provider message and shorten it."""
    # Shapes of credentials
    out = F.regexp_replace(col, r"AIza[0-9A-Za-z_-]{10,}", "[REDACTED_KEY]")
    out = replace(out, r"(?i)([?&]key=)[^&\s\"]+", "$1[REDACTED]")
    return F.substring(norm_ws(out), 1, limit)


def char_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, blanks ignored; two empty texts are equal."""
    x, y = squeeze(a), squeeze(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(x, y) / longest)


def contains(text: Column, part: Column) -> Column:
    return F.contains(text, part)
