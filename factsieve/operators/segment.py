"""Documents to numbered lines.

A document is one row, so its lines are worked out inside that row: no shuffle, whatever the size of the corpus. Where lines start is one
sorted list of positions, found in one pass over the text, so the cost is linear in the text. ``explode_lines`` turns the array into a line table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.arrays import unnest
from factsieve.functions.literals import STEP_CHARS, byte_sizes, row_steps
from factsieve.functions.text import SPACE_CHARS

# A line longer than this is split, and where it may be split
LONG_LINE = 100
SPLIT_POINT = r"(?<=[^\d\s][.!?。])\s+|\s+(?=[•■▶※□◆●○]\s?)"

LINE = pa.struct([("line_no", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


@lru_cache(maxsize=1)
def _space() -> str:
    """The white space characters of ``SPACE_CHARS`` as they are."""
    spelled = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), SPACE_CHARS)
    return "".join(chr(i) for i in range(0x10000) if re.fullmatch(f"[{spelled}]", chr(i)))


@lru_cache(maxsize=1)
def _split_point() -> re.Pattern:
    return re.compile(SPLIT_POINT.replace(r"[^\d\s]", f"[^0-9{_space()}]").replace(r"\s", f"[{_space()}]"))


def line_spans(text: str, limit: int) -> list[tuple[int, int]]:
    """Start and end of every line with something on it: rows of the text, long ones cut at sentence ends and before bullets."""
    space, split, spans, start = _space(), _split_point(), [], 0
    for row in text.split("\n"):
        cuts = [(0, 0)]
        if len(row.removesuffix("\r")) > limit:
            cuts += [m.span() for m in split.finditer(row.removesuffix("\r"))]
        for (_, a), b in zip(cuts, [*(c[0] for c in cuts[1:]), len(row)], strict=True):
            part = row[a:b]
            left = part.lstrip(space)
            if left:
                a += len(part) - len(left)
                spans.append((start + a, start + a + len(left.rstrip(space))))
        start += len(row) + 1
    return spans


def cut_lines(texts: pa.StringArray, limit: int) -> pa.ListArray:
    """The lines of texts, as ``line_spans`` cuts them: all rows of a step at once, only long rows one by one."""
    rows = pc.split_pattern(texts, "\n")
    count = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = rows.flatten()
    size = _sizes(piece)
    start = np.cumsum(size + 1) - size - 1
    doc = np.repeat(np.arange(len(texts)), count)
    start -= np.append(start, 0)[np.cumsum(count) - count][doc]  # counts from the start of its text
    long = np.flatnonzero(size > limit)
    if len(long):
        parts, at, many = [], [], np.ones(len(piece), np.int64)
        for i, row in zip(long.tolist(), piece.take(pa.array(long)).to_pylist(), strict=True):
            spans = line_spans(row, limit)
            parts += [row[a:b] for a, b in spans]
            at += [a for a, _ in spans]
            many[i] = len(spans)
        take = np.repeat(np.arange(len(piece)), many)
        own = size[take] > limit
        doc, start = doc[take], start[take]
        start[own] += np.array(at, np.int64)
        take[own] = len(piece) + np.arange(len(parts))
        piece = pa.concat_arrays([piece, pa.array(parts, pa.string())]).take(pa.array(take))
        size = _sizes(piece)
    left = pc.utf8_ltrim(piece, characters=_space())
    start += size - _sizes(left)
    text = pc.utf8_rtrim(left, characters=_space())
    size = _sizes(text)
    kept = np.flatnonzero(size)
    doc, start, size = doc[kept], start[kept], size[kept]
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    lines = pa.StructArray.from_arrays(
        [pa.array(np.arange(len(kept)) - ends[doc] + 1, pa.int32()), text.take(pa.array(kept)), pa.array(start, pa.int32()), pa.array(start + size, pa.int32())],
        fields=list(LINE))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines, mask=pc.is_null(texts))


def _sizes(texts: pa.StringArray) -> np.ndarray:
    return pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def lines_column(text: Column, limit: int = LONG_LINE) -> Column:
    """array<struct<line_no,text,start,end>>; offsets are half open, in characters of ``text``. Null for a null text."""

    @F.arrow_udf("array<struct<line_no:int,text:string,start:int,end:int>>")
    def cut(texts: pa.Array) -> pa.Array:
        steps = [texts.slice(i, j - i) for i, j in row_steps(byte_sizes(texts), STEP_CHARS)]
        return pa.concat_arrays([cut_lines(part, limit) for part in steps or [texts]])

    return cut.asNondeterministic()(text)  # worked out once, wherever the lines are used


def stands(text: str, starts: list[int], ends: list[int], parts: list[str]) -> bool:
    """Whether each part stands in its place, one after the other, with nothing but white space around them."""
    space, at = _space(), 0
    for a, b, part in zip(starts, ends, parts, strict=True):
        if a < at or text[a:b] != part or text[at:a].strip(space):
            return False
        at = b
    return not text[at:].strip(space)


def lines_stand(text: Column, lines: Column) -> Column:
    """Whether the lines are the parts of ``text`` that their offsets name and nothing is lost between them; in time linear in the text."""

    @F.arrow_udf("boolean")
    def stand(texts: pa.Array, starts: pa.Array, ends: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for i, j in row_steps(byte_sizes(texts), STEP_CHARS):
            rows = zip(*(c.slice(i, j - i).to_pylist() for c in (texts, starts, ends, parts)), strict=True)
            out += [None if t is None or x is None else stands(t, s, e, x) for t, s, e, x in rows]
        return pa.array(out, pa.bool_())

    return stand(text, lines["start"], lines["end"], lines["text"])


def with_lines(docs: DataFrame, text: str = "text", limit: int = LONG_LINE) -> DataFrame:
    return docs.withColumn("lines", lines_column(F.col(text), limit))


def explode_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """The line table: one row per line."""
    return unnest(docs, "lines", *keep, present="line_no")


def segment(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return explode_lines(with_lines(docs), key)


def numbered_text(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One text per document with a number before each line."""
    body = F.array_join(
        F.transform("lines", lambda l: F.concat(F.lit("["), l["line_no"].cast("string"), F.lit("] "), l["text"])), "\n"
    )
    return docs.select(key, body.alias("text"))


def clean_corpus(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Tidied documents and their lines in one narrow pass."""
    tidy = docs.withColumn("text", tidy_text(strip_ocr_junk(F.col("text"))))
    return tidy, segment(tidy, key)
