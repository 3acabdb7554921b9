"""Periodic run detection by block convolution.

A run is a stretch of words with smallest period q and at least two periods that no neighbouring word extends. At the scale of
blocks of B words, every run of period 2B-1 to 4B-2 holds an aligned block of B words together with its copy one period later. So each block
is laid over the window that starts 2B-1 words later: the sums of squared differences at all distances come from one number-theoretic
transform, exactly, modulo a prime. A sum of zero is a place where the block may occur again, the distance is the seed of a period, and
comparing the words to both sides of it gives the run (or refutes the few sums that are zero modulo the prime only, so nothing is missed and
nothing is wrongly kept). Blocks with a word that does not return within the window cannot occur again and need no transform.

The transform is a product with the matrix of the roots of unity, in two steps for long windows: whole numbers below 2^53 are exact in the
floating-point product. Windows longer than ``TRANSFORM`` words are cut with an overlap, so memory is bounded by the words of one text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm.common import BLANK_CHARS, BLANKS, table
from factsieve.llm.packing import by_bytes

#: Prime with roots of unity of order 2^18; a root of all its residues.
PRIME, GENERATOR = 786433, 10
#: Longest transform, and words that one step of transforms holds.
TRANSFORM, STEP_WORDS = 1 << 16, 1 << 18
#: Text that one step of a task looks at (one text at least).
STEP_BYTES = 2 << 20
#: Shortest run.
LEAST_WORDS = 12


def _mod(x: np.ndarray) -> np.ndarray:
    """Residues around zero of whole numbers below 2^53."""
    return x - np.rint(x * (1.0 / PRIME)) * PRIME


@functools.lru_cache(maxsize=None)
def _roots(n: int, sign: int, rows: int, columns: int) -> np.ndarray:
    """w^(sign * i * j) for a root w of order n."""
    w = pow(GENERATOR, sign * (PRIME - 1) // n % (PRIME - 1), PRIME)
    powers = np.ones(n, np.int64)
    for i in range(1, n):
        powers[i] = powers[i - 1] * w % PRIME
    return _mod(powers[np.outer(np.arange(rows), np.arange(columns)) % n].astype(np.float64))


def _split(n: int) -> tuple[int, int]:
    rows = 1 << (n.bit_length() // 2)
    return (1, n) if n <= 128 else (rows, n // rows)


def transform(x: np.ndarray, sign: int = 1) -> np.ndarray:
    """Transform of each row, its values in the order (column of the first step, column of the second)."""
    k, n = x.shape
    r, c = _split(n)
    if r == 1:
        return _mod(x @ _roots(n, sign, n, n))
    y = _mod(_mod(np.matmul(_roots(r, sign, r, r), x.reshape(k, r, c))) * _roots(n, sign, r, c))
    return _mod(y @ _roots(c, sign, c, c)).reshape(k, n)


def inverse(y: np.ndarray) -> np.ndarray:
    k, n = y.shape
    r, c = _split(n)
    scale = pow(n, -1, PRIME)
    if r == 1:
        return _mod(_mod(y @ _roots(n, -1, n, n)) * scale)
    x = _mod(_mod(y.reshape(k, r, c) @ _roots(c, -1, c, c)) * _roots(n, -1, r, c))
    return _mod(_mod(np.matmul(_roots(r, -1, r, r), x)) * scale).reshape(k, n)


def zero_mismatches(ids: np.ndarray, blocks: np.ndarray, size: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of a block, distance) wherever the words of a block, modulo the prime, stand again ``least`` to ``most`` words later.

    Of a block that is longer than a transform takes, its head is looked for.
    """
    head = min(size, TRANSFORM // 4)
    n = 4 * head
    span = n - head + 1  # distances that one transform decides
    starts, found = [], []
    for i in range(0, len(blocks), max(1, STEP_WORDS // n)):
        at = blocks[i : i + max(1, STEP_WORDS // n)]
        x = np.zeros((len(at), n))
        x[:, :head] = _mod(ids[at[:, None] + np.arange(head)].astype(np.float64))
        own, spectrum = _mod(_mod(x * x).sum(1)), transform(x, -1)
        for low in range(least, most + 1, span):
            window = at[:, None] + low + np.arange(n)
            y = _mod(ids[np.minimum(window, len(ids) - 1)].astype(np.float64))
            product = inverse(_mod(spectrum * transform(y)))
            squares = np.concatenate([np.zeros((len(at), 1)), np.cumsum(_mod(y * y), axis=1)], axis=1)
            wide = min(span, most + 1 - low)
            total = own[:, None] + squares[:, head : head + wide] - squares[:, :wide] - 2 * product[:, :wide]
            b, d = np.nonzero(_mod(total) == 0)
            starts.append(at[b])
            found.append(d + low)
    return (np.concatenate(starts), np.concatenate(found)) if starts else (np.zeros(0, np.int64),) * 2


def _agreeing(ids: np.ndarray, i: int, d: int, step: int, most: int) -> int:
    """How many of up to ``most`` words from i on, in the direction of ``step``, equal those d later."""
    done, chunk = 0, 32
    while done < most:
        n = min(chunk, most - done)
        a = i + step * done
        x, y = (ids[a : a + n], ids[a + d : a + d + n]) if step > 0 else (ids[a - n + 1 : a + 1][::-1], ids[a + d - n + 1 : a + d + 1][::-1])
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done, chunk = done + n, chunk * 2
    return done


def runs_of(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in texts that stand one after the other in ``ids``.

    Text t has ``size[t]`` words from ``first[t]`` on; behind each text stands a number that occurs nowhere else, so no run crosses it.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    returns = np.full(n, np.iinfo(np.int64).max)  # distance of the word's next occurrence
    same = ids[order[1:]] == ids[order[:-1]]
    returns[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs: dict[tuple[int, int], int] = {}
    cover_end, cover_period = np.zeros(n, np.int64), np.ones(n, np.int64)
    block, least, most = 2, 1, 6
    while True:
        usable = size >= max(LEAST_WORDS, 2 * least)
        if not usable.any():
            break
        many = np.where(usable, (size - least) // block, 0)
        index = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        blocks = np.repeat(first, many) + index * block
        gone = np.concatenate([[0], np.cumsum(returns > most)])
        blocks = blocks[gone[blocks + block] == gone[blocks]]
        at, distance = zero_mismatches(ids, blocks, block, least, most)
        inside = at + block + distance <= (first + size)[np.searchsorted(first, at, side="right") - 1]
        at, distance = at[inside], distance[inside]
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        for d in np.unique(distance):
            d = int(d)
            a = at[np.searchsorted(distance, d) : np.searchsorted(distance, d, side="right")]
            # what lies in a run whose period divides the distance tells nothing new
            a = a[(cover_end[a] < a + block + d) | (d % cover_period[a] != 0)]
            i = 0
            while i < len(a):
                seed = int(a[i])
                right = seed + _agreeing(ids, seed, d, 1, n - d - seed)
                left = seed - _agreeing(ids, seed - 1, d, -1, seed)
                end = right + d
                if right - seed >= min(block, TRANSFORM // 4) and end - left >= max(LEAST_WORDS, 2 * d) and (left, end) not in runs:
                    runs[left, end] = d
                    stretch = slice(left, end)
                    nearer = cover_end[stretch] < end
                    cover_period[stretch][nearer] = d
                    cover_end[stretch][nearer] = end
                i = max(i + 1, int(np.searchsorted(a, right)))
        block, least, most = 2 * block, 4 * block - 1, 8 * block - 2
    return [(s, e - s, q) for (s, e), q in sorted(runs.items(), key=lambda r: (r[0][0], r[1]))]


RUNS = "array<struct<start:long,length:long,period:long>>"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (ordered by start, then period) and the text with every run collapsed to its first period, a row a row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0; the collapsed text joins the kept ones by one blank. Of overlapping
    runs each drops what it holds after its own first period. Null and empty texts have no words, no runs and an empty collapsed text; rows that are
    repeated or have no id are answered each for itself; an empty table gives no rows; other columns of ``docs`` are ignored, whatever their
    names. Nothing is shuffled. A text is one task's work: n words take n log(n)^2 steps at most and about 200 bytes a word.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])

    def step(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        bare = pc.utf8_trim(pc.fill_null(texts, ""), characters=BLANK_CHARS)
        parts = pc.ascii_split_whitespace(bare)
        ends = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        blank = pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
        count = np.where(blank, 0, np.diff(ends))
        docs_at = ends[:-1] + np.arange(len(count))  # a closing number follows each text
        flat = np.empty(ends[-1] + len(count), np.int64)
        closing = ends[1:] + np.arange(len(count))
        flat[closing] = len(words.dictionary) + np.arange(len(count))
        inner = np.ones(len(flat), bool)
        inner[closing] = False
        flat[inner] = words.indices.to_numpy()
        runs = np.array(runs_of(flat, docs_at, count), np.int64).reshape(-1, 3)
        owner = np.searchsorted(docs_at, runs[:, 0], side="right") - 1
        drop = np.zeros(len(flat) + 1, np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
        kept = (np.cumsum(drop)[:-1] == 0)[inner]
        kept_ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_ends, pa.int32()), parts.flatten().filter(pa.array(kept))), " ")
        found = pa.StructArray.from_arrays([pa.array(runs[:, 0] - docs_at[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
        offsets = pa.array(np.searchsorted(owner, np.arange(len(count) + 1)), pa.int32())
        return pa.RecordBatch.from_arrays([ids, pa.array(count), pa.ListArray.from_arrays(offsets, found), collapsed], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in by_bytes(batch.column(1), STEP_BYTES):
                yield step(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(search, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """The text, for about a tenth of the ids with its tail replaced by repetitions of the tail's head."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.split(F.btrim(text, F.lit(BLANK_CHARS)), BLANKS)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    unit = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    some = F.btrim(text, F.lit(BLANK_CHARS)) != ""
    return F.when((h % 10 == 0) & some, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    key = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    best = F.array_min(F.transform("runs", key))
    rows = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(rows, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("b.l"), F.col("b.p")
    return found.select("doc_id", "n_runs", F.col("b.s").alias("start"), length.alias("length"), period.alias("period"),
                        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
