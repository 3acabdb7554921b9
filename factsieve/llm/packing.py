"""Best-fit packing by minimum bin slack.

Token sequences are packed by their lengths alone, and there are at most ``SEQUENCE`` different lengths whatever the corpus.
So the plan is made on the histogram of lengths: per bin, the longest piece left is set and a bitset subset-sum over
the lengths left finds the fullest feasible rest; that combination is removed as often as the histogram allows at once. Pieces are then
numbered within their length, and the number says which bin and place a piece gets. No task sees all pieces.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factsieve.llm.common import table, written

SEQUENCE = 4096
END_ID = 1
#: Numbering of pieces of one length is split in so many parts.
PARTS = 64
#: Text that one step of a task tokenizes, and the size of the words and ids a worker remembers (about 120 bytes a word beside its letters).
STEP_BYTES, REMEMBERED_BYTES = 2 << 20, 96 << 20
#: Lower-case words of the Latin range: one word is one pre-token, a mark after it another.
PLAIN = re.compile(r"([a-zà-öø-ÿ]+)([.,]?)")


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _word_tokenizer(whole):
    """The same vocabulary for lower-case words with blanks between them: nothing to normalise, nothing to split but at the blanks."""
    from tokenizers import Tokenizer, pre_tokenizers

    words = Tokenizer(whole.model)
    words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
    return words


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), first[1], ... one after the other."""
    step = np.repeat((first - np.cumsum(counts) + counts).astype(np.int32 if len(first) and first[-1] < 1 << 30 and counts.sum() < 1 << 30 else np.int64), counts)
    step += np.arange(len(step), dtype=step.dtype)
    return step


class WordIds:
    """Ids of the blank-separated parts of texts.

    The tokenizer drops white space and never joins what stands on both sides of it, so a text's ids are those of its
    parts, one after the other. Each distinct part is encoded once; plain words are encoded many at a call and cut apart again at the ends
    of pre-tokens, which the vocabulary marks.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.word_tokenizer = _word_tokenizer(self.tokenizer)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in (".", ",")}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.used = self.letters = 0

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(words)] = counts
        self.used += len(ids)
        self.letters += sum(map(len, words))
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _add_plain(self, found: list[re.Match]) -> None:
        bases = list(dict.fromkeys(m[1] for m in found))
        blocks = [" ".join(bases[i : i + 2000]) for i in range(0, len(bases), 2000)]
        ids = np.concatenate([np.array(out.ids, np.uint32) for out in self.word_tokenizer.encode_batch_fast(blocks, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        base_first = np.concatenate([[0], ends[:-1]])
        row = dict(zip(bases, range(len(bases)), strict=True))
        base = np.fromiter((row[m[1]] for m in found), np.int64, len(found))
        marks = [self.marks.get(m[2], []) for m in found]
        inner, extra = (ends - base_first)[base], np.fromiter(map(len, marks), np.int64, len(marks))
        counts = inner + extra
        last = np.cumsum(counts)
        flat = np.zeros(last[-1], np.uint32)
        flat[_ranges(last - counts, inner)] = ids[_ranges(base_first[base], inner)]
        flat[_ranges(last - extra, extra)] = [i for m in marks for i in m]
        self._add([m[0] for m in found], flat, counts)

    def rows(self, words: list[str]) -> np.ndarray:
        if 120 * len(self.known) + self.letters > REMEMBERED_BYTES:
            self.forget()
        new = [w for w in words if w not in self.known]
        found = [PLAIN.fullmatch(w) for w in new]
        plain = [m for m in found if m]
        if plain:
            self._add_plain(plain)
        other = [w for w, m in zip(new, found, strict=True) if not m]
        if other:
            lists = [out.ids for out in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            counts = np.array([len(x) for x in lists])
            self._add(other, np.array([i for x in lists for i in x], np.uint32), counts)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's closed by ``END_ID``, and the number of ids of each text."""
        special = pc.match_substring(texts, "<|")  # strings of special tokens are told apart by case
        parts = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        words = parts.flatten().dictionary_encode()
        rows = self.rows(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        counts = self.count[rows].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        per_text = np.diff(ends[at])
        out = np.full(ends[-1] + len(texts), END_ID, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(per_text + 1) - 1] = False
        out[inner] = self.ids[_ranges(self.first[rows], counts)]
        return out, per_text + 1


@functools.lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def by_bytes(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(column):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right"))
        j = max(j, i + 1)
        yield i, j
        i = j


def pieces(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece; null texts are empty, so one end id."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def cut(batches):
        words = _word_ids(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for i, j in by_bytes(texts, STEP_BYTES):
                ids, sizes = words.encode(pc.fill_null(texts.slice(i, j - i), ""))
                doc_start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                n = -(-sizes // length)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * length
                size = np.minimum(length, sizes[row] - start)
                at = doc_start[row] + start
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = np.fromiter((zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at + size, strict=True)), np.int64, len(row))
                columns = [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, schema)


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """A combination of the available lengths (length to count) with the largest sum up to ``room``; long ones first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in sorted((x for x in available if x <= room), reverse=True):
        left, lot = min(available[size], room // size), 1
        while left:
            lot = min(lot, left)
            steps.append((size, lot, reach))
            reach |= (reach << (size * lot)) & mask
            left -= lot
            lot *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for size, lot, before in reversed(steps):
        if not before >> total & 1:
            total -= size * lot
            chosen[size] = chosen.get(size, 0) + lot
    return chosen


def plan_bins(histogram: dict[int, int], length: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, how many a bin, place of the first, first bin) for ranges of numbers of each length."""
    left = {k: v for k, v in histogram.items() if v > 0}
    used, out, bins = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest({k: v for k, v in left.items() if v}, length - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times, place = min(left[k] // v for k, v in chosen.items()), 0
        for size in sorted(chosen, reverse=True):
            out.append((size, used[size], chosen[size], place, bins))
            place += size * chosen[size]
            used[size] += times * chosen[size]
            left[size] -= times * chosen[size]
            if not left[size]:
                del left[size]
        bins += times
    return out


def pack(parts: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...; a table, it is read twice) with sequence_id and offset.

    Sequences are filled without gaps from 0. Only the histogram of lengths (``length`` rows at most) and the plan drawn from
    it reach the driver. Equal rows are packed one by one. An empty table gives no rows.
    """
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(sorted(plan_bins(histogram, length)), np.int64).reshape(-1, 5)
    key = plan[:, 0] * (1 << 44) + plan[:, 1]  # ordered by length and number: 17 million million pieces of one length

    cell = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS))
    p = parts.withColumn("cell", cell)
    inner = Window.partitionBy("length", "cell").orderBy("doc_id", "piece")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = p.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")).select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    p = p.withColumn("number", F.row_number().over(inner) - 1).join(starts, ["length", "cell"]).withColumn("number", F.col("number") + F.col("first"))
    p = p.select(*parts.columns, "number")
    schema = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes) + ", sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            size, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            k = np.searchsorted(key, size * (1 << 44) + number, side="right") - 1
            since = number - plan[k, 1]
            many = plan[k, 2]
            columns = [batch.column(c) for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(plan[k, 4] + since // many), pa.array(plan[k, 3] + since % many * size)],
                                             names=[*(c for c in batch.schema.names if c != "number"), "sequence_id", "offset"])

    return p.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (see ``pieces``) and their sequences. Other columns are ignored; repeated rows are packed each."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    return pack(written(pieces(docs, tokenizer, length, with_ids), "pieces"), length)


def op5_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
