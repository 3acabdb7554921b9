"""Cost-balanced packing.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``: projections grow with its length, attention with the square. Pieces are dealt in
descending order, each to the sequence of lowest cost that still has room for it. If none has, the one with most room is filled and the
piece's rest takes its place in the order. The room of all sequences is exactly the number of tokens (the last partial sequence
is a sum of powers of two), so nothing is padded, and a document is cut only where it would otherwise leave a gap.

Only lengths matter, and there are fewer than ``SEQUENCE`` of them: the driver plans on their histogram, moving all pieces of one length
over all sequences of one state at once. Pieces are numbered within their length (their number in the task that made them plus the numbers of
earlier tasks), and the number says which sequence and place a piece gets. Pieces of full length are sequences of their own at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factsieve.llm.common import table, written
from factsieve.llm.packing import STEP_BYTES, _ranges, _word_ids, by_bytes

SEQUENCE = 2048
#: Cost of a token, and of a pair of tokens: six times the width of a model of 1024 units against one.
LINEAR, QUADRATIC = 6 * 1024, 1


def cost_of(n, linear: int = LINEAR, quadratic: int = QUADRATIC):
    return linear * n + quadratic * n * n


def pieces(docs: DataFrame, tokenizer: str, length: int = SEQUENCE) -> DataFrame:
    """doc_id, doc_tokens, start, length, ids_crc32, part, rank and the ids of pieces that are shorter than ``length``.

    ``rank`` numbers the pieces of one length within one task's ``part``.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "doc_tokens", "start", "length", "ids_crc32", "part", "rank")] + [("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = _word_ids(tokenizer), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        narrow = "<u2" if len(words.ends) <= 1 << 16 else "<u4"
        for batch in batches:
            texts = batch.column(1)
            for i, j in by_bytes(texts, STEP_BYTES):
                ids, sizes = words.encode(pc.fill_null(texts.slice(i, j - i), ""))
                n = -(-sizes // length)
                row = np.repeat(np.arange(j - i), n)
                start = _ranges(np.zeros(len(n), np.int64), n).astype(np.int64) * length
                size = np.minimum(length, sizes[row] - start)
                at = (np.cumsum(sizes) - sizes)[row] + start
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
                kept = [ids[a:b].astype(narrow).tobytes() if b - a < length else None for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
                order = np.argsort(size, kind="stable")
                ordered = size[order]
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(size, minlength=length + 1)
                columns = [batch.column(0).slice(i, j - i).take(pa.array(row)), sizes[row], start, size, crc, np.full(len(row), part), rank, kept]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    fields = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in schema)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, fields)


def plan_sequences(histogram: dict[int, int], length: int = SEQUENCE, linear: int = LINEAR, quadratic: int = QUADRATIC) -> np.ndarray:
    """Rows (length, first number, how many, tokens taken, first sequence, place there, number of the first rest).

    ``how many`` pieces of the length, numbered from ``first number`` on, go one each to as many sequences. What is not taken of them
    is a shorter piece, numbered from ``number of the first rest`` on within its own length.
    """
    total = sum(k * v for k, v in histogram.items())
    rooms = [(length, total // length)] + [(1 << b, 1) for b in range(length.bit_length(), -1, -1) if (total % length) >> b & 1]
    room, many = (np.array(x, np.int64) for x in zip(*rooms, strict=True))
    capacity, cost, first = room.copy(), np.zeros(len(room), np.int64), np.cumsum(many) - many
    count, out = np.zeros(length + 1, np.int64), []
    for size, n in histogram.items():
        count[size] = n
    for size in range(length, 0, -1):
        done = 0
        while done < count[size]:
            open_ = many > 0
            fits = open_ & (room >= size)
            if fits.any():
                k, take = int(np.argmin(np.where(fits, cost, np.iinfo(np.int64).max))), size
            else:
                widest = open_ & (room == room[open_].max())
                k = int(np.argmin(np.where(widest, cost, np.iinfo(np.int64).max)))
                take = int(room[k])
            n = int(min(many[k], count[size] - done))
            out.append((size, done, n, take, first[k], capacity[k] - room[k], count[size - take]))
            if take < size:
                count[size - take] += n
            done += n
            state = (room[k] - take, cost[k] + cost_of(take, linear, quadratic), capacity[k], first[k], n)
            many[k] -= n
            first[k] += n
            if state[0]:
                if many[k]:
                    room, cost, capacity, first, many = (np.append(a, v) for a, v in zip((room, cost, capacity, first, many), state, strict=True))
                else:
                    room[k], cost[k], capacity[k], first[k], many[k] = state
    return np.array(sorted(out), np.int64).reshape(-1, 7)


def pack(parts: DataFrame, length: int = SEQUENCE, linear: int = LINEAR, quadratic: int = QUADRATIC) -> DataFrame:
    """The pieces of ``parts`` (a table made by ``pieces``; it is read twice) with sequence_id and offset, cut further where the plan says so.

    The histogram of lengths and the plan (a few rows a length) pass the driver, nothing else.
    """
    rest = parts.where(F.col("length") < length)
    cells = rest.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_sequences(histogram, length, linear, quadratic)
    key = plan[:, 0] * (1 << 44) + plan[:, 1]  # 17 million million pieces of one length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = rest.join(cells, ["part", "length"]).select("doc_id", "doc_tokens", "start", "length", "ids_crc32", "ids", (F.col("rank") + F.col("earlier")).alias("number"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, ids = batch.column("doc_id"), batch.column("ids")
            tokens, start, size, crc, number = (batch.column(c).to_numpy() for c in ("doc_tokens", "start", "length", "ids_crc32", "number"))
            row, cut = np.arange(len(doc)), np.zeros(len(doc), np.int64)  # where the current rest starts in its piece
            while len(row):
                k = np.searchsorted(key, size * (1 << 44) + number, side="right") - 1
                take, since = plan[k, 3], number - plan[k, 1]
                check = crc[row].copy()
                for t in np.flatnonzero((cut > 0) | (take < size)).tolist():
                    raw = ids[int(row[t])].as_py()
                    piece = np.frombuffer(raw, "<u2" if len(raw) == 2 * (size[t] + cut[t]) else "<u4")[cut[t] : cut[t] + take[t]]
                    check[t] = zlib.crc32(piece.astype("<u4").tobytes())
                columns = [start[row] + cut, take, check, tokens[row], plan[k, 4] + since, plan[k, 5]]
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), *map(pa.array, columns)], names=names)
                more = take < size
                row, cut, number, size = row[more], (cut + take)[more], (plan[k, 6] + since)[more], (size - take)[more]

    alone = parts.where(F.col("length") == length).select(*names[:5], (-(F.col("part") * (1 << 33) + F.col("rank")) - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.mapInArrow(place, ", ".join(f"{c} long" for c in names)).unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE, linear: int = LINEAR, quadratic: int = QUADRATIC) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``END_ID``; null and empty texts are that id alone. Sequences are filled without gaps from 0, all of them to ``length``
    but for a few whose lengths are different powers of two. Rows that are repeated or have no id are packed each for itself; equal lengths are
    dealt in the order of tasks and rows; an empty table gives no rows; other columns are ignored. A text is tokenized as a whole by one
    task, so its ids (4 bytes a token) have to fit there.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    return pack(written(pieces(docs, tokenizer, length), "cost-pieces"), length, linear, quadratic)


def op12_cost_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
