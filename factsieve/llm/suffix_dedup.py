"""Suffix-array dedup: removal of every byte that a repeated 400-byte string covers.

Where a repeated string can start is found first. Every window of ``WINDOW`` bytes has a least hash among its ``ANCHOR``-byte
strings; equal windows have it at the same place. So windows with one anchor form a segment, and only segments whose anchors meet elsewhere can
hold repeats. Segments of equal content are one, with a count.

The segments that meet are sorted in parts by two-stage suffix sorting: suffixes smaller than their successors are sorted directly,
the others follow by scanning the sorted buckets: the predecessor of a suffix goes to the next free place of its own bucket. Neighbours in the suffix
array whose common prefix is as long as the window are repeats; the text itself is compared, not its hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.common import bit_table, table, that_may_be_in, written
from factsieve.llm.packing import by_bytes
from factsieve.llm.shingles import _BASE, _BYTE, _INVERSE, mixed, powers, text_bytes

WINDOW, ANCHOR = 400, 128
#: Text whose segments are found at once; a worker needs about 130 bytes for each byte of it.
STEP_BYTES = 1 << 18
#: Text that one suffix sort takes, and the width of the strips in which a group of segments beyond it is cut.
SORT_BYTES, STRIP = 1 << 18, 32
_EXACT = _BYTE.copy()
_EXACT[65:91] = np.random.default_rng(5).integers(1, 1 << 63, 26, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def segments(texts: pa.Array, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, place of the anchor, hash of the anchor, hash of the content) of each segment of each text."""
    data, at = text_bytes(texts)
    n, width = len(data), window - anchor + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < window:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_EXACT[data] * powers(_BASE, n), out=sums[1:])
    inverse = powers(_INVERSE, n)
    grams = mixed((sums[anchor:] - sums[: n - anchor + 1]) * inverse[: n - anchor + 1])
    count = len(grams)
    place_bits = np.uint64((1 << 32) - 1)  # more than a text can have bytes; grams alike in the bits left are told apart by place
    ranked = np.full(-(-count // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    ranked[:count] = (grams & ~place_bits) | np.arange(count, dtype=np.uint64)
    rows = ranked.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - window + 1
    least = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & place_bits).astype(np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[:starts]
    valid = np.arange(starts) + window <= at[owner + 1]
    change = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])])
    first = np.flatnonzero(change)
    last = np.append(first[1:], starts) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    q = least[first]
    content = (sums[last + window] - sums[first]) * inverse[first]
    content = mixed(content ^ mixed(((q - first) * 4096 + (last - first)).astype(np.uint64)))
    base = at[owner[first]]
    return owner[first], first - base, last - base, q - base, grams[q].view(np.int64), content.view(np.int64)


def _sections(texts: pa.Array, window: int) -> Iterator[tuple[int, int, pa.Array]]:
    """(first text, byte at which it starts, texts) of steps of about ``STEP_BYTES``.

    A longer text is cut in sections that share ``window - 1`` bytes, so that each of its windows is in one of them. A segment that is cut there meets
    its equals by the anchor all the same.
    """
    for i, j in by_bytes(texts, STEP_BYTES):
        part = texts.slice(i, j - i)
        if j - i > 1 or len(raw := text_bytes(part)[0]) <= STEP_BYTES:
            yield i, 0, part
            continue
        for a in range(0, len(raw) - window + 1, STEP_BYTES):
            yield i, a, pa.array([raw[a : a + STEP_BYTES + window - 1].tobytes()], pa.large_binary())


def suffix_array(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Suffixes of a byte text in the order of their first ``depth`` bytes or more, by two-stage sorting."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # a suffix is smaller than its successor if its next different byte is larger; the last one is not, as its successor is empty
    differs = np.append(text[1:] != text[:-1], True)
    next_change = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    after = np.minimum(next_change + 1, n - 1)
    small = (text[after] > text) & (next_change < n - 1)
    raw = text.tobytes()
    direct = np.flatnonzero(small)
    direct = direct[np.argsort(text[direct], kind="stable")]
    by_byte = np.split(direct, np.searchsorted(text[direct], np.arange(1, 256)))
    # a bucket at a time, as each suffix is copied to be compared
    by_byte = [np.array(sorted(bucket.tolist(), key=lambda i: raw[i : i + depth]), np.int64) for bucket in by_byte]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # the suffix of one byte is the first larger one of its bucket
    out = []

    def hand_on(bucket: np.ndarray, byte: int) -> np.ndarray:
        """Predecessors go to their buckets in the order of the scan; those of this very bucket are returned."""
        before = bucket[bucket > 0] - 1
        before = before[~small[before]]
        own = before[text[before] == byte]
        rest = before[text[before] != byte]
        order = np.argsort(text[rest], kind="stable")
        rest = rest[order]
        cuts = np.flatnonzero(np.diff(text[rest])) + 1
        for part in np.split(rest, cuts):
            if len(part):
                waiting[text[part[0]]].append(part)
        return own

    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = hand_on(wave, byte)
        if len(by_byte[byte]):
            out.append(by_byte[byte])
            hand_on(by_byte[byte], byte)
    return np.concatenate(out)


def repeated_windows(parts: list[tuple[bytes, int]], window: int = WINDOW) -> list[np.ndarray]:
    """For each (bytes, windows): which of its windows occur at another place in these parts."""
    raw = b"".join(p for p, _ in parts)
    text = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(p) for p, _ in parts])
    first = np.cumsum(sizes) - sizes
    starts = np.zeros(len(text), bool)
    for a, (_, k) in zip(first, parts, strict=True):
        starts[a : a + k] = True
    order = suffix_array(text, window)
    order = order[starts[order]]
    # common prefixes of neighbours: the ends are compared before the whole
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((text[a + window - 1] == text[b + window - 1]) & (text[a + window // 2] == text[b + window // 2]) & (text[a] == text[b]))
    same = [i for i in near.tolist() if raw[a[i] : a[i] + window] == raw[b[i] : b[i] + window]]
    hit = np.zeros(len(text), bool)
    hit[a[same]] = hit[b[same]] = True
    return [hit[s : s + k] for s, (_, k) in zip(first, parts, strict=True)]


def _by_distance(pieces: list[tuple[bytes, int, list]], block: int, window: int) -> list[np.ndarray]:
    """As ``repeated_windows`` for the pieces (bytes, place of the anchor, owners) of a strip that is too large for one suffix sort.

    Equal windows have their anchor at the same distance, so the windows of one distance are sorted at a time.
    """
    hits = [np.zeros(len(raw) - window + 1, bool) for raw, _, _ in pieces]
    for distance in range(block * STRIP, block * STRIP + STRIP):
        rows = sorted((raw[q - distance : q - distance + window], n) for n, (raw, q, _) in enumerate(pieces) if 0 <= q - distance <= len(raw) - window)
        for (one, n), (other, m) in zip(rows, rows[1:]):
            if one == other:
                hits[n][pieces[n][1] - distance] = hits[m][pieces[m][1] - distance] = True
    return hits


def _in_strips(group: list[tuple[bytes, int, int, int]], window: int) -> list[np.ndarray]:
    """As ``repeated_windows`` for a large group of segments of one anchor: (bytes, windows, place of the anchor, count).

    Windows at about the same distance from the anchor share all but the ends of their text. They are sorted apart from those that do not, and
    equal pieces are sorted once.
    """
    hits = [np.zeros(k, bool) for _, k, _, _ in group]
    batch, size = [], 0

    def settle():
        pieces = [(piece, len(piece) - window + 1) for piece, _, _ in batch]
        for (piece, _, owners), found in zip(batch, repeated_windows(pieces, window), strict=True):
            for g, a in owners:
                hits[g][a : a + len(found)] |= found | (len(owners) > 1)

    # a block after the other, so that of each segment one strip is cut at a time
    for block in range(min((q - k + 1) // STRIP for _, k, q, _ in group), max(q // STRIP for _, _, q, _ in group) + 1):
        strips: dict[bytes, dict[tuple[bytes, int], list[tuple[int, int]]]] = {}
        for g, (raw, k, q, _) in enumerate(group):
            a, b = max(0, q - block * STRIP - STRIP + 1), min(k - 1, q - block * STRIP)
            if a <= b:
                # the stretch that all windows of the strip would share, seen from the anchor
                core = raw[q - block * STRIP : q - block * STRIP - STRIP + 1 + window]
                strips.setdefault(core if len(core) == window - STRIP + 1 else b"", {}).setdefault((raw[a : b + window], q - a), []).append((g, a))
        for strip in strips.values():
            mine = [(piece, q, owners) for (piece, q), owners in strip.items()]
            own = sum(len(p[0]) for p in mine)
            if own > SORT_BYTES:
                for (piece, _, owners), found in zip(mine, _by_distance(mine, block, window), strict=True):
                    for g, a in owners:
                        hits[g][a : a + len(found)] |= found | (len(owners) > 1)
                continue
            if batch and size + own > SORT_BYTES:
                settle()
                batch, size = [], 0
            batch += mine
            size += own
    if batch:
        settle()
    return hits


def _spans(hit: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Covered bytes of the windows that are hit, as runs."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [(int(a), int(b) + window - 1) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """rk, start, end: stretches of bytes to remove, maybe overlapping. ``docs`` is (doc_id, text, rk)."""
    names = ["rk", "lo", "hi", "q", "anchor", "content"]

    def find(batches):
        for batch in batches:
            for i, a, texts in _sections(batch.column(1), window):
                owner, lo, hi, q, anchor, content = segments(texts, window)
                columns = [batch.column(0).take(pa.array(owner + i)), *(pa.array((x + a).astype(np.int32)) for x in (lo, hi, q)), pa.array(anchor), pa.array(content)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = written(docs.select("rk", "text").mapInArrow(find, "rk long, lo int, hi int, q int, anchor long, content long"), "segments")
    kinds = found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rk", "lo", "hi", "q")).alias("at"))
    meet = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("all")).where("all > 1")
    kinds = written(kinds.join(meet.select("anchor", "kinds"), "anchor").select("anchor", "content", "c", "kinds", "at.*"), "kinds")

    # segments that occur twice are repeats as a whole, wherever they occur
    twice = kinds.where("c > 1").select("anchor", "content")
    some = that_may_be_in(found, written(bit_table(twice, "content"), "bits"), "content")
    whole = some.join(twice, ["anchor", "content"], "left_semi").select("rk", F.col("lo").cast("long").alias("start"), (F.col("hi") + window).cast("long").alias("end"))

    # the others of an anchor with several kinds of segments are sorted; one that occurs twice only stands by as a partner
    sorted_kinds = kinds.where("kinds > 1")
    wanted = written(sorted_kinds.groupBy("rk").agg(F.collect_list(F.struct("anchor", "c", "lo", "hi", "q")).alias("parts")), "wanted")
    texts = that_may_be_in(docs.select("rk", "text"), written(bit_table(wanted, "rk"), "bits"), "rk").dropDuplicates(["rk"])

    def cut(batches):
        for batch in batches:
            rows = []
            for rk, text, parts in zip(*batch.columns, strict=True):
                raw = text.as_py().encode()
                for p in parts.as_py():
                    rows.append((p["anchor"], rk.as_py(), p["lo"], p["c"], p["q"] - p["lo"], raw[p["lo"] : p["hi"] + window]))
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds_of, strict=True)], names=cut_names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds_of, strict=True)], names=cut_names)

    cut_names, kinds_of = ["anchor", "rk", "lo", "c", "q", "bytes"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    pieces = texts.join(wanted, "rk").select("rk", "text", "parts").mapInArrow(cut, "anchor long, rk long, lo int, c long, q int, bytes binary")

    def sort_groups(batches):
        batch_rows, size, group, last = [], 0, [], None

        def settle(rows, hits):
            out = [(r[1], r[2] + a, r[2] + b) for r, hit in zip(rows, hits, strict=True) if r[3] == 1 for a, b in _spans(hit, window)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rk", "start", "end"])

        def close():
            """The group is complete: results of what is due."""
            nonlocal batch_rows, size
            own = sum(len(r[5]) for r in group)
            due = []
            if own > SORT_BYTES:
                due.append(settle(group, _in_strips([(r[5], len(r[5]) - window + 1, r[4], r[3]) for r in group], window)))
            else:
                if size + own > SORT_BYTES and batch_rows:
                    due.append(settle(batch_rows, repeated_windows([(r[5], len(r[5]) - window + 1) for r in batch_rows], window)))
                    batch_rows, size = [], 0
                batch_rows, size = batch_rows + group, size + own
            return due

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and group:
                    yield from close()
                    group = []
                last = row[0]
                group.append(row)
        if group:
            yield from close()
        if batch_rows:
            yield settle(batch_rows, repeated_windows([(r[5], len(r[5]) - window + 1) for r in batch_rows], window))

    by_sort = pieces.repartition("anchor").sortWithinPartitions("anchor", "rk", "lo").mapInArrow(sort_groups, "rk long, start long, end long")
    return whole.unionByName(by_sort)


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and what is kept (bytes) if asked for.

    Bytes are UTF-8; null is empty; texts shorter than the window lose nothing. Rows of equal id and text repeat each other and lose all that
    a window covers. Other columns are ignored. Rows are told apart by a 64-bit hash of id and text.
    """
    keyed = _keyed(docs)
    spans = written(repeats(keyed, window).distinct(), "spans")
    bits = written(bit_table(spans, "rk"), "bits")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    names = [c.split()[0] for c in schema.split(", ")]
    arrow = [pa.int64()] * 4 + [pa.string(), pa.binary()][: 2 if with_text else 1]

    def cut(batches):
        for batch in batches:
            for i, j in by_bytes(batch.column(1), STEP_BYTES):
                rows = []
                part = batch.slice(i, j - i)
                for doc_id, text, found in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    raw = text.as_py().encode()
                    kept, at, removed, runs = [], 0, 0, 0
                    for a, b in sorted((s["start"], s["end"]) for s in found or []):
                        if a > at or (a == 0 and not runs):  # a new run; one that touches the last goes on
                            kept.append(raw[at:a])
                            runs += 1
                            removed += b - a
                            at = b
                        elif b > at:
                            removed += b - at
                            at = b
                    kept.append(raw[at:])
                    rest = b"".join(kept)
                    rows.append((doc_id, len(raw), removed, runs, hashlib.sha256(rest).hexdigest(), *([rest] if with_text else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=names)

    found = spans.groupBy("rk").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    touched = that_may_be_in(keyed, bits, "rk").join(found, "rk", "left").select("doc_id", "text", "found").mapInArrow(cut, schema)
    raw = F.col("text").cast("binary")
    free = that_may_be_in(keyed, bits, "rk", hit=False).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(raw, 256).alias("kept_sha256"), *([raw.alias("kept")] if with_text else []),
    )
    return free.unionByName(touched)


def op3_suffix_array_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"))
