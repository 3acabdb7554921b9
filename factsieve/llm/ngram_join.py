"""N-gram Jaccard join with set-relation skipping.

Two sets of similarity 0.8 share one of the first tokens of each, in any one order of all tokens; tokens that many documents have
come last in the order used here. Documents are listed under their first tokens, and lists are walked in blocks:

* Block skipping: a list is sorted by set size and place of the token; two blocks are skipped if their sizes are too far apart, too little
  can still follow their places or all their sets are of one class.
* Answers from similar sets: equal sets are one. In rounds, each set asks one other set only: of the leaders of its lists the one it shares most lists
  with. What is linked joins a class, and lists of one class go. For the pairs left, the overlaps with a common leader bound
  the overlap of the pair from both sides, as do parities of the tokens per bucket of each set, and only pairs that the bounds leave open are compared.

A round asks at most one pair a set, so a passage or a class of many sets makes no pairs by the square. All pairs that could connect two classes are
decided in the end, so the classes are exact. Pairs within a class are not written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factsieve.llm.common import bit_filter, filter_place, may_hold, table, written
from factsieve.llm.packing import by_bytes
from factsieve.llm.shingles import mixed, shingle_sets

STEP_BYTES = 1 << 18
#: Tokens fall into so many cells by their leading bits. Cells that stand out in a task are counted, and so many of the most frequent come last
#: in the order of tokens. Any order gives the same result, so these bound a broadcast (4 MB) and memory, not the work done.
CELL_BITS, LAST_CELLS = 22, 1 << 20
#: Sets that meet at once in a list, and pairs that are looked at or held at once.
BLOCK, PAIRS = 64, 1 << 16
#: Rounds in which sets ask leaders. They decide nothing that the last step would not; more of them leave it less to do.
ROUNDS = 3
#: Buckets whose parities go with each row of a list, a bit each.
BUCKETS = 512


def _batches(column: int, batches, needed=None):
    """(rows, their sets) in steps of bounded size; null texts are empty."""
    for batch in batches:
        if needed is not None:
            batch = batch.filter(pa.array(needed(batch)))
        for i, j in by_bytes(batch.column(column), STEP_BYTES):
            part = batch.slice(i, j - i)
            yield part, shingle_sets(pc.fill_null(part.column(column), ""))


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit number of the set; equal sets have equal numbers."""
    return int(mixed(np.array([np.add.reduce(mixed(tokens ^ np.uint64(0xD6E8FEB86659FD93))) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def index_part(n):
    """First tokens of a set under which it is listed for larger sets (or equal ones)."""
    return n - -(-8 * n // 9) + 1


def probe_part(n):
    """First tokens of a set under which it looks for smaller sets."""
    return n - -(-4 * n // 5) + 1


def least_overlap(a, b):
    """Tokens that two sets of these sizes share at least if 100 * intersection >= 80 * union."""
    return -(-4 * (a + b) // 9)


def cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def parities(tokens: np.ndarray, buckets: int) -> bytes:
    """Whether the number of tokens in each bucket is odd, a bit each. What two sets share cancels out, so only tokens of one of them make a difference."""
    counts = np.bincount((mixed(tokens) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.packbits(counts & 1 == 1).tobytes()


def fine_buckets(n: int) -> int:
    """At least 4 buckets a token; a power of two."""
    return max(BUCKETS, 1 << (4 * n - 1).bit_length())


def most_shared(na: int, a: bytes, nb: int, b: bytes) -> int:
    """No more than this can two sets share: each bucket of different parity has a token of one of them only. The longer parities are folded until both are alike."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return min(na, nb, (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2)


def summaries(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, sid, coarse, fine) of documents, and rows (cell, often) of cells of tokens that stand out among the texts of a task.

    ``coarse`` and ``fine`` are ``parities``. A cell stands out if it has clearly more tokens than tokens of their own would give it.
    """
    names = ["doc_id", "n", "sid", "coarse", "fine", "cell", "often"]

    def run(batches):
        counts = np.zeros(1 << CELL_BITS, np.int32)
        for part, sets in _batches(1, batches):
            n = pa.array([len(s) for s in sets], pa.int64())
            sid = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            coarse, fine = (pa.array([parities(s, of(len(s))) if len(s) else None for s in sets], pa.binary()) for of in (lambda _: BUCKETS, fine_buckets))
            empty = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n, sid, coarse, fine, empty, empty], names=names)
            np.add.at(counts, cells(np.concatenate([*sets, np.zeros(0, np.uint64)])), 1)
        mean = counts.mean()
        often = np.flatnonzero(counts > mean + 3 * np.sqrt(mean) + 2)
        empty, none = pa.nulls(len(often), pa.int64()), pa.nulls(len(often), pa.binary())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, none, none, pa.array(often), pa.array(counts[often], pa.int64())], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, sid long, coarse binary, fine binary, cell long, often long")


def postings(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """token, sid, n, pos: each set under its first tokens. last: the frequent cells, rarest first; their tokens follow all others."""

    def run(batches):
        rank = np.zeros(1 << CELL_BITS, np.int32)
        rank[last] = np.arange(1, len(last) + 1)
        for _part, sets in _batches(1, batches):
            rows, seen = [], set()
            for s in sets:
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                k = probe_part(len(s))
                place = rank[cells(s)]
                first = s[place == 0][:k]
                if len(first) < k:
                    late = s[place > 0]
                    first = np.concatenate([first, late[np.argsort(place[place > 0], kind="stable")][: k - len(first)]])
                rows.append((first, sid, len(s)))
            if rows:
                sizes = [len(r[0]) for r in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)), pa.array(np.repeat([r[1] for r in rows], sizes)),
                    pa.array(np.repeat([r[2] for r in rows], sizes).astype(np.int32)), pa.array(np.concatenate([np.arange(k) for k in sizes]).astype(np.int32))],
                    names=["token", "sid", "n", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "token long, sid long, n int, pos int")


def _column(c: pa.Array) -> np.ndarray:
    """Numbers, or ``BUCKETS`` bits each in words of 64."""
    if pa.types.is_binary(c.type):
        return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, BUCKETS // 64)
    return c.to_numpy(zero_copy_only=False)


def _lists(batches):
    """Whole lists of a partition sorted by token: arrays of each column, several lists at a time."""
    held = None
    for batch in batches:
        columns = [_column(c) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)]
        token = columns[0]
        cut = int(np.searchsorted(token, token[-1], side="left")) if len(token) else 0
        if cut:
            yield [c[:cut] for c in columns]
        held = [c[cut:] for c in columns]
    if held is not None and len(held[0]):
        yield held


def _possible(n1, p1, n2, p2):
    """Could sets of these sizes that have a token at these places be linked? For numpy arrays."""
    small_n, large_n = np.minimum(n1, n2), np.maximum(n1, n2)
    listed = ((n1 <= n2) & (p1 < index_part(n1))) | ((n2 <= n1) & (p2 < index_part(n2)))
    return (5 * small_n >= 4 * large_n) & listed & (1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) >= least_overlap(n1, n2))


def led_lists(posted: DataFrame, turn: int) -> DataFrame:
    """Rows of the lists of more than one class, each with the leader of another class that it could be linked with (null if there is none).

    ``posted``: token, sid, n, pos, label. A list has two leaders of different classes, the least in an order of all sets that changes by ``turn``;
    a set is led by the first of them that is not of its class.
    """
    salt = mixed(np.array([turn + 1], np.uint64))[0]

    def run(batches):
        for token, sid, n, pos, label in _lists(batches):
            new = np.concatenate([[True], token[1:] != token[:-1]])
            keep = new | np.concatenate([[True], sid[1:] != sid[:-1]])  # a set may come from several batches
            first = np.flatnonzero(new)
            several = np.maximum.reduceat(label, first) != np.minimum.reduceat(label, first)
            keep &= np.repeat(several, np.diff(np.append(first, len(token))))
            token, sid, n, pos, label = (x[keep] for x in (token, sid, n, pos, label))
            if not len(token):
                continue
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(token))))
            key = mixed(sid.view(np.uint64) ^ salt)  # differs among the sets of a list
            one = np.flatnonzero(key == np.minimum.reduceat(key, first)[at])
            other = label != label[one][at]
            key = np.where(other, key, np.uint64(0xFFFFFFFFFFFFFFFF))
            two = np.flatnonzero(other & (key == np.minimum.reduceat(key, first)[at]))
            led = np.where(other, one[at], two[at])
            ok = _possible(n.astype(np.int64), pos.astype(np.int64), n[led].astype(np.int64), pos[led].astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (token, sid, n, pos)), pa.array(sid[led], mask=~ok)], names=["token", "sid", "n", "pos", "leader"])

    ordered = posted.select("token", "sid", "n", "pos", "label").repartition("token").sortWithinPartitions("token", "sid")
    return ordered.mapInArrow(run, "token long, sid long, n int, pos int, leader long")


def labelled(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """``lists`` with the class of each set; sets without a row in ``classes`` (sid, label) are classes of their own."""
    return lists.join(classes, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def asked_leaders(lists: DataFrame) -> DataFrame:
    """Pairs (a, b): each set b and the leader a with which it shares most lists, the least one of several."""
    shared = lists.where("leader IS NOT NULL").groupBy("sid", "leader").agg(F.count(F.lit(1)).alias("c"))
    best = shared.groupBy("sid").agg(F.min(F.struct((-F.col("c")).alias("c"), "leader")).alias("best"))
    return best.select(F.col("best.leader").alias("a"), F.col("sid").alias("b"))


def open_pairs(lists: DataFrame, classes: DataFrame, seen: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, linked) of different classes that share a list and are linked (true) or could be (false), by blocks of lists.

    Lists with one class are passed over. ``seen`` (a, b, na, shared) has overlaps p and q of two sets with a leader a of H tokens: the
    sets share at least p + q - H, and at most min(p, q) within the leader and min(n1 - p, n2 - q) outside. Parities bound
    it, too. So most pairs are decided here, and only those left open are written out, in one of the first lists that both are in: not where an
    earlier list of both is known from the two lists before.
    """

    def run(batches):
        for token, sid, n, pos, label, hub, hub_n, p, last, last_but_one, odd in _lists(batches):
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            bounds = np.append(first, len(token))
            mixed_list = np.maximum.reduceat(label, first) != np.minimum.reduceat(label, first)
            large = np.diff(bounds) > BLOCK

            def decided(k, m):
                """Rows (a, b, linked) of the pairs of places k and m."""
                ok = (label[k] != label[m]) & _possible(n[k], pos[k], n[m], pos[m])
                for x in (last, last_but_one):  # they met in the list of an earlier token, where they were possible, too
                    ok &= (x[k] != last[m]) & (x[k] != last_but_one[m])
                k, m = k[ok], m[ok]
                known = (p[k] >= 0) & (p[m] >= 0) & (hub[k] == hub[m])
                need = least_overlap(n[k], n[m])
                most = np.minimum(p[k], p[m]) + np.minimum(n[k] - p[k], n[m] - p[m])
                sure = known & (p[k] + p[m] - hub_n[k] >= need)
                keep = sure | ~known | (most >= need)
                k, m, sure, need = k[keep], m[keep], sure[keep], need[keep]
                keep = np.bitwise_count(odd[k] ^ odd[m]).sum(1, dtype=np.int64) <= n[k] + n[m] - 2 * need
                k, m = k[keep], m[keep]
                return np.stack([np.minimum(sid[k], sid[m]), np.maximum(sid[k], sid[m]), sure[keep]], 1)

            def met():
                # lists of one block: each place with those after it in its list, many lists at once
                a, b = bounds[:-1][mixed_list & ~large], bounds[1:][mixed_list & ~large]
                places = np.repeat(a - np.cumsum(np.append(0, b - a))[:-1], b - a) + np.arange((b - a).sum())
                after = np.repeat(b, b - a) - 1 - places
                ends = np.cumsum(after)
                cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS)), [len(places)]]))
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    k = np.repeat(places[i:j], after[i:j])
                    yield k, k + 1 + np.arange(len(k)) - np.repeat(np.cumsum(after[i:j]) - after[i:j], after[i:j])
                for a, b in zip(bounds[:-1][mixed_list & large], bounds[1:][mixed_list & large], strict=True):
                    starts = np.arange(a, b, BLOCK)
                    low, high = n[starts], n[np.minimum(starts + BLOCK, b) - 1]  # lists are sorted by size
                    ahead = np.maximum.reduceat((n - pos)[a:b], starts - a)  # what follows the token, itself included, at most
                    from_label, to_label = (f.reduceat(label[a:b], starts - a) for f in (np.minimum, np.maximum))
                    for i, s in enumerate(starts):
                        # blocks whose sizes, places or classes rule out every pair are skipped
                        meets = (5 * high[i] >= 4 * low[i:]) & (np.minimum(ahead[i], ahead[i:]) >= least_overlap(low[i], low[i:]))
                        meets &= (np.minimum(from_label[i], from_label[i:]) != np.maximum(to_label[i], to_label[i:]))
                        meets = np.flatnonzero(meets) + i
                        x = np.arange(s, min(s + BLOCK, b))
                        for j in meets:
                            y = np.arange(starts[j], min(starts[j] + BLOCK, b))
                            k, m = np.repeat(x, len(y)), np.tile(y, len(x))
                            yield (k[k < m], m[k < m]) if i == j else (k, m)

            out: list[np.ndarray] = []
            for k, m in met():
                out.append(decided(k, m))
                if sum(map(len, out)) > PAIRS:
                    yield rows_of(out)
                    out = []
            if out:
                yield rows_of(out)

    def rows_of(out):
        three = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(three[:, 0]), pa.array(three[:, 1]), pa.array(three[:, 2] == 1)], names=["a", "b", "linked"])

    near = seen.groupBy(F.col("b").alias("sid")).agg(F.max(F.struct("shared", "a", "na")).alias("near"))
    known = sets.where("sid IS NOT NULL").groupBy("sid").agg(F.first("coarse").alias("coarse"))
    by_place = Window.partitionBy("sid").orderBy("pos")
    before = [F.coalesce(F.lag("token", i).over(by_place), "sid").alias(f"before_{i}") for i in (1, 2)]  # no two sets have a sid in common
    rows = labelled(lists, classes).select("*", *before).join(near, "sid", "left").join(known, "sid", "left").select(
        "token", "sid", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "label", F.coalesce("near.a", F.lit(0)).alias("hub"),
        F.coalesce("near.na", F.lit(0)).alias("hub_n"), F.coalesce("near.shared", F.lit(-1)).alias("p"), "before_1", "before_2", "coarse")
    found = rows.repartition("token").sortWithinPartitions("token", "n", "pos", "sid").mapInArrow(run, "a long, b long, linked boolean")
    return found.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def set_rows(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """sid, n and the ``tokens`` (64-bit numbers, ascending) as binary, of the sets in ``pairs``, each from the document of least id.

    A bit filter of fixed size spares the shingling of most other documents; what it lets through by chance goes in the join that follows.
    A set that only rows without id have is asked of these rows: the null id is a value like others here.
    """
    named = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    need = written(sets.join(named, "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("doc_id")), "need")
    words = bit_filter(need, "doc_id")

    def needed(batch):
        return may_hold(words, batch.column(2).to_numpy())

    def run(batches):
        for part, found in _batches(1, batches, needed):
            data = [s.astype("<u8").tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_id(s) if len(s) else None for s in found], pa.int64()),
                                              pa.array([len(s) for s in found], pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "sid", "n", "tokens"])

    d = docs.select(F.col("doc_id").cast("long"), "text", filter_place("doc_id").alias("place"))
    rows = d.mapInArrow(run, "doc_id long, sid long, n long, tokens binary")
    asked = need.select(F.col("doc_id").alias("need_id"), F.col("sid").alias("need_sid"))
    found = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("need_id")) & (F.col("sid") == F.col("need_sid")), "left_semi")
    return found.dropDuplicates(["sid"]).select("sid", "n", "tokens")


def compared(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, na, nb, shared (their overlap) of the pairs whose parities let them be linked; the others are not."""

    def joined(some: DataFrame, rows: DataFrame, data: str) -> DataFrame:
        left = rows.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col(data).alias("da"))
        right = rows.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col(data).alias("db"))
        return some.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "da", "db")

    def by_parities(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_pylist() for c in (2, 3))
            most = [most_shared(*x) for x in zip(na, batch.column(4).to_pylist(), nb, batch.column(5).to_pylist(), strict=True)]
            keep = np.array(most, np.int64) >= least_overlap(np.array(na, np.int64), np.array(nb, np.int64))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def by_tokens(batches):
        for batch in batches:
            shared = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared.append(int((y[at] == x).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared, pa.int64())], names=["a", "b", "na", "nb", "shared"])

    counts = sets.where("sid IS NOT NULL").groupBy("sid").agg(F.first("n").alias("n"), F.first("fine").alias("fine"))
    likely = written(joined(pairs, counts, "fine").mapInArrow(by_parities, "a long, b long"), "likely")
    return joined(likely, set_rows(docs, sets, likely), "tokens").mapInArrow(by_tokens, "a long, b long, na long, nb long, shared long")


def components(edges: DataFrame) -> DataFrame:
    """sid, label: the least set number reachable over edges (a, b). Rounds of large and small stars, each written, until nothing changes."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("sid"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("sid"), F.col("v").alias("label")).union(roots)


def join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least doc_id reachable by links).

    Null texts and texts without words have no shingles and are linked with nothing: component_id is their own id. Rows with a null id are linked by their
    text like others; a class of null ids alone has a null component_id. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    Shingles and sets are told apart by 64-bit hashes. A text is read in one piece by one task, however long.
    """
    spark = docs.sparkSession
    summary = written(summaries(docs), "summary")
    sets = summary.where("n IS NOT NULL").select("doc_id", "n", "sid", "coarse", "fine")
    often = summary.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("often").alias("often")).orderBy(F.desc("often"), "cell").limit(LAST_CELLS)
    last = often.select(F.col("cell").cast("int").alias("cell")).toArrow().column(0).to_numpy()[::-1].copy()
    links = "shared >= ceil(4 * (na + nb) / 9)"
    lists = written(led_lists(postings(docs, last).withColumn("label", F.col("sid")), 0), "lists")
    asked, seen, classes = None, None, None
    for turn in range(1, ROUNDS + 1):
        ask = asked_leaders(lists)
        if asked is not None:
            ask = ask.join(asked, ["a", "b"], "left_anti")
        ask = written(ask, "asked")
        got = written(compared(docs, sets, ask), "compared")
        asked, seen = (ask, got) if asked is None else (asked.union(ask), seen.union(got))
        linked = seen.where(links).select("a", "b")
        if got.where(links).isEmpty() and classes is not None:
            break
        classes = written(components(linked), "classes")
        lists = written(led_lists(labelled(lists, classes), turn), "lists")
    known = asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = written(open_pairs(lists, classes, seen, sets).join(known, ["a", "b"], "left_anti"), "open")
    ask = rest.where("NOT linked").select("a", "b")
    if not ask.isEmpty():
        more = compared(docs, sets, ask).where(links).select("a", "b")
    else:
        more = spark.createDataFrame([], "a long, b long")
    more = written(more.union(rest.where("linked").select("a", "b")), "links")
    if not more.isEmpty():
        classes = written(components(linked.union(more)), "classes")
    by_set = sets.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("first")).join(classes, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = by_set.groupBy("label").agg(F.min("first").alias("component_id"))
    named = by_set.join(least, "label").select("sid", "component_id")
    return sets.join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))
