"""Conversation prefix trie by truncation peeling.

A node is a distinct sequence of first turns. A conversation's key is the string of its turns' digests, so a node's members are the
keys that start with the node's key. Keys are dealt to tasks by sorted ranges, equal keys by conversation id, so that no
key, however many conversations hold it, is one task's work. A task takes its range in blocks and peels each block from its greatest
depth: conversations that end at a depth join the nodes that survived from the depth below, neighbours with the same first turns are one node, the
last turn is stripped, and the survivors go on to the next depth. Every node is found, and its counts are complete, in that one descent.

Only nodes on the path of a block's first or last key can have members in another block. They leave as partial counts, and the same peeling merges
them with their like: each round leaves at most two paths a block, until one block holds all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.common import table, written

#: Bytes of a turn's digest; entries of a block, of which the paths of its ends must be a small part.
DIGEST, BLOCK = 16, 50_000
#: Copies of a partial node to which its children are spread when they learn its smallest member.
SPREAD = 16

#: An entry: a conversation that ends at ``key``, or what a block knows of the node ``key`` beside its open child.
#: bytes of the texts on its path; members, children, leaves and saved tokens known so far; ids of the conversations that end here.
ENTRY = "key binary, conv_id long, bytes array<long>, n_convs long, n_children long, n_leaves long, saved_tokens long"
#: kind: node (complete), child (complete but for its parent's id; key is the parent's), open (an entry of the next round), ends (a piece of an open
#: node's list). own_key: of nodes that were open before, whose lists and children still have to find them.
FOUND = "kind string, key binary, own_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, bytes array<long>, ends string, first_end long"
EMPTY = hashlib.sha256(b"").hexdigest()
NONE = np.iinfo(np.int64).max


def turn_lists(turns: DataFrame) -> DataFrame:
    """conv_id and its turns as array<struct<digest,bytes>>, ordered by turn (null first), then role and text.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation. Only digests and sizes are gathered; a conversation
    (not its text) has to fit a task, as has the depth of the trie.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    one = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    lists = turns.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def entries(lists: DataFrame) -> DataFrame:
    """Entries of whole conversations: conv_id, turns array<struct<digest,bytes>>."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    return lists.select(key.alias("key"), "conv_id", F.transform("turns", lambda t: t["bytes"]).alias("bytes"), F.lit(1).cast("long").alias("n_convs"), *zero)


def shared_turns(keys: list[bytes]) -> np.ndarray:
    """How many first turns each key shares with the one before it (the first: none)."""
    out = np.zeros(len(keys), np.int64)
    for i in range(1, len(keys)):
        a, b = keys[i - 1], keys[i]
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            out[i] = n // DIGEST
            continue
        low, high = 0, n // DIGEST  # a[:low] agrees, a[:high] does not
        while high - low > 1:
            middle = (low + high) // 2
            if a[: middle * DIGEST] == b[: middle * DIGEST]:
                low = middle
            else:
                high = middle
        out[i] = low
    return out


def peel(keys: list[bytes], conv: np.ndarray, sizes: list, counts: np.ndarray, whole: bool, listed: bool) -> Iterator[tuple]:
    """Rows of ``FOUND`` for sorted entries (equal keys by id). ``counts`` holds n_convs, n_children, n_leaves and saved_tokens by column.

    ``whole``: there are no other entries, so all nodes are complete. ``listed``: entries are conversations, whose ids are hashed here.
    """
    n = len(keys)
    depth = np.fromiter((len(k) // DIGEST for k in keys), np.int64, n)
    shared = shared_turns(keys)
    by_depth = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
    # nodes of the depth below that survive: first row, smallest member, counts, digest of the ends, and whether more may follow elsewhere
    at, low, total, ends, open_ = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4), np.int64), [], np.zeros(0, bool)
    for d in range(int(depth.max()), -1, -1):
        ended = by_depth[edges[d] : edges[d + 1]]
        rows = np.concatenate([at, ended])  # survivors and newly ended conversations
        order = np.argsort(rows, kind="stable")
        rows, is_child = rows[order], np.arange(len(rows))[order] < len(at)
        source = order
        # neighbours are one node where all keys between them share d turns
        breaks = np.concatenate([[0], np.cumsum(shared < d)])
        new = np.concatenate([[True], breaks[rows[1:] + 1] > breaks[rows[:-1] + 1]])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        child_open = np.zeros(len(rows), bool)
        child_open[is_child] = open_[source[is_child]]
        values, smallest = np.zeros((len(rows), 4), np.int64), np.empty(len(rows), np.int64)
        values[is_child], smallest[is_child] = total[source[is_child]], low[source[is_child]]
        entry = ~is_child
        values[entry], smallest[entry] = counts[rows[entry]], conv[rows[entry]]
        values[is_child, 1] = 1
        values[child_open] = 0
        smallest[child_open] = NONE
        sums = np.add.reduceat(values, first, axis=0)
        least = np.minimum.reduceat(smallest, first)
        start = rows[first]
        last = np.concatenate([first[1:], [len(rows)]]) - 1
        now_open = np.zeros(len(first), bool)
        if not whole:
            # a node reaches an end of the block if the block's first or last key starts with it
            now_open = (breaks[start + 1] == breaks[1]) & (depth[0] >= d) | (breaks[rows[last] + 1] == breaks[n]) & (depth[n - 1] >= d)
        texts = np.fromiter((sizes[r][d - 1] for r in start), np.int64, len(start)) if d else np.zeros(len(start), np.int64)
        done = ~now_open
        sums[done, 2] = np.where(sums[done, 1] == 0, 1, sums[done, 2])
        sums[done, 3] += (sums[done, 0] - 1) * texts[done]
        # children learn their parent
        for i in np.flatnonzero(is_child & ~child_open).tolist():
            c, g = source[i], group[i]
            known = done[g]
            yield ("node" if known else "child", None if known else keys[at[c]][: d * DIGEST], None if listed else keys[at[c]][: (d + 1) * DIGEST], int(low[c]), d + 1, int(least[g]) if known else None, *total[c].tolist(), ends[c], None, None, None)
        ids_at = np.flatnonzero(entry)
        ends_of: list = [None if not listed else EMPTY] * len(first)
        if listed and len(ids_at):
            owner = group[ids_at]
            cut = np.flatnonzero(np.diff(owner, prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(ids_at)), strict=True):
                g, ids = owner[a], conv[rows[ids_at[a:b]]]
                text = ",".join(map(str, ids.tolist()))
                if done[g]:
                    ends_of[g] = hashlib.sha256(text.encode()).hexdigest()
                else:
                    yield ("ends", keys[start[g]][: d * DIGEST], None, None, d, None, None, None, None, None, None, None, text, int(ids[0]))
        for g in np.flatnonzero(now_open).tolist():
            yield ("open", keys[start[g]][: d * DIGEST], None, int(least[g]), d, None, *sums[g].tolist(), None, sizes[start[g]][:d], None, None)
        if d == 0 and done.any():
            yield ("node", None, None if listed else b"", int(least[0]), 0, None, *sums[0].tolist(), ends_of[0], None, None, None)
        at, low, total, ends, open_ = start, least, sums, ends_of, now_open


def _peeled(sorted_entries: DataFrame, block: int, whole: bool, listed: bool) -> DataFrame:
    """``peel`` over each block of the sorted partitions. ``whole``: the one partition is one block."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    types = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in FOUND.split(", ")])

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.stack([batch.column(c).to_numpy() for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], axis=1)
        keys, conv = batch.column("key").to_pylist(), batch.column("conv_id").to_numpy()
        found = list(peel(keys, conv, batch.column("bytes").to_pylist(), counts, whole, listed))
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in found], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                take = batch.num_rows if whole else min(batch.num_rows, block - rows)
                held.append(batch.slice(0, take))
                rows, batch = rows + take, batch.slice(take)
                if rows >= block and not whole:
                    yield rows_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, rows = [], 0
        if rows:
            yield rows_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return sorted_entries.mapInArrow(run, FOUND)


def _ends(pieces: DataFrame) -> DataFrame:
    """key, sha256 of a node's whole list: its pieces in order, hashed one by one (a node's hash is one sequence of steps by nature)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, texts, out = batch.column("key").to_pylist(), batch.column("ends"), []
            for i, k in enumerate(keys):
                if k != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(texts[i].as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["ends_key", "ends_sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["ends_key", "ends_sha"])

    return pieces.repartition("key").sortWithinPartitions("key", "first_end").select("key", "ends").mapInArrow(fold, "ends_key binary, ends_sha string")


def trie(lists: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the prefix trie of ``lists`` (conv_id long, one row each; turns array<struct<digest binary,bytes long>>).

    Per node: conv_id (smallest member), depth, parent_conv_id (of the parent; root: null), n_convs (members), n_children, n_leaves (childless nodes
    in its subtree), saved_tokens (over its subtree, (n_convs - 1) times the bytes of the node's last text) and ends_sha256 (of the ids of members
    that end there, ascending, joined by commas). Conversations without turns end at the root. An empty table gives no nodes.
    """
    names = [c.split()[0] for c in ENTRY.split(", ")]
    level, listed, kinds = written(entries(lists), "trie-keys"), True, []
    while True:
        size = level.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("bytes")).alias("depth")).first()
        if not size["n"]:
            break
        most = max(block, 16 * (size["depth"] + 1))  # the two paths of a block's ends are an eighth of it at most
        whole = size["n"] <= most
        order = [F.col("key"), F.col("conv_id")]
        ranges = level.coalesce(1) if whole else level.repartitionByRange(-(-size["n"] // most) if not listed else int(level.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
        found = written(_peeled(ranges.sortWithinPartitions(*order), most, whole, listed), "trie-nodes")
        kinds.append(found)
        if whole:
            break
        level, listed = found.where("kind = 'open'").select(*names), False
    if not kinds:
        return lists.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if len(kinds) == 1:
        return kinds[0].select(*columns)
    late = kinds[1]
    for f in kinds[2:]:
        late = late.unionByName(f)
    late = late.where("kind IN ('node', 'child')")
    ends = _ends(kinds[0].where("kind = 'ends'"))
    late = late.join(ends, F.col("own_key") == F.col("ends_key"), "left").withColumn("ends_sha256", F.coalesce("ends_sha", F.lit(EMPTY)))
    waiting = [*columns, "kind", "key"]
    rows = late.select(*waiting).unionByName(kinds[0].where("kind IN ('node', 'child')").select(*waiting))
    # the parents that are asked for are the few once open nodes; a popular one is met in SPREAD places
    parents = late.select(F.col("own_key").alias("p_key"), F.col("conv_id").alias("p_conv"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("p_place"))
    place = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SPREAD)).cast("int")
    children = rows.where("kind = 'child'").join(parents, (F.col("key") == F.col("p_key")) & (place == F.col("p_place"))).withColumn("parent_conv_id", F.col("p_conv"))
    return rows.where("kind = 'node'").select(*columns).unionByName(children.select(*columns))


def shared_heads(lists: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations with the head of their family's first one: its first h turns, then their own after h, h = crc32(id) mod ``most``."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    heads = lists.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h)
    none = F.slice("turns", 1, 0)
    tail = F.when(F.size("turns") > F.col("h"), F.slice(F.col("turns"), F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).otherwise(none)
    return own.join(heads, "base", "left").select("conv_id", F.concat(F.coalesce(F.slice(F.col("head"), F.lit(1), F.col("h")), none), tail).alias("turns"))


def op13_prefix_trie(spark, sf_dir):
    return trie(shared_heads(turn_lists(table(spark, sf_dir, "conversations"))))


#: crc32 stands in SQL as its table of 256 values, made by its rule, and a fold over the characters of the decimal id.
OP13_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
lists AS (
  SELECT conv_id, list({'digest': sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'bytes': strlen(coalesce(text, ''))}
              ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS base,
         xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM lists, crc),
rebuilt AS (
  SELECT a.conv_id, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] AS turns FROM hashed a LEFT JOIN lists b ON b.conv_id = a.base),
paths AS (
  SELECT conv_id, len(turns) AS n, d, array_to_string(list_transform(turns[1:d], lambda x: x.digest), '') AS key,
         array_to_string(list_transform(turns[1:d - 1], lambda x: x.digest), '') AS parent, CASE WHEN d > 0 THEN turns[d].bytes ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, key, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM paths GROUP BY d, key),
kids AS (SELECT d - 1 AS d, parent AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
above AS (SELECT p.d, p.key, n.n_convs, n.bytes, k.n_children IS NULL AS leaf FROM nodes n LEFT JOIN kids k USING (d, key) JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.d),
sums AS (SELECT d, key, count(*) FILTER (WHERE leaf) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM above GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.key = n.parent LEFT JOIN kids k ON k.d = n.d AND k.key = n.key JOIN sums s ON s.d = n.d AND s.key = n.key
"""
