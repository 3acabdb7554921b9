"""Periodic runs, cost-balanced packing and the prefix trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factsieve.llm import cost_packing, periodic_runs, prefix_trie

DOCS = "doc_id long, text string, runs string, start long, length string, period string"


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def texts():
    rng = random.Random(11)
    out = [None, "", " \t\n", "one", "a " * 40, "a b\tc\nd " * 9 + "x", "  é ü " * 20, "x" * 5000]
    for k in (1, 2, 3, 30):
        for n in (5, 12, 40, 200, 700):
            w = [f"w{rng.randrange(k)}" for _ in range(n)]
            a, p = rng.randrange(n), rng.randint(1, 1 + n // 3)
            out += [" ".join(w), "  ".join(w[:a] + [w[a + (i - a) % min(p, n - a)] for i in range(a, n)])]
    return out


def looped(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def expected_runs(w):
    runs = brute_runs(w)
    drop = set()
    for s, length, q in runs:
        drop |= set(range(s + q, s + length))
    return runs, " ".join(x for i, x in enumerate(w) if i not in drop)


def test_transform():
    rng = np.random.default_rng(0)
    for n in (8, 64, 128, 256, 2048):
        x, y = rng.integers(0, 3, (2, 3, n))
        product = periodic_runs.inverse(periodic_runs._mod(periodic_runs.transform(x.astype(float), -1) * periodic_runs.transform(y.astype(float))))
        want = [[sum(int(a[i]) * int(b[(i + d) % n]) for i in range(n)) for d in range(0, n, max(1, n // 8))] for a, b in zip(x, y, strict=True)]
        assert (product[:, :: max(1, n // 8)] % periodic_runs.PRIME).astype(int).tolist() == want


@pytest.mark.parametrize("longest", [16, 1 << 16])
def test_runs_of(monkeypatch, longest):
    monkeypatch.setattr(periodic_runs, "TRANSFORM", longest)
    rng, flat, first, size, want = random.Random(1), [], [], [], []
    for t in range(150):
        n, k = rng.choice([0, 1, 11, 12, 13, 60, 300]), rng.choice([1, 2, 3, 9, 50])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 12 and t % 2:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        want += [(s + len(flat), e, q) for s, e, q in brute_runs(w)]
        first.append(len(flat))
        size.append(n)
        flat += [*w, 1000 + t]
    assert sorted(periodic_runs.runs_of(np.array(flat), np.array(first), np.array(size))) == sorted(want)


def test_find_runs(spark):
    data = [(i, t, "r", 1, "l", "p") for i, t in enumerate(texts())]
    data += [data[5], (None, "a " * 40, "r", 1, "l", "p")]
    frame = spark.createDataFrame(data, DOCS).repartition(3)
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic_runs.find_runs(frame).collect())
    want = Counter()
    for d, t, *_ in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs, collapsed = expected_runs(w)
        want[d, len(w), tuple(runs), collapsed] += 1
    assert got == want
    assert periodic_runs.find_runs(frame.limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(3)
    head, unit = [f"h{rng.randrange(50)}" for _ in range(1000)], [f"u{i}" for i in range(70_000)]
    w = head + unit * 8 + ["end"]  # 3.9 MB, one run longer than the longest transform
    [row] = periodic_runs.find_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).collect()
    assert (1000, 560_000, 70_000) in [tuple(r) for r in row["runs"]] and row["collapsed"].split()[-2:] == ["u69999", "end"]


def test_op11(spark, tmp_path):
    data = [(7 * i, t, "r", 1, "l", "p") for i, t in enumerate(texts() * 3)] + [(None, "a b " * 9, "r", 1, "l", "p")]
    spark.createDataFrame(data, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    want, sha = Counter(), lambda t: hashlib.sha256(t.encode()).hexdigest()
    for d, t, *_ in data:
        runs, collapsed = expected_runs(looped(d, t))
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        rows = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2])))
        want[d, len(runs), s, length, q, 1000 * length // q if runs else None, sha(rows), sha(collapsed if runs else " ".join(looped(d, t)))] += 1
    assert any(looped(d, t) != (t or "").split() for d, t, *_ in data)
    assert Counter(map(tuple, periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect())) == want


def placed(plan, histogram):
    bins = defaultdict(list)
    for size, n in histogram.items():
        for i in range(n):
            left, number = size, i
            while left:
                [r] = [r for r in plan if r[0] == left and r[1] <= number < r[1] + r[2]]
                bins[r[4] + number - r[1]].append((r[5], r[3]))
                left, number = left - r[3], r[6] + number - r[1]
    return bins


def test_plan():
    rng = random.Random(5)
    for _ in range(60):
        histogram = Counter(rng.randint(1, 63) for _ in range(rng.randint(0, 90)))
        bins = placed(cost_packing.plan_sequences(histogram, 64), histogram)
        odd = []
        for b in bins.values():
            end = 0
            for a, n in sorted(b):
                assert a == end
                end += n
            odd += [end] if end < 64 else []
        assert len(set(odd)) == len(odd) and all(x & (x - 1) == 0 for x in odd)


def test_plan_is_the_greedy_one():
    """The plan on the histogram gives the costs of dealing piece by piece."""
    rng = random.Random(6)
    for _ in range(20):
        histogram = Counter(rng.choice([rng.randint(1, 63), rng.randint(20, 40)]) for _ in range(rng.randint(1, 300)))
        total = sum(k * v for k, v in histogram.items())
        bins = [[64, 0, []] for _ in range(total // 64)] + [[1 << b, 0, []] for b in range(6, -1, -1) if (total % 64) >> b & 1]
        left = sorted(histogram.elements())
        while left:
            n = left.pop()
            fits = [b for b in bins if b[0] >= n]
            b = min(fits, key=lambda b: b[1]) if fits else min((b for b in bins if b[0] == max(x[0] for x in bins)), key=lambda b: b[1])
            take = min(n, b[0])
            b[0], b[1] = b[0] - take, b[1] + cost_packing.cost_of(take)
            b[2].append(take)
            if take < n:
                left = sorted([*left, n - take])
        got = placed(cost_packing.plan_sequences(histogram, 64), histogram)
        assert sorted(sorted(n for _, n in b) for b in got.values()) == sorted(sorted(b[2]) for b in bins)


def test_cost_packing(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public.path("word_bpe_49k.json")))
    rng = random.Random(2)
    data = [(i, x, "s") for i, x in enumerate([None, "", "One, two.", "é" * 30, *[" ".join(rng.choice(["some", "words", "ofthis", "x1"]) for _ in range(rng.randint(1, 150))) for _ in range(60)]])]
    data += [data[9], (None, "no id " * 40, "s")]
    frame = spark.createDataFrame(data, "doc_id long, text string, offset string").repartition(4)
    own = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x, _ in data}
    got = cost_packing.pack_documents(frame, length=64).collect()
    bins, seen = defaultdict(list), defaultdict(list)
    for r in got:
        part = own[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(own[r["doc_id"]]) and r["length"] == len(part) and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    for d, ids in own.items():
        assert sorted(seen[d]) == sorted([*range(len(ids))] * (2 if d == 9 else 1))
    odd = []
    for b in bins.values():
        end = 0
        for a, n in sorted(b):
            assert a == end
            end += n
        odd += [end] if end < 64 else []
    assert len(set(odd)) == len(odd) and all(x & (x - 1) == 0 for x in odd)
    assert cost_packing.pack_documents(frame.limit(0)).count() == 0


def brute_trie(convs):
    """convs: id to list of (role, text)."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in children[k]) or 1
        saved[k] = sum(saved[c] for c in children[k]) + ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], sha([c for c in m if len(convs[c]) == len(k)])) for k, m in nodes.items())


TURNS = "conv_id long, turn long, role string, text string, depth string, key string"


def turns_of(rng, n):
    out = []
    for c in range(-10, n):
        if c % 13 == 4:
            continue
        path = []
        for t in range(rng.choice([1, 1, 2, 3, 4, 6, 30 if c % 50 == 0 else 5])):
            path.append((c, t + 5, ("user", "bot")[t % 2], ("hi", "ho ü", f"own {c}")[min(2, int(rng.expovariate(1.2)))]))
        out += path
    out += [(3, None, "user", "first"), (6, 9, None, None), (6, 9, None, "")]
    rng.shuffle(out)
    return [(*r, "d", "k") for r in [*out, (None, 1, "user", "no id")]]


def rebuilt(turns):
    own = defaultdict(list)
    for c, t, role, text, *_ in turns:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c - np.fmod(c, 5))  # as SQL's %
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


@pytest.mark.parametrize("block", [7, 50_000])
def test_prefix_trie(spark, tmp_path, monkeypatch, block):
    rng = random.Random(7)
    data = turns_of(rng, 400)
    spark.createDataFrame(data, TURNS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    table = spark.read.parquet(str(tmp_path / "conversations.parquet"))
    lists = prefix_trie.shared_heads(prefix_trie.turn_lists(table))
    got = Counter(map(tuple, prefix_trie.trie(lists, block=block).collect()))
    assert got == brute_trie(rebuilt(data))


def test_peel_in_blocks():
    """Blocks of every size give the same nodes in the end."""
    rng = random.Random(8)
    convs = {c: [("u", rng.choice("ab")) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))] for c in range(120)}
    digest = lambda t: hashlib.sha256(repr(t).encode()).digest()[:16]
    level = sorted((b"".join(map(digest, v)), c, [len(t[1]) for t in v], (1, 0, 0, 0)) for c, v in convs.items())
    want = {(r[0], r[1], *r[3:7]) for r in brute_trie(convs)}
    for size in (1, 2, 5, 17, 60, 1000):
        done, rows, listed = set(), level, True
        while rows:
            whole = len(rows) <= max(size, 400) and not listed or len(rows) <= size
            blocks = [rows] if whole else [rows[i : i + size] for i in range(0, len(rows), size)]
            opened = []
            for b in blocks:
                for kind, key, _, conv, depth, _, *rest in prefix_trie.peel([r[0] for r in b], np.array([r[1] for r in b]), [r[2] for r in b], np.array([r[3] for r in b]), whole, listed):
                    if kind in ("node", "child"):
                        done.add((conv, depth, *rest[:4]))
                    elif kind == "open":
                        opened.append((key, conv, rest[5], tuple(rest[:4])))
            rows, listed, size = sorted(opened), False, max(size, 400)
        assert done == want


def test_hot_conversations(spark):
    """A third of the conversations are equal, as many have no turns; the lists of their ids go through several tasks."""
    lists = spark.range(3000).selectExpr("id AS conv_id", "transform(sequence(1, cast(id % 3 AS int) * 2), i -> named_struct('digest', unhex(substring(sha2(cast(CASE WHEN id % 3 = 1 THEN i ELSE i + id END AS string), 256), 1, 32)), 'bytes', cast(3 AS long))) AS turns")
    lists = lists.selectExpr("conv_id", "CASE WHEN conv_id % 3 = 0 THEN slice(turns, 1, 0) ELSE turns END AS turns")
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.trie(lists, block=100).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[0, 0]["ends_sha256"] == sha(range(0, 3000, 3)) and got[0, 0]["n_convs"] == 3000 and got[0, 0]["n_leaves"] == got[0, 0]["n_children"]
    assert got[1, 2]["ends_sha256"] == sha(range(1, 3000, 3)) and got[1, 2]["n_convs"] == 1000 and got[1, 1]["saved_tokens"] == 999 * 6
    assert prefix_trie.trie(lists.where("false")).count() == 0
