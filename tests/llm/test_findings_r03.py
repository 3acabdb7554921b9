"""Findings of round 3 on the operators, each on a small case that failed before."""

import gc
import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from factsieve.llm import ngram_join, suffix_dedup


def removed(data, w):
    raw = [t.encode() for _, t in data]
    count = Counter(t[i : i + w] for t in raw for i in range(len(t) - w + 1))
    out = Counter()
    for (d, _), t in zip(data, raw, strict=True):
        mark = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - w + 1):
            if count[t[i : i + w]] > 1:
                mark[i : i + w] = 1
        kept = bytes(b for b, m in zip(t, mark, strict=False) if not m)
        out[d, len(t), int(mark.sum()), int((np.diff(np.concatenate([[0], mark])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_near_copies_under_the_limit_are_told_apart_where_they_meet(spark, monkeypatch):
    """Most pairs of a group of texts that are alike, but under 0.8, are not written out to be compared."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(f"x{i}_{k}" if k in spots else w for k, w in enumerate(base))) for i in range(150) for spots in [set(rng.sample(range(150), 2))]]
    asked, old = [], ngram_join.compared

    def counted(docs, sets, pairs):
        asked.append(pairs.count())
        return old(docs, sets, pairs)

    monkeypatch.setattr(ngram_join, "compared", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in rows]
    label = list(range(150))
    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert sum(asked) < 3_000


def test_parities_bound_the_overlap():
    rng = np.random.default_rng(1)
    for n in (1, 7, 100, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for lost in (0, 1, n // 10, n):
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 1 << 63, lost // 2 + 1, dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            for wa, wb in ((512, 512), (ngram_join.fine_buckets(len(a)), ngram_join.fine_buckets(len(b)))):
                most = ngram_join.most_shared(len(a), ngram_join.parities(a, wa), len(b), ngram_join.parities(b, wb))
                assert shared <= most <= min(len(a), len(b))


def traced(function, *args):
    """What the function returns, and the most bytes it held."""
    gc.collect()
    tracemalloc.start()
    out = function(*args)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_a_long_text_is_cut_in_sections():
    """The memory that segments take does not grow with the longest text, and each window is in one segment."""
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(97, 123, 1 << 20)))

    def run():
        starts = np.zeros(len(text), np.int8)
        for _, a, part in suffix_dedup._sections(pa.array([text]), 400):
            _, lo, hi, *_ = suffix_dedup.segments(part)
            for x, y in zip(lo + a, hi + a, strict=True):
                starts[x : y + 1] += 1
        return starts

    starts, most = traced(run)
    assert (starts[: len(text) - 399] == 1).all() and not starts[len(text) - 399 :].any()
    assert most < 60 << 20


def test_a_passage_across_sections_is_removed(spark, monkeypatch):
    """Texts longer than a step, cut at other places of the passage each."""
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 1000)
    rng = random.Random(5)
    own = ["".join(rng.choices("abcdefgh é", k=n)) for n in (700, 1630, 2100)]
    shared = "".join(rng.choices("abcdefgh ", k=1500))
    rows = [(0, own[0] + shared + own[1]), (1, own[1][:90] + own[2] + shared), (2, own[2][:300] + own[0][300:])]
    got = Counter(map(tuple, suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == removed(rows, 400)


def test_a_large_group_of_one_anchor_is_sorted_in_bounded_memory():
    """A line of 500 bytes in many texts that differ around it: all segments have one anchor."""
    rng = random.Random(6)
    line = rng.randbytes(500)
    texts = [rng.randbytes(100) + line + rng.randbytes(100) for _ in range(1500)]
    texts[1] = texts[0][50:600] + texts[1][550:]
    group = [(t, len(t) - 400 + 1, t.index(line) + 200, 1) for t in texts]
    hits, most = traced(suffix_dedup._in_strips, group, 400)
    seen = Counter(hash(t[i : i + 400]) for t, k, _, _ in group for i in range(k))
    for (t, k, _, _), hit in zip(group, hits, strict=True):
        assert hit.tolist() == [seen[hash(t[i : i + 400])] > 1 for i in range(k)]
    assert most < 40 << 20


def test_texts_pass_the_filters_without_python(spark):
    """Whole texts go to Python to be segmented, cut and written; which of them are wanted is decided by joins."""
    docs = spark.createDataFrame([(n, f"{n} " + "abc " * n) for n in range(300)], "doc_id long, text string")
    plan = suffix_dedup.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[-1]
    assert final.count("MapInArrow") == 1 and "LeftAnti" in final
