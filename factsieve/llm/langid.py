"""Language ID by a linear-chain conditional random field over words.

A word's score for a label is the sum of learned weights of its affixes, its byte trigrams and its entry in a lexicon; labels of
neighbouring words are tied by learned transitions. Training maximises the likelihood of code-switched sequences, made by joining runs of
words from labelled documents of different languages. A document is one sequence; forward-backward gives each word's label
probabilities, and the document's language is the label with the largest mean over words with letters.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factsieve.llm.common import table
from factsieve.llm.packing import by_bytes

#: The labelled sample: documents a language (the first by a hash of the id) and characters that a sampled document has at most.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 4000
#: Weights are kept in so many cells, by a hash of the feature; words that the lexicon holds; steps of training.
CELLS, LEXICON, STEPS = 1 << 17, 20_000, 60
SEQUENCE, RUNS = 48, (3, 24)
#: Steps after which running products are scaled; scores are bounded to 30, so doubles cannot run out.
RESCALE = 12
#: Text that one step of a task labels, and words whose scores a worker remembers.
STEP_BYTES, REMEMBERED = 1 << 20, 200_000
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray = None  # cells x labels
    lexicon: dict[str, int] = field(default_factory=dict)
    lexical: np.ndarray = None  # words x labels
    transitions: np.ndarray = None
    start: np.ndarray = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def features(words: pa.Array, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, cell, value) of the hashed features of all words, and each word's lexicon row or -1.

    Trigrams run over ``^word$`` and weigh 1 / sqrt(their number); prefixes and suffixes of 1 to 3 bytes weigh 1. Words of any length are read whole.
    """
    n = len(words)
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    names = words.to_pylist()
    data = np.frombuffer("".join(names).encode(), np.uint8)
    begin = np.cumsum(size + 2) - (size + 2)
    flat = np.zeros(int((size + 2).sum()), np.uint32)
    flat[begin], flat[begin + size + 1] = 2, 3
    owner = np.repeat(np.arange(n), size)
    flat[np.arange(len(data)) + 2 * owner + 1] = data
    at = np.arange(len(data)) + 2 * owner  # first of three

    def cell(kind: int, *chars: np.ndarray) -> np.ndarray:
        h = np.full(len(chars[0]), kind * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for c in chars:
            h = (h ^ c) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        return (h % np.uint32(CELLS)).astype(np.int64)

    who, what, value = [owner], [cell(1, flat[at], flat[at + 1], flat[at + 2])], [1 / np.sqrt(size[owner])]
    for k in (1, 2, 3):
        has = np.flatnonzero(size >= k)
        for kind, first in ((1 + k, begin[has] + 1), (5 + k, begin[has] + 1 + size[has] - k)):
            who.append(has)
            what.append(cell(kind, *[flat[first + j] for j in range(k)]))
            value.append(np.ones(len(has)))
    known = np.fromiter((lexicon.get(w, -1) for w in names), np.int64, n)
    return np.concatenate(who), np.concatenate(what), np.concatenate(value).astype(np.float32), known


def scores(model: Model, words: pa.Array, found=None) -> np.ndarray:
    who, what, value, known = found or features(words, model.lexicon)
    e = np.empty((len(words), len(model.labels)), np.float32)
    for j in range(len(model.labels)):
        e[:, j] = np.bincount(who, weights=model.weights[what, j] * value, minlength=len(words))
    return e + np.where((known >= 0)[:, None], model.lexical[known], 0).astype(np.float32)


def has_letter(words: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(words, r"\pL").to_numpy(zero_copy_only=False).astype(bool)


class WordScores:
    """exp of the bounded scores of words and whether they have a letter; each distinct word is scored once."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.e, self.letters = np.zeros((1 << 14, len(self.model.labels))), np.zeros(1 << 14, bool)

    def rows(self, words: pa.Array) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.forget()
        names, known = words.to_pylist(), self.known
        new = [w for w in names if w not in known]
        if new:
            n, fresh = len(known), pa.array(new, pa.string())
            while n + len(new) > len(self.e):
                self.e, self.letters = (np.concatenate([x, np.zeros_like(x)]) for x in (self.e, self.letters))
            letters = has_letter(fresh)
            self.letters[n : n + len(new)] = letters
            self.e[n : n + len(new)] = _bounded_exp(np.where(letters[:, None], scores(self.model, fresh), 0))
            known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, names), np.int64, len(names))


_SCORES: dict[str, WordScores] = {}


def _word_scores(model: Model) -> WordScores:
    """The worker's own, kept for the last model only."""
    if model.key not in _SCORES:
        _SCORES.clear()
        _SCORES[model.key] = WordScores(model)
    return _SCORES[model.key]


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-case words of all texts and the place of each text's first word (and the end)."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    flat = parts.flatten()
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)
    at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    ends = np.concatenate([[0], np.cumsum(keep)])
    return flat.filter(pa.array(keep)).dictionary_encode(), ends[at]


def forward_backward(e: np.ndarray, first: np.ndarray, size: np.ndarray, model: Model, with_passes: bool = False):
    """Label probabilities of every word, and both passes if asked for. e: exp of the scores (words x labels); sequences start at ``first`` and are ``size`` long.

    Sequences run side by side, the longest first, so those still running at a step are a leading part. Sequences must follow each other without a gap.
    """
    order = np.argsort(-size, kind="stable")
    steps = int(size.max()) if len(size) else 0
    running = np.searchsorted(-size[order], -np.arange(steps), side="left")
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size))
    # words by step, then by rank of their sequence: each step is a slice
    from_step = np.concatenate([[0], np.cumsum(running)]).astype(np.int64)
    within = np.arange(len(e)) - np.repeat(first, size)
    place = from_step[within] + np.repeat(rank, size)
    by_step = np.empty(e.shape)
    by_step[place] = e
    step = np.exp(model.transitions)
    alpha, beta = np.empty_like(by_step), np.ones_like(by_step)
    for t in range(steps):
        s, n = from_step[t], running[t]
        now = alpha[s : s + n]
        if t:
            np.matmul(alpha[from_step[t - 1] : from_step[t - 1] + n], step, out=now)
        else:
            now[:] = np.exp(model.start)
        now *= by_step[s : s + n]
        if t % RESCALE == 0:
            now /= now.sum(1, keepdims=True)
    back = np.ascontiguousarray(step.T)
    for t in range(steps - 2, -1, -1):
        s, after, n = from_step[t], from_step[t + 1], running[t + 1]
        now = beta[s : s + n]
        np.matmul(beta[after : after + n] * by_step[after : after + n], back, out=now)
        if t % RESCALE == 0:
            now /= now.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    return (p[place], alpha[place], beta[place]) if with_passes else p[place]


def _bounded_exp(x: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(x - x.max(1, keepdims=True), -30, 0))


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 0) -> Model:
    """AdaGrad on the likelihood of code-switched sequences of ``SEQUENCE`` words. No labelled word: a model without labels."""
    labels = sorted(set(langs))
    words, ends = split(pa.array(texts, pa.string()))
    if not labels or not len(words):
        return Model([])
    rng = np.random.default_rng(seed)
    gold = np.repeat([labels.index(x) for x in langs], np.diff(ends))
    runs = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        while a < b:
            n = int(rng.integers(*RUNS))
            runs.append(np.arange(a, min(a + n, b)))
            a += n
    order = np.concatenate([runs[i] for i in rng.permutation(len(runs))])
    vocabulary = words.dictionary
    rows, gold = words.indices.to_numpy()[order], gold[order]
    counts = np.bincount(rows, minlength=len(vocabulary))
    letters = has_letter(vocabulary)
    common = [i for i in np.argsort(-counts, kind="stable")[:LEXICON] if counts[i] > 1 and letters[i]]
    names = vocabulary.to_pylist()
    k = len(labels)
    model = Model(labels, np.zeros((CELLS, k)), {names[i]: j for j, i in enumerate(common)}, np.zeros((max(1, len(common)), k)), np.zeros((k, k)), np.zeros(k))
    found = features(vocabulary, model.lexicon)
    who, what, value, known = found
    first = np.arange(0, len(rows), SEQUENCE)
    size = np.minimum(SEQUENCE, len(rows) - first)
    inner = np.ones(len(rows), bool)
    inner[first] = False
    pairs = np.flatnonzero(inner)
    sums = {n: np.full_like(getattr(model, n), 1e-8) for n in ("weights", "lexical", "transitions", "start")}
    want = np.bincount(gold[pairs - 1] * k + gold[pairs], minlength=k * k).reshape(k, k).astype(float)
    for _ in range(steps):
        e = _bounded_exp(np.where(letters[:, None], scores(model, vocabulary, found), 0))[rows]
        p, alpha, beta = forward_backward(e, first, size, model, True)
        joint = alpha[pairs - 1][:, :, None] * np.exp(model.transitions)[None] * (e * beta)[pairs][:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        g = -p.astype(np.float64)
        g[np.arange(len(g)), gold] += 1
        per_word = np.stack([np.bincount(rows, weights=g[:, j], minlength=len(vocabulary)) for j in range(k)], 1) * letters[:, None]
        grads = {"weights": np.stack([np.bincount(what, weights=per_word[who, j] * value, minlength=CELLS) for j in range(k)], 1) - 0.05 * model.weights,
                 "lexical": np.zeros_like(model.lexical), "transitions": want - joint.sum(0), "start": g[first].sum(0)}
        grads["lexical"][known[known >= 0]] = per_word[known >= 0]
        grads["lexical"] -= 0.05 * model.lexical
        for name, grad in grads.items():
            sums[name] += grad**2
            setattr(model, name, getattr(model, name) + 0.3 * grad / np.sqrt(sums[name]))
    model.weights, model.lexical = model.weights.astype(np.float32), model.lexical.astype(np.float32)
    return model


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS) -> Model:
    """Learns from text and lang of at most ``per_language`` documents a language that are not held out and have 1 to ``most_chars`` characters."""
    d = docs.where(F.col("lang").isNotNull() & ~held_out() & F.length("text").between(1, most_chars)).select("doc_id", "lang", "text")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = d.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language).select("lang", "text").orderBy("lang", "place").collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def label(docs: DataFrame, model: Model, with_runs: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score (mean probability of that label over words with letters), and runs if asked for.

    runs lists the stretches of words of one label: (lang, first word, number of words). Texts that are null, empty or without a letter are ``und``
    with score 0, and so is every text if the model has no labels. All columns of ``docs`` stay, but for columns of these names, which are replaced.
    """
    added = ["lang_pred", "score", *(["runs"] if with_runs else [])]
    docs = docs.drop(*added)
    place = docs.columns.index("text")
    kinds = {"lang_pred": "string", "score": "double", "runs": "array<struct<lang:string,first:int,words:int>>"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} {kinds[c]}" for c in added)])
    names = np.array([*model.labels, UNKNOWN], object)

    def one(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
        n = len(texts)
        words, ends = split(pc.fill_null(texts, ""))
        best, score, runs = np.full(n, len(model.labels)), np.zeros(n), [[] for _ in range(n)]
        if model.labels and len(words):
            known = _word_scores(model)
            rows = known.rows(words.dictionary)[words.indices.to_numpy()]
            size = np.diff(ends)
            full = np.flatnonzero(size)
            p = forward_backward(known.e[rows], ends[:-1][full], size[full], model)
            lettered = known.letters[rows]
            total = np.zeros((n, len(model.labels)))
            total[full] = np.add.reduceat(p * lettered[:, None], ends[:-1][full], axis=0)
            count = np.zeros(n)
            count[full] = np.add.reduceat(lettered.astype(float), ends[:-1][full])
            sure = np.flatnonzero(count)
            best[sure] = total[sure].argmax(1)
            score[sure] = np.clip(total[sure].max(1) / count[sure], 0, 1)
            if with_runs:
                top = p.argmax(1)
                for i in full:
                    own = top[ends[i] : ends[i + 1]]
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
                    runs[i] = [{"lang": names[own[a]], "first": int(a), "words": int(b - a)} for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return best, score, runs

    def run(batches):
        for batch in batches:
            texts = batch.column(place)
            for i, j in by_bytes(texts, STEP_BYTES):
                best, score, runs = one(texts.slice(i, j - i))
                new = [pa.array(names[best].tolist(), pa.string()), pa.array(score)]
                if with_runs:
                    new.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *new], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, schema)


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return label(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
