"""Secret scans: fixed forms, and a battery of randomness tests on other long strings.

The forms give the base spans. Beside them, every run of 20 or more letters, digits and ``+/_-``, with the ``=`` that end it,
is a candidate. Its encoding is inferred (hex, base32, base36, base62, base64, or letters of one case or two: the smallest alphabet that fits), its characters become numbers of that alphabet,
and five tests ask if they could be uniform and independent: the shares of upper case, lower case, digits and signs, chi-squared
within these classes, runs about the middle, serial correlation, and letter pairs as in the words of the table. Fisher's method joins them. Ordinary strings are discoveries against randomness, found under the
Benjamini-Hochberg rule within bands of length, since short strings carry little evidence; candidates that are no
discovery, in a band that could have made one, are reported as ``random``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factsieve.llm.common import table, written

#: Fixed patterns: kind, what is searched, the group whose length counts and its least length.
FORMS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # maximal runs: shorter ones would be dropped
]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}=*"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order in which they are tried: name, pattern of the whole string, alphabet. Their classes of characters are ``CLASSES``.
ENCODINGS = [
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base26", "^(?:[a-z]+|[A-Z]+)$", LOWER),
    ("base32", "^[A-Z2-7]+=*$", UPPER + "234567"),
    ("base36", "^(?:[0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER),
    ("base52", "^[A-Za-z]+$", UPPER + LOWER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[0-9A-Za-z+/_-]+=*$", DIGITS + UPPER + LOWER + "+/"),
]
#: Classes of characters.
CHARS = {"digit": "0-9", "upper": "A-Z", "lower": "a-z", "sign": "+/"}
#: Classes of an encoding: which of ``CHARS`` they join and their number of characters. In hex, base26 and base36 all letters have one case.
CLASSES = {
    "hex": [(["digit"], 10), (["upper", "lower"], 6)],
    "base26": [(["upper", "lower"], 26)],
    "base32": [(["digit"], 6), (["upper"], 26)],
    "base36": [(["digit"], 10), (["upper", "lower"], 26)],
    "base52": [(["upper"], 26), (["lower"], 26)],
    "base62": [(["digit"], 10), (["upper"], 26), (["lower"], 26)],
    "base64": [(["digit"], 10), (["upper"], 26), (["lower"], 26), (["sign"], 2)],
}
#: Words from whose letter pairs prose is known.
WORD = "(?<![0-9a-z+/_=-])[a-z]{3,19}(?![0-9a-z+/_=-])"
FALSE_SHARE = 0.05
#: Steps of log10 p in which p-values are counted; a p-value counts as the upper end of its step.
STEPS_PER_DECADE, DECADES = 50, 40


def _numbered(kind: str):
    return lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["word"].alias("word"), x["part"].alias("part"))


def _of(kind: str):
    return lambda x: x["kind"] == kind


def _hits(docs: DataFrame) -> DataFrame:
    """uid, doc_id and, for each match in a text, kind, start, end, word, marked; one row with nulls for a text without any.

    Starts are running sums over the stretches between matches and the matches, so the cost is linear in the text.
    """
    t = F.col("text")
    groups = []
    for kind, pattern, group, _least in [*FORMS, ("random", CANDIDATE, 0, 20)]:
        whole, part = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        found = F.transform(F.arrays_zip(F.split(t, pattern, -1).alias("gap"), whole.alias("word"), part.alias("part")), _numbered(kind))
        groups.append(F.when(t.rlike(pattern), found))
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,word:string,part:string>>")
    d = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("uid", "doc_id", F.explode_outer(F.concat(*[F.coalesce(g, none) for g in groups])).alias("m")).select("uid", "doc_id", "m.*")
    ahead = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("word"), F.lit(0))).over(ahead))
    d = d.withColumn("start", F.col("end") - F.length("word"))
    enough = F.lit(False)
    for kind, _pattern, _group, least in FORMS:
        enough = enough | ((F.col("kind") == kind) & (F.length("part") >= least))
    return d.select("uid", "doc_id", "kind", "start", "end", "word", enough.alias("base"), (F.col("kind") == "random").alias("open"))


def _upper_normal(z: Column) -> Column:
    """P(Z > z) for z >= 0: the rational approximation of Abramowitz and Stegun, 26.2.17."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) / 2.5066282746310002 * poly, F.lit(1e-300))


def letter_habits(docs: DataFrame) -> np.ndarray:
    """26 x 26: ln of how much likelier a letter follows another in the distinct words of all whole texts of ``docs`` than at random. At most 676 rows reach the driver."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("w")).distinct()
    pairs = words.select(F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("pair"))
    seen = np.ones((26, 26))
    for pair, k in pairs.groupBy("pair").count().collect():
        seen[LOWER.index(pair[0]), LOWER.index(pair[1])] += k
    return np.log(26 * seen / seen.sum(1, keepdims=True))


def _features(strings: DataFrame, habits: np.ndarray, col: str) -> DataFrame:
    """``strings`` with encoding, n and the numbers from which the tests follow, each one flat pass over the characters."""
    word = F.regexp_replace(F.col(col), "=+$", "")
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, letters in reversed(ENCODINGS):
        encoding, alphabet = F.when(word.rlike(pattern), name).otherwise(encoding), F.when(word.rlike(pattern), letters).otherwise(alphabet)
    s = strings.withColumns({"encoding": encoding, "_abc": alphabet})
    low = F.when(F.col("encoding").isin("hex", "base26", "base36"), F.lower(word)).otherwise(F.translate(word, "-_", "+/"))
    s = s.withColumn("_s", low).withColumn("n", F.length("_s")).withColumn("_a", F.length("_abc").cast("double"))
    # how many characters each class has; an encoding adds some of them up
    s = s.withColumns({f"_of_{name}": F.col("n") - F.length(F.regexp_replace("_s", f"[{chars}]", "")) for name, chars in CHARS.items()})
    s = s.withColumn("_v", F.expr("transform(split(_s, ''), c -> cast(locate(c, _abc) - 1 as double))"))
    # sum of squared counts of the characters
    s = s.withColumn("_q", F.expr("aggregate(array_distinct(_v), 0D, (t, x) -> t + power(size(filter(_v, y -> y = x)), 2))"))
    # characters above the middle of the alphabet, runs below and above it
    s = s.withColumn("_high", F.expr("cast(size(filter(_v, x -> x >= _a / 2)) as double)"))
    s = s.withColumn("_runs", F.expr("1D + size(filter(zip_with(slice(_v, 1, n - 1), slice(_v, 2, n - 1), (x, y) -> (x >= _a / 2) <> (y >= _a / 2)), b -> b))"))
    # spread, and products of neighbours
    s = s.withColumn("_m", F.expr("aggregate(_v, 0D, (t, x) -> t + x) / n"))
    s = s.withColumn("_ss", F.expr("aggregate(_v, 0D, (t, x) -> t + power(x - _m, 2))"))
    s = s.withColumn("_sc", F.expr("aggregate(zip_with(slice(_v, 1, n - 1), slice(_v, 2, n - 1), (x, y) -> (x - _m) * (y - _m)), 0D, (t, x) -> t + x)"))
    # letter pairs and the sum of their habits
    s = s.withColumn("_c", F.expr("transform(split(lower(_s), ''), c -> ascii(c) - 97)"))
    s = s.withColumn("_pairs", F.expr("filter(zip_with(slice(_c, 1, n - 1), slice(_c, 2, n - 1), (x, y) -> if(x between 0 and 25 and y between 0 and 25, x * 26 + y, -1)), v -> v >= 0)"))
    known = F.split(F.lit(" ".join(repr(float(x)) for x in habits.ravel())), " ").cast("array<double>")  # one literal, not 676 in each plan
    s = s.withColumn("_known", known)
    s = s.withColumn("_sum", F.aggregate("_pairs", F.lit(0.0), lambda t, v: t + F.get("_known", v))).withColumn("_k", F.size("_pairs").cast("double"))
    return s.drop("_abc", "_s", "_v", "_m", "_c", "_pairs", "_known")


def battery(strings: DataFrame, habits: np.ndarray, col: str = "word") -> DataFrame:
    """``strings`` with encoding, n and p: that of uniform, independent characters of the encoding. Null p: no encoding fits or too short.

    The numbers of each string are written first, so that the tests are a second plan over numeric columns and neither plan is large.
    """
    s = written(_features(strings, habits, col), "features")
    n, a = F.col("n").cast("double"), F.col("_a")
    # shares of the classes of characters
    between, free = F.lit(None).cast("double"), F.lit(None).cast("int")
    for name, classes in CLASSES.items():
        size = sum(k for _, k in classes)
        parts = [(sum(F.col(f"_of_{c}") for c in of) - n * k / size) ** 2 / (n * k / size) for of, k in classes]
        between = F.when(F.col("encoding") == name, sum(parts[1:], parts[0])).otherwise(between)
        free = F.when(F.col("encoding") == name, len(classes) - 1).otherwise(free)
    s = s.withColumns({"_between": between, "_free": free})
    # uniformity within the classes: what the classes explain is taken off
    chi = a / n * F.col("_q") - n
    left = a - 1 - F.col("_free")
    s = s.withColumn("_z1", (chi - F.col("_between") - left) / F.sqrt(2 * left * (n - 1) / n))
    hi, lo = F.col("_high"), n - F.col("_high")
    mean = 2 * hi * lo / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    s = s.withColumn("_z2", F.when(var > 0, F.abs(F.col("_runs") - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(5.0)))
    # serial correlation of neighbours
    z_sc = F.abs(F.col("_sc") / F.greatest(F.col("_ss"), F.lit(1e-9)) + 1 / n) * F.sqrt(n)
    s = s.withColumn("_z3", F.when(F.col("_ss") > 0, z_sc).otherwise(F.lit(5.0)))

    # letter pairs: the sum of their habits against its mean and deviation at random, pairs that share a letter included
    def z_pairs(table: np.ndarray) -> Column:
        m, mean = F.col("_k"), float(table.mean())
        shared = float((table.mean(0) * table.mean(1)).mean()) - mean**2
        spread = m * float(table.var()) + 2 * F.greatest(m - 1, F.lit(0.0)) * shared
        return F.when(spread > 1e-6, (F.col("_sum") - m * mean) / F.sqrt(F.greatest(spread, F.lit(1e-6)))).otherwise(F.lit(0.0))

    s = s.withColumn("_z4", F.when(F.col("encoding") == "hex", z_pairs(habits[:6, :6])).otherwise(z_pairs(habits)))
    s = s.withColumn("_z5", F.sqrt("_between"))
    s = s.withColumns({f"_t{k}": _upper_normal(F.abs(F.col(f"_z{k}"))) for k in (1, 2, 3, 4, 5)})
    # one-sided tests of uniformity and letter pairs, two-sided ones of runs and correlation, chi-squared with 1 to 3 degrees of freedom
    s = s.withColumns({f"_p{k}": F.when(F.col(f"_z{k}") >= 0, F.col(f"_t{k}")).otherwise(1 - F.col(f"_t{k}")) for k in (1, 4)})
    s = s.withColumns({f"_p{k}": 2 * F.col(f"_t{k}") for k in (2, 3)})
    tail = F.greatest(F.exp(-F.col("_between") / 2), F.lit(1e-300))
    s = s.withColumn("_p5", F.when(F.col("_free") == 0, 0.5).when(F.col("_free") == 2, tail).otherwise(2 * F.col("_t5") + F.when(F.col("_free") == 3, F.sqrt(F.col("_between") * 0.6366197723675814) * tail).otherwise(0.0)))
    # half of Fisher's statistic, 10 degrees of freedom
    logs = [F.log(F.least(F.col(f"_p{k}"), F.lit(1.0))) for k in (1, 2, 3, 4, 5)]
    s = s.withColumn("_h", -sum(logs[1:], logs[0]))
    h = F.col("_h")
    p = F.exp(-h) * (1 + h * (1 + h / 2 * (1 + h / 3 * (1 + h / 4))))
    s = s.withColumn("p", F.when(F.col("encoding").isNotNull() & (F.col("n") >= 16), F.least(p, F.lit(1.0))))
    return s.drop(*[c for c in s.columns if c.startswith("_")])


def discoveries(tested: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """band and least step of log10 p that is no discovery. Bands are doublings of length; at most ``STEPS_PER_DECADE * DECADES`` steps each.

    The Benjamini-Hochberg rule on p-values rounded up to their step: counts per step and running sums, not a sort of all strings.
    """
    per = tested.groupBy("band", "step").agg(F.count(F.lit(1)).alias("k"))
    up = Window.partitionBy("band").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("below", F.sum("k").over(up)).withColumn("all", F.sum("k").over(Window.partitionBy("band")))
    passes = F.pow(F.lit(10.0), -F.col("step") / STEPS_PER_DECADE) <= F.lit(share) * F.col("below") / F.col("all")
    return per.groupBy("band").agg(F.min(F.when(passes, F.col("step"))).alias("cut"))


def scan(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans and found, the spans as an array of (kind, start, end).

    Offsets are code points. Null and empty texts have no spans; equal rows are counted one by one; other columns are ignored.
    A candidate that meets a base span is not tested: the span stands for it.
    """
    hits = written(_hits(docs), "hits")
    by_start = Window.partitionBy("uid").orderBy("start", "end")
    last = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = (F.coalesce(last, F.lit(-1)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end"))
    placed = hits.where("start IS NOT NULL AND (base OR open)").withColumn("free", F.col("open") & free)
    tested = battery(placed.where("free").select("uid", "start", "end", "word"), letter_habits(docs))
    step = F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-300))) * STEPS_PER_DECADE), F.lit(STEPS_PER_DECADE * DECADES)).cast("int")
    tested = written(tested.where("p IS NOT NULL").select("uid", "start", "end", F.floor(F.log2("n")).cast("int").alias("band"), step.alias("step")), "tested")
    cuts = discoveries(tested, share)
    random = tested.join(cuts, "band").where("step < coalesce(cut, 2147483647)").select("uid", F.lit("random").alias("kind"), "start", "end")
    every = hits.select("uid", "doc_id", F.when(F.col("base"), F.col("kind")).alias("kind"), F.when(F.col("base"), F.col("start")).alias("start"), F.when(F.col("base"), F.col("end")).alias("end"))
    every = every.unionByName(random.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    place = F.array_position(F.array(*[F.lit(k) for k, *_ in FORMS], F.lit("random")), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", place.alias("place"), "end", "kind"))
    g = every.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("s"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("s", lambda x: x["kind"] != "random")
    counts = [F.size(F.filter("s", _of(k))).cast("long").alias(f"n_{k}") for k, *_ in FORMS]
    found = F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return g.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), found.alias("found"))


def op9_secret_scans(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).drop("found")
