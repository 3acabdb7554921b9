"""Agreement and accuracy measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.arrays import let
from factsieve.functions.text import char_similarity, extract_all, squeeze

NUMBER = r"\d[\d,.:~-]*\d|\d"  # Fixed value: a group of digits as written


def oracle_match(actual: DataFrame, oracle: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Cells that agree, per group and in total; cells without an expectation are not scored (K1)."""
    scored = oracle.join(actual, keys, "left")
    hit = F.coalesce(F.col("actual") == F.col("expected"), F.lit(False))
    return scored.rollup(group).agg(
        F.count_if(hit).cast("bigint").alias("matched"), F.count("*").alias("scored"))


def best_line(truth: Column, read_lines: Column) -> Column:
    """struct(sim, at): most similar line read, 1 if it holds the whole truth line; first of equals.

    A cell holds the lines of one page, so the comparison stays inside its row.
    """
    return best_squeezed(squeeze(truth), F.transform(read_lines, squeeze))


def best_squeezed(truth: Column, read_lines: Column) -> Column:
    """``best_line`` of texts without blanks. A lambda keeps nothing, so what is used more than once is bound and nothing else is worked out per pair."""

    def of_line(t: Column) -> Column:
        def score(o: Column, i: Column) -> Column:
            longest = F.greatest(F.length(t), F.length(o))
            sim = F.when(F.contains(o, t), F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(t, o) / longest)
            return F.struct(sim.alias("sim"), (-i).alias("at"))

        return let(F.array_max(F.transform(read_lines, score)), shown)

    def shown(best: Column) -> Column:
        found = best["sim"] > 0
        return F.struct(F.when(found, best["sim"]).otherwise(0.0).alias("sim"), F.when(found, -best["at"]).otherwise(-1).alias("at"))

    return let(truth, of_line)


def image_scores(pages: DataFrame) -> DataFrame:
    """Scores per page (K2-K6). ``pages``: page keys, truth array<string>, pairs array<struct<k,v>>, items
    array<string>, text."""
    lines = F.filter(F.split("text", "\n"), lambda l: F.length(squeeze(l)) > 0)
    base = pages.withColumns({"_lines": F.transform(lines, squeeze), "_truth": F.transform("truth", squeeze), "_sq": squeeze(F.col("text"))})
    base = base.withColumn("_items", F.transform("items", lambda i: F.struct(i.alias("is"), squeeze(i).alias("sq"))))
    sims = F.transform("_truth", lambda t: best_squeezed(t, F.col("_lines"))["sim"])
    numbers = F.flatten(F.transform("_truth", lambda t: extract_all(t, NUMBER)))

    def pair_ok(p: Column) -> Column:
        k, v = squeeze(p["k"]), squeeze(p["v"])
        return F.exists("_lines", lambda l: (F.position(k, l) > 0) & (F.position(v, l, F.position(k, l) + F.length(k)) > 0))

    def item_ok(it: Column) -> Column:
        return let(F.filter("_items", lambda o: o["is"] != it["is"]), lambda others: F.exists("_lines", lambda l: F.contains(l, it["sq"]) & ~F.exists(
            others, lambda o: F.contains(l, o["sq"]))))

    return base.withColumns({"_sims": sims, "_numbers": numbers}).withColumns({
        "char_acc": char_similarity(F.array_join("truth", "\n"), F.col("text")),
        "lines_total": F.size("truth"),
        "lines_ok": F.size(F.filter("_sims", lambda s: s >= 0.9)),
        "pairs_total": F.size("pairs"), "pairs_ok": F.size(F.filter("pairs", pair_ok)),
        "nums_total": F.size("_numbers"),
        "nums_ok": F.size(F.filter("_numbers", lambda n: F.contains(F.col("_sq"), n))),
        "items_total": F.size("items"), "items_ok": F.size(F.filter("_items", item_ok)),
    }).withColumn("line_recall", F.col("lines_ok") / F.nullif(F.col("lines_total"), F.lit(0))).drop(
        "_lines", "_truth", "_items", "_sq", "_sims", "_numbers")


def order_kept(sets: DataFrame) -> DataFrame:
    """Are the first and last lines of each part found in order, each at least 0.6 alike? (K7)

    ``sets``: set_name, marks array<string> (first and last truth line of every part, in order), text.
    """
    lines = F.filter(F.split("text", "\n"), lambda l: F.length(squeeze(l)) > 0)
    placed = sets.withColumn("_lines", lines).withColumn("_best", F.transform("marks", lambda m: best_line(m, F.col("_lines"))))
    fine = F.forall(F.sequence(F.lit(1), F.greatest(F.size("_best") - 1, F.lit(1))), lambda i: (F.size("_best") < 2) | (
        (F.get("_best", i)["at"] >= F.get("_best", i - 1)["at"]) & (F.get("_best", i)["sim"] >= 0.6)))
    return placed.select("set_name", F.coalesce(fine, F.lit(True)).alias("ordered"))


def before_after(before: DataFrame, after: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Two runs side by side, items of either kept (K8)."""
    b = before.select(*keys, *[F.col(m).alias(f"{m}_before") for m in measures])
    a = after.select(*keys, *[F.col(m).alias(f"{m}_after") for m in measures])
    out = b.join(a, keys, "full_outer")
    return out.withColumns({f"{m}_change": F.col(f"{m}_after") - F.col(f"{m}_before") for m in measures})


# What a source kind has to reach
THRESHOLDS = {"text_pdf": 0.98, "image": 0.90, "photo": 0.70}


def threshold_check(scores: DataFrame, kind: str = "kind", score: str = "char_acc") -> DataFrame:
    """Rows that miss the minimum of their kind (K9)."""
    need = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    return scores.withColumn("minimum", F.try_element_at(need, F.col(kind))).filter(F.col(score) < F.col("minimum"))
