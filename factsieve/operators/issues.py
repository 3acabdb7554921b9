"""Pages that could not be read, or perhaps not in full, and how they were settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.text import has_text, matches, trim_space

# What may settle which kind of issue
ALLOWED = {"failed": ("manual_input", "blank_confirmed"), "suspect": ("supplemented", "range_checked")}
NEEDS_TEXT = ("manual_input", "supplemented")


def build_issues(failed: DataFrame, suspect: DataFrame, unit: str = "image") -> DataFrame:
    """Issues from failed(doc_id, page_no, code, anchor, previewed) and suspect(doc_id, page_no, reason, anchor)."""
    page = F.col("page_no").cast("string")
    label = F.concat(F.lit("PDF "), page, F.lit("쪽")) if unit == "pdf" else F.concat(page, F.lit("번째 이미지"))
    code = F.coalesce(F.col("code"), F.lit("no_text_found"))

    def shape(df: DataFrame, kind: str, code: Column, reason: Column, blank: Column) -> DataFrame:
        return df.select(
            "doc_id", F.concat(F.lit(f"{kind}-"), page).alias("issue_id"), F.lit(kind).alias("kind"), label.alias("label"),
            F.col("page_no").alias("position"), code.alias("code"), reason.alias("reason"), blank.alias("can_confirm_blank"),
            F.col("anchor"), F.col("anchor").alias("original_anchor"), F.lit("").alias("supplement"),
            F.lit(None).cast("string").alias("resolution"))

    none = F.lit(None).cast("string")
    return shape(failed, "failed", code, none, (code == "no_text_found") & F.col("previewed")).unionByName(
        shape(suspect, "suspect", none, F.coalesce("reason", F.lit("low_confidence")), F.lit(False)))


def resolve_issues(issues: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, rejected events) (P9). ``events``: doc_id, issue_id, event_no, resolution, supplement.

    The last valid resolution and the last supplement win.
    """
    typed = events.groupBy("doc_id", "issue_id").agg(
        F.max_by("supplement", F.when(F.col("supplement").isNotNull(), F.col("event_no"))).alias("_text"))
    base = issues.join(typed, ["doc_id", "issue_id"], "left").withColumn("supplement", F.coalesce("_text", "supplement")).drop("_text")
    asked = events.filter(F.col("resolution").isNotNull()).join(
        base.select("doc_id", "issue_id", "kind", "can_confirm_blank", F.col("supplement").alias("_s")), ["doc_id", "issue_id"], "left")
    allowed = F.lit(False)
    for kind, names in ALLOWED.items():
        allowed = allowed | ((F.col("kind") == kind) & F.col("resolution").isin(*names))
    code = (
        F.when(F.col("kind").isNull(), "unknown_issue").when(~allowed, "resolution_not_allowed")
        .when(F.col("resolution").isin(*NEEDS_TEXT) & ~has_text(F.col("_s")), "no_page_input")
        .when((F.col("resolution") == "blank_confirmed") & ~F.col("can_confirm_blank"), "blank_not_checkable"))
    judged = asked.withColumn("code", code)
    last = judged.filter(F.col("code").isNull()).groupBy("doc_id", "issue_id").agg(F.max_by("resolution", "event_no").alias("_r"))
    out = base.join(last, ["doc_id", "issue_id"], "left").withColumn("resolution", F.coalesce("_r", "resolution")).drop("_r")
    return out, judged.filter(F.col("code").isNotNull()).select("doc_id", "issue_id", "event_no", "resolution", "code")


def resolved() -> Column:
    text_ok = ~F.col("resolution").isin(*NEEDS_TEXT) | has_text(F.col("supplement"))
    return F.col("resolution").isNotNull() & text_ok


def blocking(issues: DataFrame) -> DataFrame:
    """Open issues per document."""
    return issues.groupBy("doc_id").agg(F.count_if(~resolved()).alias("open"), F.count("*").alias("issues"))


def reset_issues(issues: DataFrame) -> DataFrame:
    """Back to the text as extracted (P10)."""
    return issues.withColumns({
        "resolution": F.when(~F.col("resolution").isin(*NEEDS_TEXT), F.col("resolution")),
        "supplement": F.lit(""), "anchor": F.col("original_anchor")})


def shift_anchors(issues: DataFrame, edits: DataFrame) -> DataFrame:
    """Anchors moved by one edit per document (P10). ``edits``: doc_id, start, old_end, new_end."""
    moved = (
        F.when(F.col("start").isNull() | (F.col("anchor") < F.col("start")), F.col("anchor"))
        .when(F.col("anchor") >= F.col("old_end"), F.col("anchor") + F.col("new_end") - F.col("old_end"))
        .otherwise(F.col("start")))
    return issues.join(edits, "doc_id", "left").withColumn("anchor", moved).drop("start", "old_end", "new_end")


def _gap(piece: Column, before: Column) -> Column:
    """What stands between two neighbouring pieces; a supplement is kept apart by an empty line, white space that is there counts."""
    open_line = F.when(before["body"].endswith("\n\n"), "").when(before["body"].endswith("\n"), "\n").otherwise("\n\n")
    own = F.when(before["added"] & ~matches(piece["body"], r"^\s"), "\n\n").otherwise("")
    return F.when(before.isNull(), "").otherwise(F.when(piece["added"], open_line).otherwise(own))


def assemble_text(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Text with the supplements in their places; uncertain ranges move along.

    ``docs``: doc_id, text, low_confidence. A document has at most as many issues as pages. The text is cut at the places of the supplements; its parts and
    the supplements are one row of pieces, and what separates two neighbours depends on these two alone. A range lies in the part that holds its start, or
    follows the part that ends there. Documents without a supplement stay as they are.
    """
    use = issues.filter(F.col("resolution").isin(*NEEDS_TEXT) & has_text(F.col("supplement")))
    n = F.length("text")
    supplement = F.struct(F.coalesce("anchor", F.lit(2**31 - 1)).alias("anchor"), "position", trim_space(F.col("supplement")).alias("body"))
    added = use.groupBy("doc_id").agg(F.array_sort(F.collect_list(supplement)).alias("_added"))

    def clamped(x: Column) -> Column:
        return F.struct(F.least(F.greatest(x["anchor"], F.lit(0)), n).cast("int").alias("at"), x["body"].alias("body"))

    def part(low: Column, high: Column) -> Column:
        return F.struct(F.lit(False).alias("added"), low.alias("low"), high.alias("high"), F.substring("text", low + 1, high - low).alias("body"))

    def entry(x: Column, i: Column) -> Column:
        low = F.coalesce(F.get("_added", i - 1)["at"], F.lit(0))
        return F.array(part(low, x["at"]), F.struct(F.lit(True).alias("added"), x["at"].alias("low"), x["at"].alias("high"), x["body"].alias("body")))

    last = F.array(part(F.element_at("_added", -1)["at"], n))
    on = docs.join(added, "doc_id", "left").withColumn("_added", F.transform("_added", clamped))
    cut = on.withColumn("_cut", F.filter(F.concat(F.flatten(F.transform("_added", entry)), last), lambda p: p["body"] != ""))
    spaced = cut.withColumn("_spaced", F.transform("_cut", lambda p, i: F.struct(p.alias("piece"), _gap(p, F.get("_cut", i - 1)).alias("gap"))))
    width = lambda s: F.length(s["gap"]) + F.length(s["piece"]["body"])
    begins = F.transform("_spaced", lambda s, i: F.aggregate(F.slice("_spaced", F.lit(1), i), F.length(s["gap"]), lambda t, x: t + width(x)))
    own = F.filter(F.zip_with("_spaced", "_begins", lambda s, at: F.struct(s["piece"].alias("piece"), at.alias("at"))), lambda x: ~x["piece"]["added"])
    spaced = spaced.withColumn("_begins", begins).withColumn("_own", own)

    def moved(r: Column) -> Column:
        inside = F.filter("_own", lambda x: (x["piece"]["low"] <= r["start"]) & (r["start"] < x["piece"]["high"]))
        ended = F.filter("_own", lambda x: x["piece"]["high"] == r["start"])
        home = F.get(F.concat(inside, ended), F.lit(0))
        at = F.coalesce(home["at"] + r["start"] - home["piece"]["low"], r["start"]).cast("int")
        return F.struct(at.alias("start"), (at + r["end"] - r["start"]).alias("end"))

    whole = F.array_join(F.transform("_spaced", lambda s: F.concat(s["gap"], s["piece"]["body"])), "")
    return spaced.select(
        "doc_id", F.when(F.col("_added").isNull(), F.col("text")).otherwise(whole).alias("text"),
        F.when(F.col("_added").isNull(), F.col("low_confidence")).otherwise(F.transform("low_confidence", moved)).alias("low_confidence"))


def result_notes(issues: DataFrame) -> DataFrame:
    """Labels per way of settling."""
    return issues.filter(F.col("resolution").isNotNull()).groupBy("doc_id", "resolution").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]), ", ").alias("labels"))
