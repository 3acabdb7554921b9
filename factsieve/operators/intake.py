"""Gates and assembly of incoming files, pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factsieve.functions.text import count_chars, has_text, matches, scrub_log, tidy_text, trim_space
from factsieve.packs import korean as K

# Limits of intake
MAX_CHARS, SHORT_CHARS, MAX_RANGES = 20_000, 30, 300
MAX_FILE_BYTES, MAX_PDF_PAGES, MAX_OCR_PAGES, MIN_PAGE_CHARS, MAX_IMAGES = 10 * 1024 * 1024, 10, 5, 20, 5
LOW_CONFIDENCE = 60


def gate_input(docs: DataFrame, max_chars: int = MAX_CHARS, types=tuple(K.DOC_TYPES)) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): known type, some text, not too long; short texts are only marked."""
    code = (
        F.when(~F.coalesce(F.col("doc_type").isin(*types), F.lit(False)), "unknown_type")
        .when(~F.coalesce(has_text(F.col("text")), F.lit(False)), "empty")
        .when(F.length("text") > max_chars, "too_long"))
    coded = docs.withColumn("code", code).withColumn("short", F.length(trim_space(F.col("text"))) < SHORT_CHARS)
    return coded.filter(F.col("code").isNull()).drop("code"), coded.filter(F.col("code").isNotNull()).drop("short")


def gate_ranges(docs: DataFrame, ranges: str = "low_confidence") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): at most 300 ranges, each within the text."""
    ok = (F.size(ranges) <= MAX_RANGES) & F.forall(ranges, lambda r: (
        r["start"].isNotNull() & r["end"].isNotNull() & (r["start"] >= 0) & (r["end"] > r["start"])
        & (r["end"] <= F.length("text"))))
    ok = F.coalesce(ok, F.col(ranges).isNull())
    return docs.filter(ok), docs.filter(~ok).withColumn("code", F.lit("invalid_ranges"))


def sniff(content: Column, size: Column) -> Column:
    """struct(code, kind) by the first bytes, never by the name."""
    head = F.hex(F.substring(content, 1, 16))
    starts = lambda sig: F.startswith(head, F.lit(sig))
    # File signatures
    kind = (
        F.when(starts("255044462D"), "pdf").when(starts("FFD8FF"), "jpeg").when(starts("89504E470D0A1A0A"), "png")
        .when(starts("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp"))
    code = (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > MAX_FILE_BYTES, "too_large")
        .when(kind.isNull(), "unsupported_type"))
    return F.struct(code.alias("code"), F.when(code.isNull(), kind).alias("kind"))


def sniff_files(files: DataFrame, content: str = "content", length: str = "length") -> DataFrame:
    s = sniff(F.col(content), F.col(length))
    return files.withColumn("_s", s).select("*", F.col("_s.code").alias("code"), F.col("_s.kind").alias("kind")).drop("_s", content)


def plan_submission(files: DataFrame, room: int = MAX_IMAGES) -> tuple[DataFrame, DataFrame]:
    """(submissions, files with their fate) (S5). ``files``: submission_id, position, name, code, kind.

    Only the positions of the first images are kept as state, so a submission may hold any number of files.
    """
    ok = F.col("code").isNull()
    image = ok & (F.col("kind") != "pdf")
    per = files.groupBy("submission_id").agg(
        F.count_if(ok & (F.col("kind") == "pdf")).alias("pdfs"), F.count_if(image).alias("images"),
        F.count_if(~ok).alias("rejected"))
    error = F.when(F.col("pdfs") > 1, "multiple_pdfs").when((F.col("pdfs") == 1) & (F.col("images") > 0), "pdf_with_images")
    plans = per.select(
        "submission_id", "pdfs", "images", "rejected", error.alias("error"),
        F.when(error.isNull() & (F.col("pdfs") == 0), F.greatest(F.col("images") - room, F.lit(0))).otherwise(0).alias("overflow"))
    images = files.filter(image)
    # first ``room`` images: rank within coarse position blocks first, then among the block winners
    block = Window.partitionBy("submission_id", F.floor(F.col("position") / 1000)).orderBy("position", "name")
    few = images.withColumn("_r", F.row_number().over(block)).filter(F.col("_r") <= room).drop("_r")
    place = F.row_number().over(Window.partitionBy("submission_id").orderBy("position", "name"))
    kept = few.withColumn("place", place).filter(F.col("place") <= room)
    kept = kept.join(plans.filter(F.col("error").isNull() & (F.col("pdfs") == 0)).select("submission_id"), "submission_id", "left_semi")
    return plans, kept


def page_text_from_items(items: DataFrame, *keys: str) -> DataFrame:
    """Page text from positioned text items (S6): ``pos``, ``str``, ``has_eol``."""
    piece = F.concat(F.col("str"), F.when(F.col("has_eol"), "\n").otherwise(""))
    rows = items.filter(F.col("str").isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", piece.alias("s")))).alias("_p"))
    return rows.select(*keys, tidy_text(F.array_join(F.transform("_p", lambda p: p["s"]), "")).alias("text"))


def route_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with ``scanned``, files with method or error)."""
    marked = pages.withColumn("scanned", count_chars(F.coalesce("text", F.lit(""))) < MIN_PAGE_CHARS)
    per = marked.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("scanned").alias("scanned_pages"))
    error = F.when(F.col("pages") > MAX_PDF_PAGES, "too_many_pages").when(
        F.col("scanned_pages") > MAX_OCR_PAGES, "too_many_scanned_pages")
    method = F.when(F.col("scanned_pages") == 0, "pdf-text").when(
        F.col("scanned_pages") == F.col("pages"), "ocr").otherwise("mixed")
    return marked, per.withColumn("error", error).withColumn("method", F.when(error.isNull(), method))


def page_anchors(pages: DataFrame) -> DataFrame:
    """Adds ``anchor`` (empty pages: where their text would go) and ``end_anchor`` (S9). Needs at most the
    pages of one document per key."""
    tidy = tidy_text(F.coalesce("text", F.lit("")))
    rows = pages.withColumn("_len", F.length(tidy))
    upto = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    chars, filled = F.sum("_len").over(upto), F.sum(F.when(F.col("_len") > 0, 1).otherwise(0)).over(upto)
    end = chars + F.greatest(filled - 1, F.lit(0)) * 2
    return rows.withColumn("_end", end).select(
        *pages.columns, F.when(F.col("_len") == 0, F.col("_end")).alias("anchor"),
        F.when(F.col("_len") > 0, F.col("_end")).alias("end_anchor"))


def join_pages(pages: DataFrame) -> DataFrame:
    """One text per document: tidied, non-empty pages with a blank line between."""
    parts = pages.select("doc_id", "page_no", tidy_text(F.coalesce("text", F.lit(""))).alias("t")).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_no", "t"))).alias("p"))
    kept = F.filter(F.transform("p", lambda x: x["t"]), lambda t: t != "")
    return parts.select("doc_id", F.array_join(kept, "\n\n").alias("text"))


def combine_images(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, issues) from image readings.

    ``results``: doc_id, page_no, ok, code, text, quality, confidence, partial, uncertain array<string>.
    """
    good = F.col("ok") & has_text(F.coalesce("text", F.lit("")))
    quality = F.coalesce("quality", F.when(F.col("confidence") < LOW_CONFIDENCE, "low").otherwise("good"))
    rows = page_anchors(results.withColumn("text", F.when(good, F.col("text")).otherwise("")).withColumn("_good", good)
                        .withColumn("quality", quality))
    texts = join_pages(rows)
    facts = rows.groupBy("doc_id").agg(
        F.count_if("_good").alias("ok_count"), F.bool_or(F.col("_good") & (F.col("quality") == "low")).alias("low_confidence"))
    issues = rows.filter(~F.col("_good") | (F.col("quality") != "good")).select(
        "doc_id", "page_no", F.when(F.col("_good"), "review").otherwise("failed").alias("kind"),
        F.when(~F.col("_good"), F.when(F.col("ok"), "no_text_found").otherwise(F.col("code"))).alias("code"),
        F.when(F.col("_good"), F.col("quality")).alias("quality"),
        F.coalesce("anchor", "end_anchor").alias("anchor"), F.coalesce("partial", F.lit(False)).alias("partial"))
    return texts.join(facts, "doc_id"), issues


# Provider answers to error codes
FATAL = ("missing_key", "auth_failed", "rate_limited", "timeout", "bad_request", "model_not_found")


def classify_errors(log: DataFrame) -> DataFrame:
    """Adds ``code``, ``fatal``, ``route`` and a scrubbed ``message``.

    ``log``: http_status INT, provider_status, provider_reason, name, message.
    """
    s = F.col("http_status")
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    message = scrub_log(F.col("message"))
    code = (
        F.when(F.col("name").isin("TimeoutError", "AbortError"), "timeout")
        .when(s.isNull() & F.col("provider_status").isNull(), "connection_failed")
        .when((s == 429) | is_("provider_status", "RESOURCE_EXHAUSTED"), "rate_limited")
        .when(s.isin(401, 403) | is_("provider_reason", "API_KEY_INVALID")
              | F.coalesce(matches(message, r"(?i)API key not valid"), F.lit(False)), "auth_failed")
        .when(s == 404, "model_not_found").when(s.between(400, 499), "bad_request").otherwise("api_error"))
    return log.withColumn("message", message).withColumn("code", code).withColumns({
        "fatal": F.col("code").isin(*FATAL),
        "route": F.when(s.isin(400, 413), "input").otherwise("error")})
