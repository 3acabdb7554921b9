"""WARC archives and the assembly of transactions.

An archive is written by Spark's text writer, gzipped: a record is a line and the two line ends after it are the line separator. It is read
as binary files and cut by the content lengths, never by looking for separators.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.common import fresh_path, table, written

CRLF = "\r\n"
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Size before compression that an archive file has on average; a reader holds one at a time.
FILE_BYTES = 16 << 20
RECORD = ("record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
          "digest string, payload_bytes long, payload_digest string, fields map<string,string>")


def _head(kind: str, rows: list[tuple[str, object]], block):
    """A record: header lines (null values are left out), an empty line, the block."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in rows]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def _uuid(kind: str, *parts):
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def archive_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least: int = REVISIT_BYTES) -> DataFrame:
    """One text record (column value) for the request, the response or revisit and the metadata of each page.

    Of pages with equal payloads of ``least`` bytes or more, that with the largest page_id is the response and the others
    revisit it. Line ends in a url are escaped; a null url leaves the header out.
    """
    p = pages.select(F.col("page_id").cast("long"), F.regexp_replace("url", r"[\r\n]", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"sha": F.sha1("html"), "bytes": F.octet_length("html")})
    tops = p.where(F.col("bytes") >= least).groupBy("sha").agg(F.max("page_id").alias("top"), F.max_by("url", "page_id").alias("top_url"))
    p = p.join(tops, "sha", "left")
    again = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("top"))
    own = _uuid("response", F.col("page_id"), F.col("sha"))
    digest = F.concat(F.lit("sha1:"), F.col("sha"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    when, uri, link = ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own)
    response = _head("response", [("WARC-Record-ID", own), when, uri, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("html")))
    revisit = _head("revisit", [("WARC-Record-ID", own), when, uri, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                ("WARC-Refers-To", _uuid("response", F.col("top"), F.col("sha"))), ("WARC-Refers-To-Target-URI", F.col("top_url")), ("WARC-Payload-Digest", digest),
                                ("Content-Type", F.lit("application/http; msgtype=response"))], http)
    request = _head("request", [("WARC-Record-ID", _uuid("request", F.col("page_id"), F.col("sha"))), when, uri, link, ("Content-Type", F.lit("application/http; msgtype=request"))],
                    F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _head("metadata", [("WARC-Record-ID", _uuid("metadata", F.col("page_id"), F.col("sha"))), when, uri, link, ("Content-Type", F.lit("application/warc-fields"))], fields)
    return p.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> str:
    """Archives below ``path``, each of about ``file_bytes``: records are written where the join on digests left them."""
    total, n = pages.select(F.sum(F.octet_length("html") + F.lit(1500)), F.count(F.lit(1))).first()
    most = max(3, int(3 * (n or 1) * file_bytes // (total or 1)))
    archive_records(pages).select("value").write.options(lineSep=CRLF + CRLF, compression="gzip", maxRecordsPerFile=most).text(path)
    return path


def parse_records(content: bytes):
    """(headers with lower-case names, block) of each record; content lengths say where one ends."""
    at = 0
    while (end := content.find(b"\r\n\r\n", at)) >= 0:
        lines = content[at:end].decode("utf-8", "replace").split(CRLF)
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head.get("content-length", 0))
        yield head, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record of the archives below ``path``: ``RECORD``, and payload if asked for.

    The payload of HTTP records is what follows the HTTP header. payload_bytes and payload_digest are taken of the bytes read (null for a
    revisit, which has none); digest is what the header claims. fields holds the lines of a metadata record.
    """
    schema = RECORD + (", payload binary" if with_payload else "")
    arrow = pa.schema([(c.split(" ")[0], pa.int64() if c.endswith(" long") else pa.binary() if c.endswith(" binary") else pa.map_(pa.string(), pa.string()) if "map<" in c else pa.string())
                       for c in schema.split(", ")])

    def row(head: dict, block: bytes) -> tuple:
        kind, fields, body = head.get("warc-type"), None, block
        if head.get("content-type", "").startswith("application/http"):
            body = block.partition(b"\r\n\r\n")[2]
        if head.get("content-type") == "application/warc-fields":
            fields = [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF)) if s]
        has = kind != "revisit"
        digest = head.get("warc-payload-digest")
        out = (kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"),
               digest and digest.rpartition(":")[2], len(body) if has else None, hashlib.sha1(body).hexdigest() if has else None, fields)
        return (*out, body if has else None) if with_payload else out

    def parse(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                content = batch.column(0)[i].as_py()
                for head, block in parse_records(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                    rows.append(row(head, block))
                    held += len(block) if with_payload else 0
                    if len(rows) == 5000 or held > 32 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture (response or revisit record): record_id, response, requests, metadata.

    A request or metadata record belongs to the capture that its concurrent-to names, or, if it names another request or metadata
    record, to the capture which that one names; a capture may also name its request. Records that name nothing known are
    in no capture; a capture without them has empty arrays. Captures of one id each get all that belongs to the id.
    """
    def of(kind):
        return F.col("record_type").isin(*kind)

    captures, rest = records.where(of(("response", "revisit"))), records.where(of(("request", "metadata")))
    part = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    links = rest.where("concurrent_to IS NOT NULL").groupBy("record_id").agg(F.min("concurrent_to").alias("via"))
    named = captures.where("concurrent_to IS NOT NULL").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min("record_id").alias("by"))
    hop = links.select(F.col("record_id").alias("concurrent_to"), "via")
    ids = captures.select(F.col("record_id").alias("concurrent_to"), F.lit(True).alias("is_capture")).distinct()
    target = F.when(F.col("is_capture"), F.col("concurrent_to")).otherwise(F.coalesce("via", "by"))
    owned = (rest.join(hop, "concurrent_to", "left").join(ids, "concurrent_to", "left").join(named, "record_id", "left")
             .select(target.alias("capture_id"), "record_type", part.alias("part")).where("capture_id IS NOT NULL"))
    parts = owned.groupBy("capture_id").agg(*[F.collect_list(F.when(F.col("record_type") == k, F.col("part"))).alias(n) for k, n in (("request", "requests"), ("metadata", "metadata"))])
    whole = captures.select(F.col("record_id").alias("capture_id"), part.alias("response")).join(parts, "capture_id", "left")
    empty = F.array().cast(parts.schema["requests"].dataType)
    return whole.select(F.col("capture_id").alias("record_id"), "response", F.coalesce("requests", empty).alias("requests"), F.coalesce("metadata", empty).alias("metadata"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder, reads them back and assembles them.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is empty; a null page_id is the smallest and stays null; pages
    of equal id and payload count one by one and have equal types; other columns are ignored.
    """
    spark = pages.sparkSession
    path = write_archives(pages, fresh_path(spark, "warc"))
    page = F.col("metadata")[0]["fields"]["page-id"].try_cast("long")
    # a response stands for itself, so that no key is null
    c = assemble(written(read_archives(spark, path), "records")).select("record_id", page.alias("page_id"), "response.record_type",
                                                    F.coalesce("response.refers_to", "record_id").alias("refers_id"),
                                                    "response.payload_bytes", "response.payload_digest", "response.digest")
    firsts = c.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("first_bytes"), F.max("payload_digest").alias("first_digest"))
    return c.join(firsts, "refers_id", "left").select(
        "page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "first_digest").alias("payload_digest"),
        "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"))


def op1_warc_transactions(spark, sf_dir):
    return captures_of(table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM top AS again FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN top END AS refers_to FROM r
"""
