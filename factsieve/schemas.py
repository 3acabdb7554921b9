"""Table layouts (Spark DDL)."""

RANGE = "STRUCT<start:INT,end:INT>"
QUOTE = "STRUCT<line:INT,text:STRING>"
LINE = "STRUCT<line_no:INT,text:STRING,start:INT,end:INT>"
SEGMENT = "STRUCT<days:INT,start:STRING,end:STRING,break_minutes:INT>"
CALC = f"STRUCT<entries:ARRAY<STRUCT<label:STRING,hours:DOUBLE,segments:ARRAY<{SEGMENT}>>>>"
DERIVED = "STRUCT<label:STRING,value:STRING,derivation:STRING>"

DOCUMENTS = (
    "doc_id STRING, record_id STRING, seq BIGINT, doc_type STRING, text STRING, input_source STRING, "
    f"registered_at TIMESTAMP, low_confidence ARRAY<{RANGE}>"
)

CLAIM = (
    f"STRUCT<criterion_id:STRING,finding:STRING,quotes:ARRAY<{QUOTE}>,source_value:STRING,"
    f"term_type:STRING,value_kind:STRING,calc:{CALC}>"
)
# the body of a stored response: ids are called "id" there
RESPONSE_BODY = (
    f"STRUCT<criteria:ARRAY<STRUCT<id:STRING,finding:STRING,quotes:ARRAY<{QUOTE}>,source_value:STRING,"
    f"term_type:STRING,value_kind:STRING,calc:{CALC}>>>"
)

ENTRY = (
    f"STRUCT<criterion_id:STRING,finding:STRING,quotes:ARRAY<{QUOTE}>,source_value:STRING,term_type:STRING,"
    f"value_kind:STRING,calc:{CALC},excluded:ARRAY<STRUCT<line:INT,text:STRING,reason:STRING>>,"
    "errors:ARRAY<STRING>,error_quotes:ARRAY<STRUCT<line:INT,text:STRING,code:STRING>>,"
    "unavailable:BOOLEAN,reason:STRING>"
)

OCR_WORDS = (
    "page_id STRING, word_no INT, line_id INT, text STRING, confidence DOUBLE, "
    "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, space BOOLEAN"
)
RECORD_EVENTS = (
    "event_id BIGINT, event_time TIMESTAMP, record_id STRING, op STRING, doc_id STRING, note_id STRING, "
    "condition_key STRING, alias STRING, text STRING"
)
REQUEST_LOG = "event_id BIGINT, ts TIMESTAMP, ip STRING, cost INT"
EDITS = "doc_id STRING, rev BIGINT, before STRING, after STRING, confirm_id BIGINT"
