from factsieve.session import scratch
from factsieve.streaming import jobs


def run(spark, df, out_df, name, mode="append"):
    out, ck = scratch(spark, name), scratch(spark, "ck")
    q = out_df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(out_df.schema).parquet(out)


def test_span_stream(spark):
    rows = [("d", -1, 1, "ocr", "pending", 4, 6, None, "2O"), ("d", 1, None, None, None, 0, 0, 3, "abc"), ("d", 2, None, None, None, 8, 9, 9, "0")]
    df = spark.createDataFrame(rows, "doc_id string, rev bigint, span_id bigint, kind string, state string, start int, end int, new_end int, text string")
    src = scratch(spark, "src")
    df.coalesce(1).write.parquet(src)
    got = run(spark, df, jobs.span_stream(spark.readStream.schema(df.schema).parquet(src)), "spans").collect()
    assert [(r.span_id, r.state, r.start) for r in got] == [(1, "edited", None)]


def test_run_metrics(spark):
    df = spark.sql("SELECT timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, if(id % 2 = 0, 'a', 'b') AS code FROM range(300)")
    src = scratch(spark, "src")
    df.coalesce(1).write.parquet(src)
    got = run(spark, df, jobs.run_metrics(spark.readStream.schema(df.schema).parquet(src)), "metrics")
    done = {(r.window_start.hour, r.code): r.n for r in got.collect()}
    assert done[(0, "a")] == 30 and done[(3, "b")] == 30 and (4, "a") not in done
