import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tessella.sources.formats import CsvFormat, FieldType
from tessella.streaming import ingest, metrics, windows
from tessella.streaming.jobs import Jobs, Status

FMT = CsvFormat({"a": FieldType("bigint", -1)})


def test_incremental_ingest(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    now = F.lit(datetime(2024, 1, 20, tzinfo=timezone.utc)).cast("timestamp")

    def put(hour, rows):
        (src / f"f_{hour}.csv").write_text("\n".join(map(str, rows)))

    def go():
        ingest.ingest(spark, f"{src}/*.csv", out, check, FMT, lookback_days=30, now=now).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).select("file", "a").collect())

    put("2024011005", [1, 2])
    put("2023010105", [9])  # too old
    put("nohour", [8])
    assert go() == [("f_2024011005", 1), ("f_2024011005", 2)]
    put("2024011006", [3])
    assert go() == [("f_2024011005", 1), ("f_2024011005", 2), ("f_2024011006", 3)]
    assert go() == [("f_2024011005", 1), ("f_2024011005", 2), ("f_2024011006", 3)]


def test_pending_files(spark):
    files = spark.createDataFrame([("in/f_2024011005.csv",), ("in/f_2024011006.csv",), ("in/f_2023010100.csv",), ("in/x.csv",)], "path string")
    done = spark.createDataFrame([("f_2024011006",)], "file string")
    now = F.lit(datetime(2024, 1, 20, tzinfo=timezone.utc)).cast("timestamp")
    assert [r["file"] for r in ingest.pending_files(files, done, now).collect()] == ["f_2024011005"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 97).alias("ts"), (F.col("id") % 3).alias("k"), F.lit(1.5).alias("value"))
    rows.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    for i, make in enumerate((lambda d, late: windows.tumbling(d, "10 minutes", "k", late=late), lambda d, late: windows.sliding(d, "10 minutes", "5 minutes", late=late), lambda d, late: windows.sessions(d, "4 minutes", "k", late=late))):
        name = f"w{i}"
        make(stream, "1 hour").writeStream.format("memory").queryName(name).outputMode("complete" if i < 2 else "append").trigger(availableNow=True).start().awaitTermination()
        want = {tuple(r) for r in make(rows, None).collect()}
        got = {tuple(r) for r in spark.table(name).collect()}
        assert got == want if i < 2 else got <= want  # sessions come out once the watermark has passed


def test_late_rows(spark):
    rows = spark.createDataFrame([(0, 0), (1, 10_000), (2, 100), (3, 9_000)], "event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["event_id"] for r in windows.late_rows(rows, "1 hour", "ts", "event_id").collect()] == [2]


def test_metrics(spark):
    lines = [
        '{"name":"n","category":"SERVER","scope":"GLOBAL","value":1,"timestamp":"2024-01-01 00:00:00"}',
        '{"name":"n","category":"SERVER","scope":"GLOBAL","value":4,"timestamp":"2024-01-01 00:00:02"}',
        '{"name":"u","category":"NUM_REQUESTS","scope":"USER","value":2,"timestamp":"2024-01-01 00:00:00","user":"ann","labels":{"command":"sum"}}',
        '{"name":"m","category":"SYSTEM","scope":"LOCALE","value":3,"timestamp":"2024-01-01 00:00:00","locale_name":"l0","locale_num":"0","locale_hostname":"h"}',
        "no json",
    ]
    found = metrics.decode(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert found.count() == 4
    last = {(r["name"], r["labels"]): r["value"] for r in metrics.last_values(found).collect()}
    assert last[("n", "{}")] == 4 and last[("u", '{"command":"sum","user":"ann"}')] == 2
    assert last[("m", '{"locale_hostname":"h","locale_name":"l0","locale_num":"0"}')] == 3
    own = metrics.cluster_metrics(spark)
    assert own.where("name = 'memory_per_locale'").count() >= 1
    total = metrics.server_totals(own).first()
    assert total["processing_units"] >= 1 and total["memory"] > 0
    info = own.where("name = 'server_information'").first()["labels"]
    assert info["version"] == spark.version


def test_metrics_loop(spark):
    seen = []
    assert metrics.run_loop(lambda: 1, seen.append, 0.0, 3) == 3 and seen == [1, 1, 1]
    with pytest.warns(UserWarning, match="no connection"):
        assert metrics.run_loop(lambda: 1, seen.append, 0.0, 1, lambda: False) == 0


def test_jobs(spark):
    jobs = Jobs(spark)
    name = jobs.submit(lambda s: s.range(10).count())
    assert len(name) == 32 and jobs.result(name, 60) == 10
    with pytest.raises(KeyError):
        jobs.status(name)  # a result is read once
    bad = jobs.submit(lambda s: s.table("no_such_table").count())
    while jobs.status(bad) in (Status.SUBMITTED, Status.PENDING):
        time.sleep(0.1)
    assert jobs.status(bad) is Status.FAILED
    assert jobs.run(lambda s: 7) == 7
    slow = jobs.submit(lambda s: time.sleep(0.3) or 5)
    assert jobs.status(slow) in (Status.SUBMITTED, Status.PENDING)
    assert jobs.poll(slow, 0.05) == 5


def test_recorder(spark):
    r = metrics.Recorder(spark, "ann")
    with r.request("sum"):
        spark.range(5).count()
    with pytest.raises(ValueError), r.request("fail", "bob"):
        raise ValueError
    spark.streams.addListener(own := r.listener())
    try:
        spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 5).load().limit(10).writeStream.format("noop").queryName("q").trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if any(x[2] == "stream:q" for x in r.rows):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(own)
    values = {(x["name"], tuple(sorted(x["labels"].items()))): x["value"] for x in r.metrics().collect()}
    assert values[("number_of_requests_per_command", (("command", "sum"),))] == 1
    assert values[("number_of_errors_per_error_type", (("error", "ValueError"),))] == 1
    assert values[("per_user_total_number_of_requests", (("user", "bob"),))] == 1
    assert any(k[0] == "number_of_requests_per_command" and ("command", "stream:q") in k[1] for k in values)
