import datetime

from stratalog.streaming import buckets


def test_log_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = '2033-01-09T18:{m:02}:44.000000Z front 198.51.100.4:1 - 0.1 0.2 0.3 {s} 200 1 {b} "GET http://lake.test/ HTTP/1.1" "oar" - -'
    (folder / "1.log").write_text("\n".join(line.format(m=m, s=200 if m % 2 else 500, b=m) for m in range(20)))
    (folder / "2.log").write_text(line.format(m=59, s=200, b=1))
    stream = buckets.bucketed(buckets.read_logs(spark, "elb", str(folder), 1), "timestamp", "5 minutes", "elb_status_code", "sent_bytes", "1 minute")
    buckets.start(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = {(r.bucket, r.elb_status_code): (r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found[datetime.datetime(2033, 1, 9, 18, 0), "200"] == (2, 4)
    assert found[datetime.datetime(2033, 1, 9, 18, 15), "500"] == (2, 34)
    assert len(found) == 8


def test_replayed_keeps_null_keys(spark):
    at = lambda h: datetime.datetime(2033, 1, 9, h, 30)
    rows = [(at(1), None, 2.0), (at(1), "a", 3.0), (at(1), None, 5.0), (at(2), None, None), (None, "a", 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v double")
    found = {(r.bucket.hour, r.k): (r.n, r.total) for r in buckets.replayed(df, "ts", "1 hour", "k", "v").collect()}
    assert found == {(1, None): (2, 7.0), (1, "a"): (1, 3.0), (2, None): (1, None)}
    assert buckets.replayed(df.limit(0), "ts", "1 hour", "k", "v").count() == 0
