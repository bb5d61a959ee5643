"""The prompt, and streams over files."""

from pyspark.sql import functions as F

from larkspur import cli, sources, streaming


def test_prompt(spark, sf_dir):
    lines = iter(["SELECT 1 AS one;", "  ", "nonsense", "native tpch6", "tpch1;", "quit"])
    said = []
    cli.loop(spark, sf_dir, lambda _: next(lines), said.append)
    text = "\n".join(said)
    assert "one" in text and "Error occurred. Try again" in text and "revenue" in text and "sum_charge" in text


def test_stream_of_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:04:00"), (2, "2024-01-01 00:06:00"), (1, "2024-01-01 02:00:00")]
    sources.write(sources.values(spark, rows, "k int, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t"), folder)
    events = streaming.stream(spark, folder, "k int, ts timestamp", "ts", "1 minute")
    streaming.run_to_table(streaming.tumbling(events, "ts", "5 minutes", n=F.count("*")), "windows", str(tmp_path / "c1"), "complete")
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 1, 2]
    streaming.run_to_table(streaming.first_seen(events, ("k",)), "seen", str(tmp_path / "c2"))
    assert sorted(r.k for r in spark.table("seen").collect()) == [1, 2]


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:04:00"), (1, "2024-01-01 02:00:00")]
    events = sources.values(spark, rows, "k int, t string").withColumn("ts", F.col("t").cast("timestamp"))
    found = streaming.sessions(events, "ts", "10 minutes", ("k",), n=F.count("*"))
    assert sorted(r.n for r in found.collect()) == [1, 2]
