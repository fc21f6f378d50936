import json

from maskwright import cli
from maskwright.operators import risk
from maskwright.sources import read_ndjson, read_texts, string_leaves
from maskwright.streaming import redact_stream, triage_counts
from pyspark.sql import functions as F


def test_ndjson_and_leaves(spark, tmp_path):
    (tmp_path / "s.ndjson").write_text("\n".join([json.dumps({"ResponseID": "S1", "Q1": "ring 0412 345 678"}), "", json.dumps({"ResponseID": "S2", "Q2": "x"})]))
    df = read_ndjson(spark, str(tmp_path / "s.ndjson"))
    assert [r.ResponseID for r in df.collect()] == ["S1", "S2"]
    nested = spark.createDataFrame([(1, {"a": "x"}, ["p", "q"])], "id int, m struct<a:string>, l array<string>")
    assert {(r.path, r.text) for r in string_leaves(nested, "id").collect()} == {("m.a", "x"), ("l[0]", "p"), ("l[1]", "q")}


def test_stream_gives_what_batch_gives(spark, tmp_path):
    rows = [(i, f"ring 04{i:08d}", f"2024-01-01 00:{i:02d}:00") for i in range(30)]
    spark.createDataFrame(rows, "i int, t string, at string").withColumn("at", F.to_timestamp("at")).repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("i int, t string, at timestamp").parquet(str(tmp_path / "in"))
    q = redact_stream(src, ["t"]).writeStream.format("memory").queryName("redacted").start()
    q.processAllAvailable()
    q.stop()
    out = spark.table("redacted")
    assert out.count() == 30 and out.where("t_redacted like '%04%'").count() == 0 and "t" not in out.columns
    w = triage_counts(src.withColumn("v", F.col("i") / 30), "at", risk.band(F.col("v"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 30


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("mail jo@example.com")
    (tmp_path / "b.txt").write_text("nothing")
    assert cli.main([str(tmp_path / "a.txt"), "--style", "label", "--summary"]) == 0
    got = capsys.readouterr()
    assert got.out == "mail [EMAIL]\n" and "email=1" in got.err
    assert cli.main([str(tmp_path / "b.txt"), "--scan"]) == 1
    assert cli.main([str(tmp_path / "none.txt")]) == 2
    assert read_texts(spark, str(tmp_path / "a.txt")).first().text == "mail jo@example.com"
