"""Readers, writers and streams over temporary files."""

import json

import pytest
from pyspark.sql import functions as F

from dialoom.sources import readers, writers
from dialoom.streaming import jobs


def test_dialogue_lines(spark, tmp_path):
    path = tmp_path / "raw.txt"
    path.write_text("1\t你好\t 在的 \n0\tonly\n\n 1\ta\t\t好的呢\nx\ta\tb\n2\ta\tb\n1\t \tb\n", encoding="utf-8")
    rows = {r.line_no: r for r in readers.read_dialogues(spark, str(path)).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7]
    assert sorted(n for n, r in rows.items() if r.label is not None) == [1, 4]
    assert rows[4].context == ["a"] and rows[1].response == "在的"
    assert readers.read_dialogues_loose(spark, str(path)).count() == 4
    with pytest.raises(Exception, match="fewer than 3 fields"):
        readers.read_dialogues_strict(spark, str(path)).collect()


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(1, 20001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path / "a.txt"))
        assert rows.where(F.concat(F.lit("line "), F.col("line_no").cast("string")) != F.col("line")).count() == 0 and rows.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"instruction": "i", "input": "x", "output": "y"}]))
    (tmp_path / "p.json").write_text(json.dumps({"meta": {}, "results": [{"id": 1, "prompt": "q"}]}))
    (tmp_path / "b.jsonl").write_text('{"score": 1.5, "context": ["a"]}\n\n{"score": 2.5, "context": ["a"]}\n')
    assert readers.read_records(spark, str(tmp_path / "a.json"), readers.ALPACA).first().output == "y"
    assert readers.read_records(spark, str(tmp_path / "p.json"), readers.PREDICTION).first().prompt == "q"
    ranked = readers.read_ranked(spark, str(tmp_path / "b.jsonl"), readers.PREVIEW)
    assert sorted(r.selection_rank for r in ranked.collect()) == [1, 3]
    assert readers.preview_meta(ranked).first().source_score == 2.5
    assert readers.read_manual(spark, None).count() == 0
    got = [r[0] for r in spark.createDataFrame([('{"a": 1}',), ("{bad",), (None,)], "t string").select(readers.tolerant_json(F.col("t"), "a int")).collect()]
    (tmp_path / "o.json").write_text('{"a": 7}')
    assert readers.read_object(spark, str(tmp_path / "o.json"), "a int").first().a == 7
    assert readers.read_object(spark, str(tmp_path / "none.json"), "a int").collect()[0].a is None
    assert got[0]["a"] == 1 and got[1]["_load_error"] == "{bad" and got[2]["a"] is None


def test_trainer_log(spark, tmp_path):
    for name, loss in (("r1/checkpoint-5", 5.0), ("r1/checkpoint-10", 1.0), ("r2", 7.0), ("r2/checkpoint-9", 9.0)):
        folder = tmp_path / name
        folder.mkdir(parents=True)
        (folder / "trainer_state.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": loss}]}))
    rows = readers.read_trainer_log(spark, [str(tmp_path / "*/trainer_state.json"), str(tmp_path / "*/*/trainer_state.json")])
    assert {(r.run.rsplit("/", 1)[1], r.loss) for r in rows.collect()} == {("r1", 1.0), ("r2", 7.0)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "c", "d", 1.23456)], "rank int, context array<string>, chosen string, rejected string, score double")
    assert [r.line for r in writers.raw_pairs(df).collect()] == ["1\ta\tb\tc", "0\ta\tb\td"]
    assert [r.line for r in writers.raw_pairs(df, positive_only=True).collect()] == ["1\ta\tb\tc"]
    assert writers.preview(df).first().score == 1.2346
    writers.write_json_array(df, str(tmp_path / "o.json"))
    assert json.loads((tmp_path / "o.json").read_text())[0]["context"] == ["a", "b"]
    writers.write_jsonl(df, str(tmp_path / "j"))
    writers.write_text(df.withColumn("line", F.lit("x")), str(tmp_path / "t"))
    writers.write_csv(df, str(tmp_path / "c"), ["rank", "score"])
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    text = writers.markdown(df.select("chosen", "score"), {"chosen": "Name", "score": "Score"}, signed=("score",))
    assert "| c | +1.2346 |" in text
    assert "no rows" in writers.markdown(df.where("false").select("chosen"), {"chosen": "Name"})
    with pytest.raises(ValueError, match="more than"):
        writers.bounded(spark.range(5), 4)


def test_streams(spark, tmp_path):
    rows = [(["退款多久到账呢？"], "退款一般三天内到账的", "2025-01-01 00:00:00"), (["退款多久到账呢？"], "退款 一般 三天内到账的", "2025-01-01 00:00:10"), (["a"], "嗯", "2025-01-01 00:00:20")]
    df = spark.createDataFrame(rows, "context array<string>, response string, t string").select("context", "response", F.to_timestamp("t").alias("logged_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = jobs.clean_stream(stream).writeStream.format("memory").queryName("cleaned").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("cleaned").count() == 1
    query = jobs.window_counts(stream, ["response"]).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windows").count() == 3
