from folioflow.streaming.ingest import convert_stream


def test_new_files_come_once(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    inbox.mkdir()
    (inbox / "a.md").write_text("# One\n\ntext")
    convert_stream(spark, str(inbox), str(out), str(mark)).awaitTermination()
    (inbox / "b.html").write_text("<h1>Two</h1>")
    convert_stream(spark, str(inbox), str(out), str(mark)).awaitTermination()
    rows = spark.read.parquet(str(out)).collect()
    assert sorted(r["markdown"] for r in rows) == ["# One\n\ntext", "# Two"]
