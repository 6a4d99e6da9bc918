"""Round trips through files, and the incremental stream."""

import pytest
from conftest import SF

from siltbed.operators.inventory import inventory
from siltbed.sources import files
from siltbed.streaming import incremental


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_scan_manifest_archive(spark, tmp_path):
    for name, content in (("notes.txt", "silt and sand"), ("river bed/grain.txt", "clay, silt, sand and gravel by size"), ("z.txt", "loam")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(content)
    found = files.scan(spark, str(tmp_path / "in"))
    assert found.count() == 3
    entries = found.selectExpr("regexp_extract(path, '/in/(.*)$', 1) AS path", "content", "hash", "'all' AS folder", "size")
    files.create_archive(entries, str(tmp_path / "a"))
    assert {r.status for r in files.verify(spark, str(tmp_path / "a")).collect()} == {"ok"}
    assert files.read_manifest(spark, str(tmp_path / "a/manifest")).count() == 3
    assert bytes(files.extract_entry(spark, str(tmp_path / "a"), "z.txt").first()["content"]) == b"loam"


def test_manifest_lines(spark, tmp_path):
    (tmp_path / "m").write_text("abc  a b/c d\n\n  \nalone\nf0  x\n")
    loose = {(r.hash, r.path) for r in files.read_manifest(spark, str(tmp_path / "m"), strict=False).collect()}
    assert loose == {("abc", "a b/c d"), ("alone", None), ("f0", "x")}
    with pytest.raises(Exception, match="not a manifest line"):
        files.read_manifest(spark, str(tmp_path / "m")).collect()


def test_empty_archive(spark, tmp_path):
    empty = spark.createDataFrame([], "path string, content binary, hash string, folder string")
    files.create_archive(empty, str(tmp_path / "e"))
    assert files.read_manifest(spark, str(tmp_path / "e/manifest")).count() == 0


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert files.load_settings(path, {"crf": 23}) == {"crf": 23}
    files.save_settings(path, {"crf": 30, "other": 1})
    assert files.load_settings(path, {"crf": 23, "level": 3}) == {"crf": 30, "level": 3}
    (tmp_path / "s.json").write_text("{")
    assert files.load_settings(path, {"crf": 23}) == {"crf": 23}


def test_texts(spark):
    rows = spark.createDataFrame([("h264", 5)], "codec string, n int")
    assert [files.render(rows, s).first().value for s in ("default", "flat", "ini", "json")] == ["codec=h264\nn=5", 'row.codec="h264"\nrow.n="5"', "[row]\ncodec=h264\nn=5", '{"codec":"h264","n":5}']
    got = files.key_values(files.render(rows, "default"), schema="codec string, n int, bit_rate long").first()
    assert (got.codec, got.n, got.bit_rate) == ("h264", 5, None)


def test_incremental_stream(spark, docs, tmp_path):
    into, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    docs.where("doc_id < 120").coalesce(1).write.parquet(into)
    for _ in range(2):  # the second run finds nothing new
        incremental.archive_stream(incremental.new_documents(spark, into, docs.schema), out, state).awaitTermination()
    docs.coalesce(1).write.mode("append").parquet(into)
    incremental.archive_stream(incremental.new_documents(spark, into, docs.schema), out, state).awaitTermination()
    got = spark.read.parquet(out)
    want = inventory(docs).select("hash").distinct().count()
    assert got.count() == got.select("hash").distinct().count() == want


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("ts", "t").selectExpr("event_id", "CAST(t AS TIMESTAMP) AS t", "event_type")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    counted = incremental.windowed_counts(stream, "t", "1 day", "30 days", "event_type")
    counted.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counted").groupBy().sum("n").first()[0] == events.count()
