"""Readers, sinks and streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from verdigris.sources import readers, sinks
from verdigris.streaming.incremental import ingest


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(path), "a int").collect()) == [1, 2]
    rows = readers.read_jsonl(spark, str(path), "a int", count_bad=True).cache()
    assert rows.where(F.col(readers.CORRUPT).isNotNull()).count() == 1


def test_registry_files(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes('"1";"São ""X"""\n"2"\n'.encode("latin-1"))
    rows = {r.k: r.name for r in readers.read_registry(spark, str(tmp_path / "r.csv"), ["k", "name"]).collect()}
    assert rows == {"1": 'São "X"', "2": None}


def test_zip_in_zip(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("EMPRE", '"1";"A"\n"2";"B"\n')
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("note.pdf", "x")
    rows = readers.registry_from_zip(spark, str(tmp_path / "o.zip"), ["k", "v"]).collect()
    assert sorted((r.k, r.v) for r in rows) == [("1", "A"), ("2", "B")]


def test_tables_of_several_forms(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Código;Código\n1;é\n", encoding="utf-8")
    assert readers.read_table(spark, str(tmp_path / "a.csv")).first().asDict() == {"codigo": "1", "codigo_2": "é"}
    (tmp_path / "b.tsv").write_bytes("a\tb\n1\té\n2\tu\n".encode("latin-1"))
    assert [r.b for r in readers.read_table(spark, str(tmp_path / "b.tsv")).collect()] == ["é", "u"]
    (tmp_path / "c.json").write_text(json.dumps({"total": 2, "results": [{"x": 1}, {"x": 2}]}))
    assert readers.read_table(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "d.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    row = readers.read_table(spark, str(tmp_path / "d.geojson")).first()
    assert row.n == 1 and json.loads(row.geometry_json)["type"] == "Point"
    assert readers.sniff(b"a|b\n1|2\n")["sep"] == "|" and readers.sniff(b"")["sep"] == ";"
    files = readers.files_with_digests(spark, str(tmp_path))
    assert files.count() == 4 and files.where("length(hash) = 64").count() == 4


def test_sheet_updates_and_formats(spark):
    rows = spark.createDataFrame([("Lei 1.pdf", None, 1, "a"), (None, "lei_1", 2, "b"), ("", "", 3, "c")], "documento string, arquivo string, line int, v string")
    got = readers.last_update(rows, ["documento", "arquivo"], "doc", "line").collect()
    assert [(r.doc, r.v, r.repeated) for r in got] == [("lei1", "b", True)]
    frame = spark.createDataFrame([(None, "text/csv", "http://x/y"), ("CSV", None, None), (None, None, "http://x/y.ZIP?z=1")], "f string, m string, u string")
    assert [r[0] for r in frame.select(readers.declared_format(F.col("f"), F.col("m"), F.col("u"))).collect()] == ["csv", "csv", "zip"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.upsert_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    sinks.upsert_table(spark.createDataFrame([(2, None), (3, "c")], "k int, v string"), path, ["k"], ["v"])
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {1: "a", 2: "b", 3: "c"}
    sinks.csv_report(spark.read.parquet(path), str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 3
    assert [sinks.log_answer(spark, str(tmp_path / "log"), "q", "a") for _ in range(2)] == [1, 2]


def test_repeated_deliveries_change_nothing(spark, tmp_path):
    inbox, table, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    inbox.mkdir()
    for n, lines in enumerate((['{"k": 1, "v": "a", "n": 1}', '{"k": 1, "v": "b", "n": 2}'], ['{"k": 2, "v": "c", "n": 1}'])):
        (inbox / f"{n}.json").write_text("\n".join(lines))
        for _ in range(2):
            ingest(spark, str(inbox), "k int, v string, n int", table, checkpoint, ["k"], "n").awaitTermination(120)
    assert {r.k: r.v for r in spark.read.parquet(table).collect()} == {1: "b", 2: "c"}
