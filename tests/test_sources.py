"""Files, listings, JSON reports that must or may be there, and what is written comes back."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import headers
from paperloom.sources import tables

SCHEMA = "id STRING, pages LONG"


def test_listing_and_order(spark, tmp_path):
    for name in ("나.hwp", "a.HWPX", "B.hwp", "가.hwp", "x.txt", "none"):
        (tmp_path / name).write_text(name)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.hwp").write_text("12345")
    found = tables.listing(spark, str(tmp_path)).collect()
    assert {(r.name, r.length) for r in found} >= {("x.txt", 5), ("c.hwp", 5)} and all(r.path.startswith(f"{tmp_path}/") for r in found)
    assert [r.name for r in tables.documents(spark, str(tmp_path), ["hwp", "hwpx"]).collect()] == ["가.hwp", "나.hwp", "a.HWPX", "B.hwp", "c.hwp"]
    assert [r.name for r in tables.listing(spark, str(tmp_path), "*.txt").collect()] == ["x.txt"]
    content = tables.files(spark, str(tmp_path), "x.txt").select(F.decode("content", "UTF-8"), tables.container_format(F.col("content"), F.col("path"))).first()
    assert tuple(content) == ("x.txt", "txt")
    rows = spark.createDataFrame([(1, [f"{tmp_path}/gone.png", f"{tmp_path}/x.txt"]), (2, [f"{tmp_path}/gone.png"])], "k long, tried array<string>")
    found = headers.first_existing(rows, "k", F.col("tried"), tables.listing(spark, str(tmp_path))).orderBy("k").collect()
    assert [(r.found.rsplit("/")[-1], r.exists) for r in found] == [("x.txt", True), ("gone.png", False)]


def test_json_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "pages": 3}, indent=1))
    (tmp_path / "b.json").write_text('{"id": "b"')
    rows, error = tables.optional_json(spark, str(tmp_path), SCHEMA, "verify report")
    assert error == "" and sorted((r.id or "", r.pages, r._corrupt is not None) for r in rows.collect()) == [("", None, True), ("a", 3, False)]
    with pytest.raises(Exception, match="verify report could not be parsed"):
        tables.required_json(spark, str(tmp_path), SCHEMA, "verify report").collect()
    assert [tuple(r) for r in tables.required_json(spark, str(tmp_path / "a.json"), SCHEMA, "x").collect()] == [("a", 3)]
    rows, error = tables.optional_json(spark, str(tmp_path / "gone"), SCHEMA, "audit")
    assert rows.count() == 0 and error.startswith("audit not found") and rows.columns == ["id", "pages", "_corrupt"]
    with pytest.raises(FileNotFoundError, match="audit not found"):
        tables.required_json(spark, str(tmp_path / "gone"), SCHEMA, "audit")


def test_what_is_written_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("é\n\"", None), (None, 2)], SCHEMA)
    tables.write_json(rows, str(tmp_path / "j"))
    assert {tuple(r) for r in spark.read.schema(SCHEMA).json(str(tmp_path / "j")).collect()} == {("a", 1), ("é\n\"", None), (None, 2)}
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        tables.write_json(rows, str(tmp_path / "j"))
    tables.write_text(rows.where("pages = 1").withColumn("line", F.concat("id", F.lit("!"))), "line", str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a!"]
    saved = tables.saved(rows, "rows")
    assert saved.count() == 3 and saved.schema == rows.schema
