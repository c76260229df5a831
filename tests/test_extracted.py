"""One file per unit: read back by name, in tasks."""

import duckdb
from pyspark.sql import functions as F

from recordforge.plans import files as plans
from recordforge.plans import registry
from recordforge.sources import folders, sinks
from tests.test_queries import SF


def test_extracted_files_are_not_listed(spark):
    # The list of all files used to be held in the driver.
    found = plans.units_extracted(spark, SF)
    assert found.inputFiles() == [] and "Scan text" not in found._jdf.queryExecution().executedPlan().toString()


def test_contents_of_odd_names(spark, tmp_path):
    rows = [(i, name, text) for i, (name, text) in enumerate([("_a", "x"), (".b", "yy"), ("c d%20é.txt", "\r\n\0"), ("e", "")])]
    units = spark.createDataFrame(rows, "unit_id int, name string, body string")
    for gzip in (False, True):
        path = str(tmp_path / f"out{gzip}")
        made, without = sinks.extract_told(units, "name", "body", path, gzip)
        got = {r.filename: bytes(r.content).decode() for r in folders.contents(made, path, gzip, tasks=3).collect()}
        assert got == {name: text for _, name, text in rows} and without.count() == 0


def test_contents_come_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "READ_BYTES", 10)
    units = spark.range(0, 50, 1, 2).select(F.col("id").alias("unit_id"))
    made, _ = sinks.extract_told(units, "concat(unit_id, '.txt')", "repeat('x', unit_id)", str(tmp_path / "out"))
    got = folders.contents(made, str(tmp_path / "out")).collect()
    assert sorted((r.filename, len(r.content)) for r in got) == sorted((f"{i}.txt", i) for i in range(50))


def test_extracted_odd_documents(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "src") for i in range(1, 40)]
    rows += [(40, "", "en", "src"), (41, "x", "", "src"), (42, "y", "en", "a b%20é"), (43, None, "en", "src"), (44, "z", None, "src")]
    rows += [(45, "one", "en", "src"), (45, "two", "en", "src"), (None, "no id", "en", "src"), (52, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["units_extracted"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(registry.ORACLES["units_extracted"])
    assert [d[0] for d in want.description] == found.columns
    assert found.schema["errors"].dataType.simpleString() == "bigint"  # was int
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in found.collect())
