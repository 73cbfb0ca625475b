from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from prepkit.plans import catalog, results
from prepkit.sources import delimited, intake
from prepkit.sources.tables import materialise, shared_folder


def write(folder, name, content, encoding="utf-8"):
    path = folder / name
    path.write_bytes(content.encode(encoding) if isinstance(content, str) else content)
    return str(path)


def test_simple(spark, tmp_path):
    df = delimited.read_csv(spark, write(tmp_path, "a.csv", "part,size,brand\nbolt,7,Brand#12\ngear,3,Brand#31\n"))
    assert df.dtypes == [("part", "string"), ("size", "bigint"), ("brand", "string")]
    assert df.orderBy("size").first() == ("gear", 3, "Brand#31")


def test_missing_tokens(spark, tmp_path):
    df = delimited.read_csv(spark, write(tmp_path, "a.csv", "a,b\nNULL,1\nN/A,\nx,#NULL!\n\"\",nan\n"))
    assert df.dtypes == [("a", "string"), ("b", "bigint")]
    assert df.filter("a IS NULL").count() == 3 and df.filter("b IS NULL").count() == 3


def test_types(spark, tmp_path):
    text = "flag,qty,price,open,ship,huge\nR,17,901.25,FALSE,1996-03-13,88888888888888888888\nN,36,4,true,1996-04-12,2\n"
    df = delimited.read_csv(spark, write(tmp_path, "a.csv", text))
    assert [t for _, t in df.dtypes] == ["string", "bigint", "double", "boolean", "string", "double"]


def test_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b\n"x, ""y""",1\n"two\nlines",2\n')
    rows = delimited.read_csv(spark, path, multi_line=True).orderBy("b").collect()
    assert [r["a"] for r in rows] == ['x, "y"', "two\nlines"]


def test_empty_and_malformed(spark, tmp_path):
    with pytest.raises(delimited.CsvError):
        delimited.read_csv(spark, write(tmp_path, "empty.csv", ""))
    bad = write(tmp_path, "bad.csv", "clerk,orders\nC1,4,late\nC2\nC3,5,late,\"a, b\"\nC4,6\n")
    with pytest.raises(delimited.CsvError):
        delimited.read_csv(spark, bad)
    kept = delimited.read_csv(spark, bad, on_surplus="keep").orderBy("clerk").collect()
    assert [tuple(r) for r in kept] == [
        ("C1", 4, "late"), ("C2", None, None), ("C3", 5, 'C3,5,late,"a, b"'), ("C4", 6, None)]
    with pytest.raises(ValueError):
        delimited.read_csv(spark, bad, on_surplus="drop")


def test_columns_are_matched_by_the_header_of_each_file(spark, tmp_path):
    write(tmp_path, "1.csv", "a,b\n3,30\n")
    write(tmp_path, "2 x.csv", "b,a\n40,4\n")
    write(tmp_path, "3.csv", "b\n50\n")
    write(tmp_path, "4.csv", "c,a,b\nz,6,60\n")
    write(tmp_path, "5.csv", "")
    df = delimited.read_csv(spark, str(tmp_path))
    assert sorted(df.columns) == ["a", "b", "c"]
    assert [tuple(r) for r in df.select("a", "b", "c").orderBy("b").collect()] == [
        (3, 30, None), (4, 40, None), (None, 50, None), (6, 60, "z")]


def test_latin_text(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a\ncafé\n", "iso-8859-1")
    assert delimited.read_csv(spark, path, encoding="ISO-8859-1").first()[0] == "café"


def test_round_trip_and_preview(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, None, 2.5)], "i long, t string, v double")
    delimited.write_csv(df, str(tmp_path / "out"))
    back = delimited.read_csv(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert [tuple(r) for r in delimited.preview(df, ["i"], 1).collect()] == [("1", 'a "q", b', "")]
    assert delimited.preview_summary(df, 1)["sample_rows"] == 1


def test_intake(spark, tmp_path):
    write(tmp_path, "ok.csv", "a,b\n1,2\n")
    write(tmp_path, "UPPER.CSV", "a\n1\n")
    write(tmp_path, "big.csv", "a\n" + "1\n" * 500)
    write(tmp_path, "sheet.xlsx", "x")
    files = intake.list_files(spark, str(tmp_path))
    found = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in intake.intake_audit(files, max_bytes=500).collect()}
    assert found == {"ok.csv": None, "UPPER.CSV": None, "big.csv": "file too large",
                     "sheet.xlsx": "extension not allowed"}
    assert intake.intake_audit(files).filter("accepted").count() == 3
    write(tmp_path, "no thing.csv", "")
    files = intake.list_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in intake.intake_audit(files).filter("reason = 'file is empty'").collect()] == ["no thing.csv"]


def test_encodings(spark, tmp_path):
    write(tmp_path, "ascii.csv", "a,b\n")
    write(tmp_path, "utf8.csv", "é" * 9000)
    write(tmp_path, "blank in name.csv", "a" + "é" * 9000)
    write(tmp_path, "latin.csv", "café,b\n", "iso-8859-1")
    write(tmp_path, "late.csv", "a,b\n" * 4000 + "café,b\n", "iso-8859-1")  # far beyond any sample
    write(tmp_path, "wide.csv", "a,b\n", "utf-16")
    write(tmp_path, "blank.csv", "\n \n")
    audit = {r["path"].rsplit("/", 1)[1]: r for r in intake.encoding_audit(spark, str(tmp_path)).collect()}
    assert {k: v["encoding"] for k, v in audit.items()} == {
        "ascii.csv": "ascii", "utf8.csv": "utf-8", "blank in name.csv": "utf-8", "latin.csv": "iso-8859-1", "late.csv": "iso-8859-1",
        "wide.csv": "utf-16", "blank.csv": "ascii"}
    assert [k for k, v in audit.items() if not v["has_content"]] == ["blank.csv"]


def moment(text):
    return F.lit(text).cast("timestamp_ntz")


def test_results_expire_and_are_replaced(spark, tmp_path):
    path = str(tmp_path / "results")
    analysis = spark.createDataFrame([("a", 1), ("b", 2)], "column_name string, missing int")
    for hour, frame in (("08", analysis), ("09", analysis.limit(1))):
        results.store(results.result_rows(frame, "d", 1, "profile", moment(f"2024-01-01 {hour}:00:00")), path)
    results.store(results.result_rows(analysis, "d", 2, "quality", moment("2024-01-01 08:00:00")), path)
    stored = results.load(spark, path)
    assert results.still_valid(stored, moment("2024-01-01 10:00:00")).count() == 3
    assert results.still_valid(stored, moment("2024-01-02 08:30:00")).count() == 1
    assert len(results.summary(stored).first()["analyses"]) == 2


def test_catalog(spark, tmp_path):
    rows = [(i, f"name {i}", None if i % 2 else "Loud TEXT", i % 3, 0) for i in range(50)]
    c = spark.createDataFrame(rows, "id int, name string, description string, kind int, usage_count int")
    first = catalog.page(catalog.where(c, kind=1, name=None), "id", "id", 1, 5).collect()
    assert [r["id"] for r in first] == [49, 46, 43, 40, 37] and first[0]["total"] == 17
    assert catalog.search(c, "text", "name", "description").count() == 25
    assert catalog.search(c, "100%", "name").count() == 0
    with pytest.raises(ValueError):
        catalog.page(c, "id", "id", 0, 20)
    assert catalog.page(c, "id", "id", 1, 101).count() == 50
    third = catalog.page(c, "kind", "id", 3, 5).drop("total").collect()
    last = catalog.page(c, "kind", "id", 2, 5).collect()[-1]
    assert catalog.page_after(c, "kind", "id", (last["kind"], last["id"]), 5).collect() == third
    assert catalog.get(c, "id", 3).first()[1] == "name 3"


def test_scratch_space_is_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert materialise(spark.range(3)).count() == 3
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(ValueError):
        shared_folder(unset)


def test_files_of_several_charsets_are_one_table(spark, tmp_path):
    text = "k,name\n1,zoë\n2,Øst\n"
    for name, charset in (("a", "utf-8"), ("b", "utf-16"), ("c", "iso-8859-1"), ("d", "utf-8-sig")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(charset))
    (tmp_path / "e.csv").write_bytes(b"name,k\nplain,3\n")
    (tmp_path / "f.csv").write_bytes(b"")
    got = delimited.read_csv(spark, str(tmp_path), encoding="detect")
    assert dict(got.dtypes) == {"k": "bigint", "name": "string"}
    assert sorted(tuple(r) for r in got.select("k", "name").collect()) == [(1, "zoë")] * 4 + [(2, "Øst")] * 4 + [(3, "plain")]
