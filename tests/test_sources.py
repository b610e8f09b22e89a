"""Workbooks, stored tables and checked writes."""

import zipfile

import pytest
from codeweave.sources import files, workbook
from pyspark.sql import functions as F

CELLS = {"first": [["code", "A1", "B 2"], ["x", "0.5", None], ["y", None, "0.25"]], "second": [["code", "C3"], ["x", "1"]], "empty": []}


def xlsx(path, sheets, shared=True):
    """A small workbook by hand."""
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    strings, names = [], list(sheets)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            rows = []
            for r, row in enumerate(sheets[n], 1):
                cells = []
                for c, v in enumerate(row):
                    if v is None:
                        continue
                    at = f'r="{chr(65 + c)}{r}"'
                    if v.replace(".", "").isdigit():
                        cells.append(f"<c {at}><v>{v}</v></c>")
                    elif shared:
                        strings.append(v)
                        cells.append(f'<c {at} t="s"><v>{len(strings) - 1}</v></c>')
                    else:
                        cells.append(f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>')
                rows.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{ns}"><sheetData>{"".join(rows)}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")


@pytest.mark.parametrize("shared", [True, False])
def test_sheets_of_a_workbook(spark, tmp_path, shared):
    path = str(tmp_path / "book.xlsx")
    xlsx(path, CELLS, shared)
    df = workbook.read_workbook(spark, path)
    assert df.columns == ["sheet", "code", "A1", "B 2", "C3"] and df.rdd.getNumPartitions() == 3
    assert sorted((tuple(r) for r in df.collect()), key=str) == [("first", "x", "0.5", None, None), ("first", "y", None, "0.25", None), ("second", "x", None, None, "1")]
    assert [tuple(r) for r in df.where("sheet = 'second'").select("C3").collect()] == [("1",)]
    assert workbook.read_workbook(spark, path, ["first"]).count() == 2
    long = {(r.source, r.target): r.sim for r in workbook.read_similarities(spark, path, "m", "code").collect()}
    assert long == {("A1", "x"): 0.5, ("B 2", "y"): 0.25, ("C3", "x"): 1.0}


def test_sheets_are_written_and_read_again(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(c, f"t{i}", i if i else None) for c in ("b", "a", "c") for i in range(4)] + [(None, "lost", 1)], "cat string, name string, n int").repartition(5)
    workbook.write_workbook(df, path, "cat", order=["name"])
    assert workbook.sheets_of(path) == ["a", "b", "c"]
    got = [tuple(r) for r in workbook.read_workbook(spark, path).select("sheet", "name", "n").collect()]
    assert got == [(c, f"t{i}", str(i) if i else None) for c in "abc" for i in range(4)]
    workbook.write_workbook(df.where("cat = 'a'"), path, "cat", one_file=False)
    assert workbook.sheets_of(path) == ["a"] and workbook.read_workbook(spark, path).count() == 4
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_staged")]


def test_a_broken_write_leaves_the_workbook_as_it_was(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.createDataFrame([("a", 1)], "cat string, n int")
    workbook.write_workbook(good, path, "cat")
    with pytest.raises(Exception):
        workbook.write_workbook(spark.range(10).select(F.lit("z").alias("cat"), F.raise_error(F.lit("broken")).alias("n")), path, "cat")
    assert workbook.sheets_of(path) == ["a"]


def test_files_of_a_pattern_keep_their_names(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.csv").write_text(f"source,target,freq\ns,{name},1\n")
    assert sorted((r.file, r.target) for r in files.read_many(spark, f"{tmp_path}/*.csv", files.COOCCURRENCE).collect()) == [("a.csv", "a"), ("b.csv", "b")]


def test_a_stored_table_is_whole_and_as_new_as_its_inputs(spark, tmp_path):
    source, path, built = str(tmp_path / "in.parquet"), str(tmp_path / "table"), []
    spark.range(3).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source)

    get = lambda **p: files.cached(spark, path, build, inputs=[source], parameters=p).count()
    assert (get(k=1), get(k=1), len(built)) == (3, 3, 1)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert (get(k=1), len(built)) == (5, 2)
    assert (get(k=2), len(built)) == (5, 3)
    # a folder without its manifest is half a table
    (tmp_path / "table" / "_manifest.json").unlink()
    assert (get(k=2), len(built)) == (5, 4)
    with pytest.raises(Exception):
        files.cached(spark, path, lambda: spark.range(4).select(F.raise_error(F.lit("broken")).cast("int").alias("x")), inputs=[source], parameters={"k": 3})
    assert get(k=2) == 5 and len(built) == 4
    assert [p.name for p in tmp_path.iterdir() if "building" in p.name] == []


def test_a_write_that_fails_its_checks_takes_no_place(spark, tmp_path):
    path = str(tmp_path / "checked")
    metrics = {"n": F.count("*"), "emptied": F.count_if(F.col("label") == "")}
    checks = {"no label emptied": lambda m: m["emptied"] == 0, "not empty": lambda m: m["n"] > 0}
    good = spark.createDataFrame([("a",), ("b",)], "label string")
    assert files.write_checked(good, path, metrics, checks) == {"n": 2, "emptied": 0, "outcome": "PASS"}
    with pytest.raises(files.CheckFailed) as failed:
        files.write_checked(good.unionByName(spark.createDataFrame([("",)], "label string")), path, metrics, checks)
    assert failed.value.failed == ["no label emptied"] and failed.value.metrics["n"] == 3
    assert spark.read.parquet(path).count() == 2


def test_reports_are_text_tables(spark):
    df = spark.createDataFrame([("a", 0.12345, 3), (None, None, 10)], "name string, f1 double, n int")
    assert files.report(df).splitlines() == ["| name | f1    | n  |", "|------|-------|----|", "| a    | 0.123 | 3  |", "|      |       | 10 |"]
