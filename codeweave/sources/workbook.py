"""Workbooks of several sheets as a Spark source and sink: format `workbook`.

A workbook is a folder with a CSV file (with a header) for each sheet, or an .xlsx file, which is a zip of XML. Reading deals one partition to each sheet of each
workbook and gives the column `sheet` beside the sheet's own; only asked columns are built, and a filter on `sheet` leaves the other sheets unread. Writing makes a
folder of sheets: every task writes its sheets under a name of its own, and the commit puts them in place, all or none; a sheet that several tasks hold is one
file a task, read as one sheet.

Options: path (a workbook, or several separated by commas), sheets (names separated by commas; default all), target (in wide sheets: the column of target codes).
Paths are read by Python on the executors, so they must lie in a folder that all of them share.
"""

from __future__ import annotations

import csv
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StringType, StructType

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PART = re.compile(r"\.part-[0-9a-f-]+\.csv$|\.csv$")


@dataclass
class Sheet(InputPartition):
    path: str
    name: str

    def __hash__(self) -> int:
        return hash((self.path, self.name))


def sheets_of(path: str) -> list[str]:
    """Names of a workbook's sheets: in its own order, or by name in a folder."""
    if os.path.isdir(path):
        return sorted({_PART.sub("", f) for f in os.listdir(path) if f.endswith(".csv") and not f.startswith((".", "_"))})
    with zipfile.ZipFile(path) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")]


def rows_of(path: str, name: str) -> Iterator[list[str | None]]:
    """The sheet's rows of texts, the header first; empty cells are null. A sheet is read as a stream."""
    if os.path.isdir(path):
        for i, f in enumerate(sorted(x for x in os.listdir(path) if _PART.sub("", x) == name and not x.startswith((".", "_")))):
            with open(os.path.join(path, f), newline="", encoding="utf-8") as file:
                for j, row in enumerate(csv.reader(file)):
                    if j or not i:
                        yield [x if x != "" else None for x in row]
        return
    with zipfile.ZipFile(path) as z:
        ids = {s.get("name"): s.get(_REL) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        with z.open("xl/" + targets[ids[name]].removeprefix("/xl/")) as file:
            for _, row in ElementTree.iterparse(file):
                if row.tag != f"{_NS}row":
                    continue
                out: list[str | None] = []
                for cell in row:
                    value = cell.find(f"{_NS}v")
                    text = "".join(t.text or "" for t in cell.iter(f"{_NS}t")) if cell.get("t") == "inlineStr" else value.text if value is not None else None
                    if cell.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    column = 0
                    for letter in re.match(r"[A-Z]*", cell.get("r") or "")[0]:
                        column = column * 26 + ord(letter) - 64
                    out += [None] * (max(column, len(out) + 1) - len(out) - 1)
                    out.append(text or None)
                yield out
                row.clear()


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _paths(self) -> list[str]:
        return [re.sub(r"^file:(//)?(?=/)", "", p) for p in self.options["path"].split(",")]

    def schema(self) -> StructType:
        """Texts: the sheet's name and the columns of all headers in the order they are first met; the headers only are read."""
        out = StructType().add("sheet", StringType())
        for path in self._paths():
            for sheet in sheets_of(path):
                for column in next(rows_of(path, sheet), []):
                    if column is not None and column not in out.names:
                        out.add(column, StringType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._paths(), schema, [s for s in self.options.get("sheets", "").split(",") if s])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self._paths()[0], schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType, sheets: list[str]):
        self.paths, self.names, self.sheets = paths, schema.names, set(sheets)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the sheet's name choose partitions; Spark applies the others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sheet",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("sheet",):
                self._only(set(f.value))
            else:
                yield f

    def _only(self, names: set[str]) -> None:
        self.sheets = self.sheets & names if self.sheets else names
        self.sheets = self.sheets or {""}

    def partitions(self) -> list[Sheet]:
        return [Sheet(p, s) for p in self.paths for s in sheets_of(p) if not self.sheets or s in self.sheets]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        if partition is None:
            return
        rows = rows_of(partition.path, partition.name)
        header = next(rows, [])
        at = [-1 if n == "sheet" else header.index(n) if n in header else None for n in self.names]
        for row in rows:
            yield tuple(partition.name if i == -1 else row[i] if i is not None and i < len(row) else None for i in at)


@dataclass
class _Done(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    """Sheets by the column `sheet`; empty ones don't arise. Files lie in a hidden folder until the commit."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = path, schema.names, overwrite
        self.staged = os.path.join(path, f"_staged-{uuid.uuid4().hex}")

    def write(self, rows: Iterator[Row]) -> _Done:
        os.makedirs(self.staged, exist_ok=True)
        at, columns, files, out = None, [n for n in self.names if n != "sheet"], [], {}
        try:
            for row in rows:
                if row["sheet"] != at:
                    at = row["sheet"]
                    if at not in out:
                        name = os.path.join(self.staged, f"{re.sub(r'[^A-Za-z0-9 _.-]', '_', str(at))}.part-{uuid.uuid4()}.csv")
                        file = open(name, "w", newline="", encoding="utf-8")  # noqa: SIM115
                        out[at] = (file, csv.writer(file))
                        out[at][1].writerow(columns)
                        files.append(name)
                out[at][1].writerow(["" if row[c] is None else row[c] for c in columns])
        finally:
            for file, _ in out.values():
                file.close()
        return _Done(files)

    def commit(self, messages: list[_Done | None]) -> None:
        old = [f for f in os.listdir(self.path) if f.endswith(".csv")] if self.overwrite and os.path.isdir(self.path) else []
        for message in messages:
            for f in message.files if message else []:
                os.replace(f, os.path.join(self.path, os.path.basename(f)))
        for f in old:
            os.remove(os.path.join(self.path, f))
        shutil.rmtree(self.staged, ignore_errors=True)

    def abort(self, messages: list[_Done | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workbook)


def read_workbook(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """All sheets of a workbook as one table of texts with the sheet's name."""
    register(spark)
    reader = spark.read.format("workbook").option("path", path)
    return (reader.option("sheets", ",".join(sheets)) if sheets else reader).load()


def read_similarities(spark: SparkSession, path: str, model: str, target: str = "target") -> DataFrame:
    """Wide sheets (a column of target codes, others source codes) of a workbook as long similarity: model, source, target, sim; each sheet holds some of the sources."""
    wide = read_workbook(spark, path)
    sources = [c for c in wide.columns if c not in ("sheet", target)]
    long = wide.unpivot(target, sources, "source", "sim").where("sim is not null")
    return long.select(F.lit(model).alias("model"), "source", F.col(target).alias("target"), F.col("sim").try_cast("double").alias("sim")).where("sim is not null")


def write_workbook(df: DataFrame, path: str, sheet: str, *, order: list[str] | None = None, one_file: bool = True, overwrite: bool = True) -> None:
    """A sheet for each value of the column `sheet`, its rows sorted by `order`; one_file deals a sheet's rows to one task, else each task that holds some writes a part."""
    register(df.sparkSession)
    rows = df.withColumn("sheet", F.col(sheet).cast("string")) if sheet != "sheet" else df.withColumn("sheet", F.col("sheet").cast("string"))
    rows = rows.where("sheet is not null")
    rows = (rows.repartition("sheet") if one_file else rows).sortWithinPartitions("sheet", *(order or []))
    rows.write.format("workbook").mode("overwrite" if overwrite else "append").option("path", path).save()
