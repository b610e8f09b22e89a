"""Readers and writers with fixed schemas, through Spark, so any store will do."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SIMILARITY = "model string, source string, target string, sim double"
COOCCURRENCE = "source string, target string, freq bigint"
CODES = "code string, label string, ccs_id string"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the one that spark.checkpoint.dir names; below a temporary one only where that is unset and the master is local."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    base = known.get() if known.isDefined() else spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, schema: str | None = None, *, required: bool = True) -> DataFrame | None:
    """CSV (with header), JSON lines or Parquet by the name's ending (a folder or pattern is Parquet unless it says otherwise); None if it may be missing and is."""
    if not required and not exists(spark, path):
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    kind = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return reader.csv(path, header=True)
    return reader.json(path) if kind in ("json", "jsonl") else reader.parquet(path)


def read_many(spark: SparkSession, pattern: str, schema: str, *, level: int = 0) -> DataFrame:
    """All CSV files of a pattern with the name of their file (or, at `level`, of a folder so far above) as column file, by which ties may go."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1 - level)
    return spark.read.schema(schema).csv(pattern, header=True).withColumn("file", name)


def read_wide(spark: SparkSession, path: str, model: str, target: str = "target") -> DataFrame:
    """A wide matrix (first column the target code, others source codes) as long similarity without nulls."""
    wide = spark.read.option("inferSchema", "true").csv(path, header=True)
    return wide.unpivot(target, [c for c in wide.columns if c != target], "source", "sim").where("sim is not null").select(F.lit(model).alias("model"), "source", F.col(target).cast("string").alias("target"), F.col("sim").cast("double").alias("sim"))


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A JSON object's list filler_words, or a plain list."""
    found = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    return found["filler_words"] if isinstance(found, dict) else found


def report(df: DataFrame, rows: int = 50, digits: int = 3) -> str:
    """The first rows as a text table with bars, for a report: numbers rounded, nulls empty. Only these rows reach the driver."""
    shown = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [df.columns, *[[shown(v) for v in r] for r in df.limit(rows).collect()]]
    widths = [max(len(line[i]) for line in lines) for i in range(len(df.columns))]
    text = ["| " + " | ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)) + " |" for line in lines]
    return "\n".join([text[0], "|" + "|".join("-" * (w + 2) for w in widths) + "|", *text[1:]])


def write_csv(df: DataFrame, path: str, *, one_file: bool = True) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def write_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet, a folder for each value: tracks or categories; merging them is reading the folder."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict | None = None) -> str:
    """Digest of the inputs' files (path, size, time of change) and of the parameters a table was built with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in inputs:
        p = jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(conf).globStatus(p)
        for top in files or []:
            todo = [top]
            while todo:
                status = todo.pop()
                if status.isDirectory():
                    todo += list(status.getPath().getFileSystem(conf).listStatus(status.getPath()))
                else:
                    found.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
    return hashlib.sha256(json.dumps([sorted(found), parameters or {}], sort_keys=True, default=str).encode()).hexdigest()


def _manifest(spark: SparkSession, path: str) -> dict | None:
    name = f"{path}/_manifest.json"
    if not exists(spark, name):
        return None
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(name)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], *, inputs: list[str] | None = None, parameters: dict | None = None) -> DataFrame:
    """The stored table, which is built first if it isn't there whole, or if its inputs or parameters have changed since.

    A build writes to a folder of its own, then its manifest, and takes its place by a rename; a folder without a manifest is no table, so a build that broke, or
    half of one, is never read. Builds at the same time each write their own; the last one to finish stays."""
    key = fingerprint(spark, inputs or [], parameters)
    known = _manifest(spark, path)
    if known is None or known.get("key") != key:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        place = lambda name: jvm.org.apache.hadoop.fs.Path(name)
        own = f"{path.rstrip('/')}.building-{uuid.uuid4().hex}"
        fs = place(path).getFileSystem(conf)
        try:
            df = build()
            df.write.parquet(own)
            out = fs.create(place(f"{own}/_manifest.json"), True)
            out.write(bytearray(json.dumps({"key": key, "schema": json.loads(df.schema.json()), "parameters": parameters or {}}, default=str).encode()))
            out.close()
            if fs.exists(place(path)):
                fs.delete(place(path), True)
            if not fs.rename(place(own), place(path)):
                raise OSError(f"{own} could not take the place of {path}")
        finally:
            if fs.exists(place(own)):
                fs.delete(place(own), True)
    return spark.read.parquet(path)


class CheckFailed(Exception):
    """Rows that a write watched didn't pass."""

    def __init__(self, failed: list[str], metrics: dict):
        super().__init__(f"failed: {', '.join(failed)}; {metrics}")
        self.failed, self.metrics = failed, metrics


def write_checked(df: DataFrame, path: str, metrics: dict[str, Column], checks: dict[str, Callable[[dict], bool]]) -> dict:
    """Writes the table and watches metrics of its rows in the same pass; the table takes its place only if all checks of the metrics pass, else CheckFailed. Returns
    the metrics with outcome PASS."""
    spark = df.sparkSession
    watched = Observation()
    own = f"{path.rstrip('/')}.checking-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.observe(watched, *[c.alias(n) for n, c in metrics.items()]).write.parquet(own)
        found = watched.get
        failed = [name for name, ok in checks.items() if not ok(found)]
        if failed:
            raise CheckFailed(failed, found)
        if fs.exists(place(path)):
            fs.delete(place(path), True)
        fs.rename(place(own), place(path))
    finally:
        if fs.exists(place(own)):
            fs.delete(place(own), True)
    return {**found, "outcome": "PASS"}
