"""Datasets of Parquet parts under date= and market= folders, and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one of a local session."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-tidemark-")
    return f"file://{_LOCAL[app]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/tidemark-{name}-{uuid.uuid4().hex[:12]}"


def shared_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts the lineage, what follows does not
    compute it again, and a lost executor costs no recomputation of what stands above."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete shared tables that nothing reads any more: what came of them is written."""
    for df in tables:
        if path := getattr(df, "scratch_path", None):
            fs, place = _fs(df.sparkSession, path)
            fs.delete(place, True)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


#: The file in a replaced dataset's folder that names the version in force.
POINTER = "_current"


def place_of(spark: SparkSession, root: str, dataset: str) -> str:
    """The folder that holds a dataset's date folders: its own, or that of the version in force."""
    fs, pointer = _fs(spark, f"{root}/{dataset}/{POINTER}")
    if not fs.exists(pointer):
        return f"{root}/{dataset}"
    stream = fs.open(pointer)
    try:
        return f"{root}/{dataset}/{spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def _point(spark: SparkSession, root: str, dataset: str, version: str) -> None:
    """Name the version in force: the file is written aside and renamed over the old one, in one step."""
    jvm = spark.sparkContext._jvm
    fs, aside = _fs(spark, f"{root}/{dataset}/_next-{version}")
    out = fs.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(aside, jvm.org.apache.hadoop.fs.Path(f"{root}/{dataset}/{POINTER}"), over)


def dataset_dates(spark: SparkSession, root: str, dataset: str) -> list[date]:
    """The dates of a dataset from its folders' names, sorted. A folder that is not date=YYYY-MM-DD
    is an error; files are passed over; a missing dataset has none."""
    fs, place = _fs(spark, place_of(spark, root, dataset))
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
    names = [n for n in names if n != "_spark_metadata"]  # the commit log of a streaming sink
    for name in names:
        if not re.fullmatch(r"date=\d{4}-\d\d-\d\d", name):
            raise ValueError(f"{dataset}: {name} is no date partition")
    return sorted(date.fromisoformat(n[5:]) for n in names)


def read(spark: SparkSession, root: str, dataset: str, schema: StructType, on: date | None = None) -> DataFrame:
    """A dataset's rows with its partition columns; empty when it is missing. ``on`` reads the folders
    of one date alone. Folder names are checked first: Spark would read a wrong one as text."""
    whole = StructType([*schema.fields, *(f for f in StructType.fromDDL("date date, market string").fields if f.name not in schema.names)])
    if not dataset_dates(spark, root, dataset):
        return spark.createDataFrame([], whole)
    place = place_of(spark, root, dataset)
    df = spark.read.schema(whole).option("basePath", place).parquet(place)
    return df if on is None else df.where(F.col("date") == F.lit(on))


def append(df: DataFrame, root: str, dataset: str) -> None:
    """Add rows that have ``date`` and ``market``, one file per market and day, ZSTD compressed."""
    df.repartition("date", "market").write.mode("append").option("compression", "zstd").partitionBy("date", "market").parquet(f"{root}/{dataset}")


def replace(df: DataFrame, root: str, dataset: str) -> None:
    """Put ``df`` in a derived dataset's place, all at once.

    It is written in full as a version of its own, then one rename makes that the version in force, and only then
    do others go. So ``df`` may be read from the dataset, and a failure at any point leaves the old rows
    or the new ones, whole. A version that a failed call left is deleted by the next."""
    spark, version = df.sparkSession, f"version={uuid.uuid4().hex[:12]}"
    append(df, f"{root}/{dataset}", version)
    _point(spark, root, dataset, version)
    fs, place = _fs(spark, f"{root}/{dataset}")
    for old in fs.listStatus(place):
        if old.getPath().getName() not in (version, POINTER, f".{POINTER}.crc"):
            fs.delete(old.getPath(), True)


def append_jsonl(events: DataFrame, root: str, dataset: str) -> None:
    """Append events as JSON lines under the date of ``emitted_at``."""
    events.withColumn("date", F.to_date("emitted_at")).write.mode("append").partitionBy("date").json(f"{root}/{dataset}")


def footprint(spark: SparkSession, root: str) -> tuple[int, int]:
    """Bytes and number of the Parquet files under ``root``; (0, 0) if it is missing."""
    fs, place = _fs(spark, root)
    if not fs.exists(place):
        return 0, 0
    total = files = 0
    found = fs.listFiles(place, True)
    while found.hasNext():
        f = found.next()
        if f.getPath().getName().endswith(".parquet"):
            total, files = total + f.getLen(), files + 1
    return total, files
