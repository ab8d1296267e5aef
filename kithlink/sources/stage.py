"""Stage tables: a plan's result written to the folder that driver and executors share, and read again.

It cuts lineage: what follows plans over a table instead of carrying the whole plan along, and a lost executor costs a task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where the session names none, as in tests."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="kithlink-stage-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


_known: dict[tuple, tuple[str, object]] = {}


def files_of(spark: SparkSession, path: str) -> tuple:
    """(file, bytes, time) of a table's files: another tuple once the table has changed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)


def stage_once(spark: SparkSession, source: str, name: str, make) -> DataFrame:
    """make() staged once in an application for the table at source as it is now, and read again after that."""
    key = spark.sparkContext.applicationId, name, files_of(spark, source)
    if key not in _known:
        path = f"{shared_folder(spark)}/kithlink-stage/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        df = make()
        df.write.parquet(path)
        _known[key] = path, df.schema
    path, schema = _known[key]
    return spark.read.schema(schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kithlink-stage/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
