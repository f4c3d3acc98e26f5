"""The usage counter as versioned snapshots: one row for each tenant; what can't be read counts as never written.

A snapshot's rows go to a folder of their own; a version exists once its commit file does, which names that folder and says what is in it.
The commit file is made exclusively, so of two writers of one version the second fails and its rows are never read. Readers take
the last version whose rows are as its commit file says, so a damaged or missing folder falls back to the version before.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "tenant long, used long"


class VersionTaken(RuntimeError):
    """Another writer has committed this version."""


def _files(spark: SparkSession, path: str):
    """A file system and a maker of paths of it, as Spark's own readers have them."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _commits(spark: SparkSession, path: str) -> list[dict]:
    """What the commit files say, the last version first; files that hold nothing sensible are left out."""
    fs, make = _files(spark, path)
    if not fs.exists(make(f"{path}/commits")):
        return []
    found = []
    for status in fs.listStatus(make(f"{path}/commits")):
        stream = fs.open(status.getPath())
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            said = json.loads(text)
            found.append({"version": int(said["version"]), "data": str(said["data"]), "rows": int(said["rows"]), "used": int(said["used"])})
        except (ValueError, KeyError, TypeError):
            continue
    return sorted(found, key=lambda c: -c["version"])


def _whole(spark: SparkSession, path: str, commit: dict) -> DataFrame | None:
    """The rows of a version, if they are there and add up."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(f"{path}/data/{commit['data']}")
        n, used = rows.agg(F.count("*"), F.coalesce(F.sum("used"), F.lit(0))).first()
    except (PySparkException, Py4JJavaError):
        return None
    return rows if (n, used) == (commit["rows"], commit["used"]) else None


def read_version(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The last whole version below path and its rows (tenant, used); 0 and none if there is no such version."""
    for commit in _commits(spark, path):
        rows = _whole(spark, path, commit)
        if rows is not None:
            return commit["version"], rows
    return 0, spark.createDataFrame([], SCHEMA)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """tenant and used of the last whole snapshot; empty if there is none."""
    return read_version(spark, path)[1]


def write_usage(grants: DataFrame, path: str, version: int, before: DataFrame | None = None) -> None:
    """Write the snapshot ``version``: use before plus what was granted (tenant, n, granted).

    Raises VersionTaken if that version is there already. A write that fails half-way leaves no version.
    """
    spark = grants.sparkSession
    added = grants.filter("granted").groupBy("tenant").agg(F.sum("n").cast("long").alias("used"))
    both = added if before is None else added.union(before.select("tenant", "used"))
    data = uuid.uuid4().hex
    both.groupBy("tenant").agg(F.sum("used").alias("used")).write.parquet(f"{path}/data/{data}")
    n, used = spark.read.schema(SCHEMA).parquet(f"{path}/data/{data}").agg(F.count("*"), F.coalesce(F.sum("used"), F.lit(0))).first()
    fs, make = _files(spark, path)
    fs.mkdirs(make(f"{path}/commits"))
    try:
        stream = fs.create(make(f"{path}/commits/{version:012d}"), False)
    except Py4JJavaError as e:
        fs.delete(make(f"{path}/data/{data}"), True)
        raise VersionTaken(f"version {version} of {path} is there already") from e
    stream.write(bytearray(json.dumps({"version": version, "data": data, "rows": n, "used": used}).encode()))
    stream.close()
