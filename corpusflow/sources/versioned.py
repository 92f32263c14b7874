"""Tables whose rows are replaced and deleted by key, version by version.

A table is a folder. Each commit adds a folder of rows, a folder of the keys that it replaces or
deletes, and last a manifest, whose appearance makes the version current in one step. Readers see
the manifests alone, so what a broken-off job left behind is never read; a version is never changed.
That only one of two jobs makes a version needs a file system that refuses to rename onto a file.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions that a reader joins before ``commit`` writes the visible rows as one.
MOST_VERSIONS = 20
MANIFEST = "%010d.json"


class Conflict(Exception):
    """Another job has made the version that this one meant to make."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    return jvm, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The current version of a table: ``{version, keys, schema, parts, batches}``, or None.

    ``parts`` has a ``rows`` and a ``gone`` folder for each version since the last that was written
    whole, so at most ``MOST_VERSIONS``; nothing in it grows with the rows.
    """
    jvm, system, place = _files(spark, path)
    if not system.exists(place):
        return None
    names = [s.getPath().getName() for s in system.listStatus(place)]
    last = max((n for n in names if n.endswith(".json")), default=None)
    if last is None:
        return None
    stream = system.open(jvm.org.apache.hadoop.fs.Path(place, last))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, made: dict) -> None:
    """Write a manifest beside the others and give it its name, which only one job can."""
    jvm, system, place = _files(spark, path)
    system.mkdirs(place)
    hidden = jvm.org.apache.hadoop.fs.Path(place, f".{uuid.uuid4().hex}")
    out = system.create(hidden, False)
    out.write(json.dumps(made).encode())
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(place, MANIFEST % made["version"])
    if system.exists(final) or not system.rename(hidden, final):
        system.delete(hidden, False)
        raise Conflict(f"version {made['version']} of {path} is there already")


def _visible(spark: SparkSession, path: str, now: dict, columns: list[str] | None = None) -> DataFrame:
    """Rows that no later version replaces or deletes."""
    schema, keys = T.StructType.fromJson(now["schema"]), now["keys"]
    names = schema.names if columns is None else columns
    empty = T.StructType([schema[k] for k in keys])
    rows, gone = None, None
    for part in now["parts"]:
        some = spark.read.schema(schema).parquet(f"{path}/{part['rows']}").select(*names).withColumn("_version", F.lit(part["version"]))
        rows = some if rows is None else rows.unionByName(some)
        if part["gone"]:
            taken = spark.read.schema(empty).parquet(f"{path}/{part['gone']}").withColumn("_gone", F.lit(part["version"]))
            gone = taken if gone is None else gone.unionByName(taken)
    if gone is None:
        return rows.drop("_version")
    last = gone.groupBy(*keys).agg(F.max("_gone").alias("_gone"))
    same = [rows[k].eqNullSafe(last[k]) for k in keys]
    newer = last["_gone"] > rows["_version"]
    for s in same:
        newer = s & newer
    return rows.join(last, newer, "left_anti").drop("_version")


def read_version(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a table's current version; ``columns`` have to hold its keys."""
    now = manifest(spark, path)
    if now is None:
        raise FileNotFoundError(f"no version of a table in {path}")
    return _visible(spark, path, now, columns)


def commit(
    rows: DataFrame, gone: DataFrame, path: str, keys: list[str], based_on: dict | None = None, batch: str | None = None
) -> dict:
    """Make a version in which ``rows`` are added and the earlier rows of the keys in ``gone`` are not there.

    ``based_on`` is the manifest that the caller has read (default: the current one); if another
    job has made a version since, ``Conflict`` is raised and nothing is changed. A ``batch`` that has
    been committed before is passed over, so a stream may deliver it again. Every
    ``MOST_VERSIONS`` the visible rows are written as one part, so readers join a bounded number.
    Nothing is deleted: older manifests keep what they read.
    """
    spark = rows.sparkSession
    now = based_on or manifest(spark, path)
    stream, _, number = (batch or "").rpartition(":")
    done = (now or {}).get("batches", {})
    if batch and int(number) <= done.get(stream, -1):
        return now
    if now and T.StructType.fromJson(now["schema"]).simpleString() != rows.schema.simpleString():
        raise ValueError(f"rows {rows.schema.simpleString()} differ from the table's")
    version = (now["version"] if now else 0) + 1
    folder = f"v{version}-{uuid.uuid4().hex}"
    part = {"version": version, "rows": f"{folder}/rows", "gone": None}
    rows.write.parquet(f"{path}/{part['rows']}")
    if now:
        part["gone"] = f"{folder}/gone"
        gone.select(*keys).distinct().write.parquet(f"{path}/{part['gone']}")
    made = {
        "version": version, "keys": keys, "schema": rows.schema.jsonValue(),
        "parts": [*(now["parts"] if now else []), part], "batches": {**done, **({stream: int(number)} if batch else {})},
    }
    if len(made["parts"]) > MOST_VERSIONS:
        whole = f"{folder}/whole"
        _visible(spark, path, made).write.parquet(f"{path}/{whole}")
        made["parts"] = [{"version": version, "rows": whole, "gone": None}]
    _publish(spark, path, made)
    return made


def differences(wanted: DataFrame, stored: DataFrame | None, key: str, digest: str) -> DataFrame:
    """``(key, change)`` of rows ``(key, digest)``: ``new``, ``changed`` or ``deleted``; keys are distinct."""
    wanted = wanted.select(key, F.col(digest).alias("_wanted"), F.lit(True).alias("_in"))
    if stored is None:
        return wanted.select(key, F.lit("new").alias("change"))
    held = stored.select(F.col(key).alias("_key"), F.col(digest).alias("_held"), F.lit(True).alias("_out"))
    both = wanted.join(held, wanted[key].eqNullSafe(held["_key"]), "full_outer")
    change = (
        F.when(F.col("_out").isNull(), "new").when(F.col("_in").isNull(), "deleted")
        .when(~F.col("_wanted").eqNullSafe(F.col("_held")), "changed")
    )
    return both.select(F.when(F.col("_in").isNull(), F.col("_key")).otherwise(F.col(key)).alias(key), change.alias("change")).where("change IS NOT NULL")
