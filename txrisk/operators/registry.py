"""A registry of models on plain files, and queries over its table (name, version, created_at, size_bytes, path).

A version is published in two steps. Its files are written to a folder of their own, which nobody reads yet. Then one
small file, the registry row that names the folder, is put under the next free version number, if that is still free:
whoever comes second finds it taken and goes for the next. So a version is seen whole or not at all, two writers get two
versions, and a writer that dies leaves a folder that no row names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.operators.quality import require_columns
from txrisk.session import files_of

ROW = (
    "name string, version string, number long, created_at timestamp, size_bytes long, path string, model_type string, "
    "schema string, statistics string"
)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless there is one: false if another was first."""
    fs, final = files_of(spark, path)
    fs.mkdirs(final.getParent())
    _, staged = files_of(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(staged, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if final.toUri().getScheme() == "file":  # its rename would replace the other file; a second link to a name fails
        try:
            os.link(staged.toUri().getPath(), final.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(staged, False)
    done = fs.rename(staged, final)
    if not done:
        fs.delete(staged, False)
    return done


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, at = files_of(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]


def publish(
    spark: SparkSession, root: str, name: str, write: Callable[[str], None], facts: dict[str, str] | None = None
) -> dict:
    """Let ``write`` fill a new folder and commit it as the next version of ``name``; the registry row."""
    path = f"{root}/{name}/data-{uuid.uuid4().hex}"
    write(path)
    fs, at = files_of(spark, path)
    row = {
        "name": name, "created_at": datetime.now(timezone.utc).isoformat(timespec="microseconds"),
        "size_bytes": fs.getContentSummary(at).getLength(), "path": path, **(facts or {}),
    }
    number = max(_numbers(spark, f"{root}/{name}/versions"), default=0) + 1
    while True:
        row |= {"version": f"v{number}", "number": number}
        if put_if_absent(spark, f"{root}/{name}/versions/{number:010d}.json", json.dumps(row)):
            return row
        number += 1


def registry_table(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all committed versions under ``root``."""
    fs, at = files_of(spark, root)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/versions/*.json")) if fs.exists(at) else None
    if not found:
        return spark.createDataFrame([], ROW)
    return spark.read.schema(ROW).json(f"{root}/*/versions/*.json")


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("version").desc()]


def _nth(partition: str = "name") -> Column:
    return F.row_number().over(Window.partitionBy(partition).orderBy(*_newest_first()))


def list_versions(registry: DataFrame) -> DataFrame:
    """Names with their version counts, totals and newest version, from one aggregate."""
    newest = F.max_by("version", F.struct("created_at", "version"))
    return require_columns(registry, ["name", "version", "created_at"]).groupBy("name").agg(
        F.count("*").alias("n_versions"),
        F.sum("size_bytes").alias("total_bytes"),
        newest.alias("latest_version"),
    )


def latest(registry: DataFrame) -> DataFrame:
    """The newest row per name; Spark keeps one row per name and map task before the shuffle."""
    return registry.withColumn("_nth", _nth()).filter("_nth = 1").drop("_nth")


def info(registry: DataFrame, name: str, version: str = "latest") -> DataFrame:
    named = registry.filter(F.col("name") == name)
    return latest(named) if version == "latest" else named.filter(F.col("version") == version)


def keep_latest(registry: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` versions per name."""
    return registry.withColumn("_nth", _nth()).filter(F.col("_nth") <= n).drop("_nth")


def superseded(registry: DataFrame, n: int) -> DataFrame:
    """Versions a clean-up to ``n`` per name removes.

    The kept side is small (n per name), so the anti join can broadcast it and no
    name's full history is sorted in one task.
    """
    return registry.join(keep_latest(registry, n).select("name", "version"), ["name", "version"], "left_anti")


def storage(registry: DataFrame) -> DataFrame:
    """Names, versions, bytes in all and per version."""
    per_name = registry.groupBy("name").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    return per_name.agg(
        F.count("*").alias("n_names"),
        F.sum("n").alias("n_versions"),
        F.sum("b").alias("total_bytes"),
        (F.sum("b") / F.sum("n")).alias("mean_bytes"),
    )
