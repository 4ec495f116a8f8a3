"""The claims as a table of versions, of which a new one rewrites only the months it changes.

Rows lie in ``snapshot=.../month=...`` below the table's folder. A version is a small file in
``_versions`` that names for every month the snapshot which holds its rows; the highest number
is the present state. A new version writes the months it touches into a snapshot of its own and
then puts its file in place, which is the commit: until then readers see the version before,
and a run that died is simply done again. Readers of older versions are never disturbed.

A batch has a name and is taken in once: ``is_done`` tells a later run so.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas

VERSIONS = "_versions"
BATCH_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
# What Spark calls the folder of rows without a month.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Version:
    number: int
    batch: str
    months: dict[str, str] = field(default_factory=dict)  # month to snapshot; one entry a calendar month


class VersionTaken(RuntimeError):
    """Another writer has committed this version; run the batch again on what is there now."""


def newest_version(spark: SparkSession, folder: str) -> Version | None:
    numbers = _numbers(spark, folder)
    return _version(spark, folder, max(numbers)) if numbers else None


def is_done(spark: SparkSession, folder: str, batch: str) -> bool:
    """Whether some version was committed by this batch."""
    mine = {int(name.split("-")[0]) for name in _names(spark, folder, f"snapshot=*-{_checked(batch)}", "snapshot=")}
    return any(_version(spark, folder, n).batch == batch for n in mine & set(_numbers(spark, folder)))


def read_version(
    spark: SparkSession, folder: str, version: Version | None, since: date | None = None, until: date | None = None
) -> DataFrame:
    """Claims of a version, optionally of a range of days; months out of range are not even listed."""
    low, high = (str(d.replace(day=1)) if d is not None else None for d in (since, until))
    months = {
        month: snapshot
        for month, snapshot in (version.months if version else {}).items()
        if (low is None or (month != NO_MONTH and month >= low)) and (high is None or (month != NO_MONTH and month <= high))
    }
    claims = _rows(spark, folder, months)
    if since is not None:
        claims = claims.filter(F.col("date") >= F.lit(since))
    if until is not None:
        claims = claims.filter(F.col("date") <= F.lit(until))
    return claims


def merge_claims(
    spark: SparkSession,
    folder: str,
    changed: DataFrame,
    batch: str,
    beside: Callable[[Version, DataFrame], None] | None = None,
) -> Version | None:
    """Take rows into the table under their number and commit; the version that results.

    ``changed`` is a stored table, as it is read three times, with each number once: rows take the
    place of the row of that number, which has the same date, or are new. Only their months are
    rewritten. A batch that is done already, or changes nothing, commits nothing. ``beside`` is
    called before the commit with the version to be and the rows as they were of the numbers that
    change, to write what belongs to the version.
    """
    version = newest_version(spark, folder)
    if is_done(spark, folder, batch):
        return version
    month = F.trunc("date", "month")
    touched = {_folder_name(r["month"]) for r in changed.select(month.alias("month")).distinct().collect()}
    if not touched:
        return version
    number = version.number + 1 if version else 0
    present = version.months if version else {}
    before = _rows(spark, folder, {m: s for m, s in present.items() if m in touched})
    # Only the numbers of the changed rows travel to the months that they touch.
    kept = before.join(changed.select("no"), "no", "left_anti")
    snapshot = f"{number:08d}-{_checked(batch)}"
    rows = kept.select(*schemas.CLAIMS.fieldNames()).unionByName(changed.select(*schemas.CLAIMS.fieldNames()))
    (
        rows.withColumn("month", month)
        .hint("rebalance", "month")
        .withColumn("snapshot", F.lit(snapshot))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")  # of a run that died only what is written again
        .partitionBy("snapshot", "month")
        .parquet(folder)
    )
    version = Version(number, batch, present | dict.fromkeys(touched, snapshot))
    if beside is not None:
        beside(version, before.join(changed.select("no"), "no", "left_semi"))
    return _commit(spark, folder, version)


def _rows(spark: SparkSession, folder: str, months: dict[str, str]) -> DataFrame:
    if not months:
        return spark.createDataFrame([], schemas.CLAIMS)
    paths = [f"{folder}/snapshot={snapshot}/month={month}" for month, snapshot in sorted(months.items())]
    return spark.read.schema(schemas.CLAIMS).parquet(*paths)


def _folder_name(month: date | None) -> str:
    return NO_MONTH if month is None else str(month)


def _checked(batch: str) -> str:
    if not BATCH_NAME.fullmatch(batch):
        raise ValueError(f"a batch is named by letters, digits, points, hyphens and underscores: {batch!r}")
    return batch


# Versions are files of some kilobytes, which the driver reads and writes by Hadoop's own API, so
# they can lie wherever Spark's tables can.


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name."""
    found, files = _path(spark, path)
    return files.exists(found)


def _names(spark: SparkSession, folder: str, pattern: str, prefix: str) -> list[str]:
    path, files = _path(spark, f"{folder}/{pattern}")
    return [status.getPath().getName().removeprefix(prefix) for status in files.globStatus(path) or []]


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return [int(name.removesuffix(".json")) for name in _names(spark, folder, f"{VERSIONS}/*.json", "")]


def _version(spark: SparkSession, folder: str, number: int) -> Version:
    path, files = _path(spark, f"{folder}/{VERSIONS}/{number:08d}.json")
    stream = files.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(**json.loads(text))


def _commit(spark: SparkSession, folder: str, version: Version) -> Version:
    """Put the version's file in place, whole or not at all, unless the number is taken."""
    final, files = _path(spark, f"{folder}/{VERSIONS}/{version.number:08d}.json")
    draft, _ = _path(spark, f"{folder}/{VERSIONS}/.{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    stream.write(json.dumps(version.__dict__, sort_keys=True).encode())
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    no_option = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(final), no_option)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            raise VersionTaken(f"version {version.number} of {folder}") from None
        raise
    return version
