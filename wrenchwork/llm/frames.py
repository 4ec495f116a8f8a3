"""Small helpers on frames: names that cannot clash, tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import INITIAL_PARTITIONS, prepare

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Texts are stored compressed, and a group is held in one task.
BYTES_PER_PARTITION = 32 << 20


def fresh(frame: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of the frame has, without regard to case."""
    taken = {c.lower() for c in frame.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def wider(frame: DataFrame, names: list[str], kinds: list[str]) -> StructType:
    """The frame's schema with more columns at the end."""
    schema = StructType(list(frame.schema.fields))
    for name, kind in zip(names, kinds, strict=True):
        schema = schema.add(name, kind)
    return schema


@cache
def _folder_of_one_machine() -> str:
    return tempfile.mkdtemp(prefix="wrenchwork-")


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder is
    taken in local mode, as in tests, and on a cluster an error is raised.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        folder = _folder_of_one_machine()
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared folder and go on from what was written.

    Cuts the lineage: a lost executor costs its tasks, not what led to the table. The
    table stays below ``spark.checkpoint.dir`` until that folder is cleared.
    """
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def passed(frame: DataFrame) -> DataFrame:
    """As ``stored``, and what the frame has shuffled goes from the disks as soon as it is written.

    Else it stays until the driver happens to collect its garbage.
    """
    conf = frame.sparkSession.conf
    before = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        return stored(frame)
    finally:
        conf.set(SHUFFLES_GO, before)


def sized(spark: SparkSession, folder: str) -> SparkSession:
    """The session set up for the tables in ``folder``: a shuffle begins with a partition for
    every ``BYTES_PER_PARTITION`` stored, and so the groups of ``shards`` follow the bytes."""
    return prepare(spark, folder, BYTES_PER_PARTITION)


def shards(spark: SparkSession, per_partition: int = 2) -> int:
    """How many groups to deal keys into: some for every partition that shuffles begin with."""
    fewest = spark.conf.get("spark.sql.shuffle.partitions")
    return per_partition * max(int(fewest), int(spark.conf.get(INITIAL_PARTITIONS, None) or fewest))
