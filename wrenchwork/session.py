"""Session settings the operators count on."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

SETTINGS = {
    # A key that holds a large share of a table is cut at run time into several
    # tasks. Forced, so that a join is also cut where a later step then needs one
    # more shuffle of its result: cheap beside one task with a third of the rows.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A join side whose partitions all turn out this small is hashed per
    # partition, which spares sorting the other side.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m",
}

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
BYTES_PER_PARTITION = 256 << 20
MOST_PARTITIONS = 500_000

# Sizes of folders already asked for, by application.
_KNOWN: dict[tuple[str, str], int] = {}


def prepare(
    spark: SparkSession,
    folder: str | None = None,
    bytes_per_partition: int = BYTES_PER_PARTITION,
    most_partitions: int = MOST_PARTITIONS,
) -> SparkSession:
    """Set the session up, and its shuffles for the size of the tables in ``folder``.

    The files of a folder are summed up once per application. Beyond ``most_partitions``
    times ``bytes_per_partition`` partitions grow.
    """
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    if folder is not None:
        key = (spark.sparkContext.applicationId, folder)
        if key not in _KNOWN:
            _KNOWN[key] = stored_bytes(spark, folder)
        wanted = partitions_for(_KNOWN[key], bytes_per_partition, most_partitions)
        present = spark.conf.get(INITIAL_PARTITIONS, None)
        if wanted > int(present or spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set(INITIAL_PARTITIONS, str(wanted))
    return spark


def partitions_for(
    stored: int, each: int = BYTES_PER_PARTITION, most: int = MOST_PARTITIONS
) -> int:
    """Shuffle partitions to begin with for tables of that many bytes.

    A query shuffles some of the columns, so a partition gets a part of the
    bytes given for ``each``; adaptive execution joins those that turn out small.
    """
    return min(max(1, math.ceil(stored / each)), most)


def stored_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of the files below a folder, as its file system has them on record."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(path).getLength()
