"""Token counts from flat token files by a scan for separators.

A flat token file is nothing but token numbers, two bytes each, least byte first, with an end-of-document
number after each text; it has no index. Its blocks are searched for that number all at once.
What a block cannot know, where the document that it begins inside started, comes from a
prefix scan over the blocks: the tokens before it and the last separator before it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .frames import shared_folder, stored

# Fixed value: how text is split before the merges of the given vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of a byte-level vocabulary under 65,536, and a number that none of them has."""

    path: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    end_of_document: int = 50256
    pattern: str = PATTERN


BLOCK_TOKENS = 1 << 18
# A file holds at most so many tokens, or one longer text.
FILE_TOKENS = 1 << 24


def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    merges = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def write_token_files(docs: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> str:
    """Write the tokens of every whole ``text`` as flat files to the shared folder; its path.

    The files are written by Spark's own writer, so any file system that Spark knows will do. A
    null text counts as empty: its end is written all the same. A file is cut by its tokens, not by
    its texts, as it is read as one cell: it has ``FILE_TOKENS`` at most, or one longer text.
    """
    spark = docs.sparkSession
    with open(vocabulary.path, "rb") as file:  # a few MB, the same at any size of input
        ranks = spark.sparkContext.broadcast(file.read())

    end = int(vocabulary.end_of_document).to_bytes(2, "little")
    most = 2 * FILE_TOKENS

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per file: the texts' tokens, with an end between every two."""
        encoder = _encoder(ranks.value, vocabulary.pattern)
        texts, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                tokens = np.array(encoder.encode_ordinary(text.as_py() or ""), dtype="<u2").tobytes()
                if texts and size + len(tokens) > most:
                    yield pa.RecordBatch.from_arrays([pa.array([end.join(texts)], pa.binary())], ["tokens"])
                    texts, size = [], 0
                texts.append(tokens)
                size += len(tokens) + len(end)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(texts)], pa.binary())], ["tokens"])

    path = shared_folder(spark)
    encoded = docs.select("text").mapInArrow(encode, "tokens binary")
    encoded.select(F.col("tokens").cast("string")).write.option("lineSep", end.decode("latin-1")).option(
        "encoding", "ISO-8859-1"
    ).option("maxRecordsPerFile", 1).text(path)
    return path


def block_figures(spark: SparkSession, path: str, end_of_document: int) -> DataFrame:
    """One row per block of each file below ``path``: what can be told from the block alone.

    ``file, block, n_tokens, n_ends``, the tokens before its first and after its last separator
    (``head``, ``tail``; all of them if it has none), and the ``inner`` documents' lengths.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                tokens = np.frombuffer(content.as_buffer(), dtype="<u2")
                rows = []
                for block in range(-(-len(tokens) // BLOCK_TOKENS)):
                    part = tokens[block * BLOCK_TOKENS : (block + 1) * BLOCK_TOKENS]
                    ends = np.flatnonzero(part == end_of_document)
                    head = int(ends[0]) if len(ends) else len(part)
                    tail = len(part) - 1 - int(ends[-1]) if len(ends) else len(part)
                    rows.append((block, len(part), len(ends), head, tail, np.diff(ends) - 1))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file.as_py()] * len(rows)), *[pa.array(c, pa.int64()) for c in columns[:5]],
                         pa.array([x.tolist() for x in columns[5]], pa.list_(pa.int64()))],
                        ["file", "block", "n_tokens", "n_ends", "head", "tail", "inner"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(
        search,
        "file string, block bigint, n_tokens bigint, n_ends bigint, head bigint, tail bigint, inner array<bigint>",
    )


def documents_of(blocks: DataFrame) -> DataFrame:
    """``file, number, first_token, n_tokens`` of every document, from the blocks' figures.

    The separator counts to no document. What follows the last separator of a file is a
    document if it has a token; an empty file has none.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    placed = blocks.withColumn("start", start)
    after_end = F.when(F.col("n_ends") > 0, F.col("start") + F.col("n_tokens") - F.col("tail"))
    scanned = (
        placed.withColumn("after_end", after_end)
        .withColumn("open_from", F.coalesce(F.max("after_end").over(before), F.lit(0)))
        .withColumn("done", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
        .withColumn("last", F.lead("block").over(order).isNull())
    )
    first = F.struct(
        F.col("open_from").alias("first_token"), (F.col("start") + F.col("head") - F.col("open_from")).alias("n_tokens")
    )
    # The lengths of the documents inside a block, with where each begins, by one running sum.
    begin = F.struct(
        F.array().cast("array<struct<first_token:bigint,n_tokens:bigint>>").alias("found"),
        (F.col("start") + F.col("head") + 1).alias("at"),
    )
    inner = F.aggregate(
        "inner", begin,
        lambda s, n: F.struct(
            F.array_append(s["found"], F.struct(s["at"].alias("first_token"), n.alias("n_tokens"))).alias("found"),
            (s["at"] + n + 1).alias("at"),
        ),
        lambda s: s["found"],
    )
    rest_from = F.coalesce("after_end", "open_from")
    rest = F.struct(rest_from.alias("first_token"), (F.col("start") + F.col("n_tokens") - rest_from).alias("n_tokens"))
    none = F.array().cast("array<struct<first_token:bigint,n_tokens:bigint>>")
    found = F.concat(
        F.when(F.col("n_ends") > 0, F.concat(F.array(first), inner)).otherwise(none),
        F.when(F.col("last") & (rest["n_tokens"] > 0), F.array(rest)).otherwise(none),
    )
    return scanned.select("file", "done", F.posexplode(found).alias("place", "doc")).select(
        "file", (F.col("done") + F.col("place")).alias("number"), "doc.first_token", "doc.n_tokens"
    )


def count_tokens(docs: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``doc_id, file, number, first_token, n_tokens`` for every row of ``docs``.

    The texts are written as flat files, which are then scanned. The files name no documents: a
    task writes its rows in order, so the place of a document in its file and of the
    file among those of its task give its row. ``docs`` has to be read from files, so that
    both passes read the same rows in the same tasks; if they do not, an error is raised. Rows with a
    null id or a repeated one are counted like all others; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = write_token_files(docs, vocabulary)
    found = stored(documents_of(block_figures(spark, path, vocabulary.end_of_document)))
    pattern = r"part-(\d+)-[^/]*-c(\d+)[^/]*$"
    files = found.groupBy("file").agg(F.count("*").alias("texts")).select(
        F.col("file").alias("of_file"), "texts",
        F.regexp_extract("file", pattern, 1).cast("bigint").alias("task"),
        F.regexp_extract("file", pattern, 2).cast("bigint").alias("piece"),
    )
    # The texts in the files that the same task has written before.
    earlier = Window.partitionBy("task").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("texts").over(earlier), F.lit(0)))
    numbered = found.join(placed, F.col("file") == F.col("of_file")).withColumn("row", F.col("before") + F.col("number"))
    task = F.spark_partition_id().cast("bigint")
    rows = stored(
        docs.select(
            "doc_id", task.alias("row_task"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row_row")
        )
    )
    counts = numbered.groupBy("task").agg(F.count("*").alias("n")).join(
        rows.groupBy(F.col("row_task").alias("task")).agg(F.count("*").alias("m")), "task", "full"
    )
    if not counts.where("not (n <=> m)").isEmpty():
        raise ValueError("the rows of docs came in another order when read again")
    return rows.join(numbered, (F.col("task") == F.col("row_task")) & (F.col("row") == F.col("row_row"))).select(
        "doc_id", F.regexp_extract("file", "[^/]*$", 0).alias("file"), "number", "first_token", "n_tokens"
    )
