"""Near-duplicates by BagMinHash signatures of word shingles with their counts.

The weighted Jaccard similarity of two multisets is the overlap of the counts over their
union. For a signature that estimates it without bias, every shingle has a Poisson process
of points in time, each point with a place on the axis of counts and one of the signature's
components. A text sees the points of a shingle up to its count, and a component holds
the first point seen. Counts are whole numbers, cut into the dyadic ranges (0,1], (1,2],
(2,4], ...; the process of each range is drawn as a whole and a point in the range is
seen if its place is within the count, so a count of a million costs twenty ranges. Points
later than all components can need are never drawn.

Signatures are cut into bands; texts with an equal band are candidates, and candidates that
hang together form a group. Within groups all multiset overlaps are computed exactly, as
products of matrices inside tasks; only the links that hold a class together leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import fresh, shards, stored
from .words import Words, mixed, word_chunks

_U64 = np.uint64


@dataclass(frozen=True)
class Near:
    """Shingles of ``words`` words; texts are linked from ``similarity`` on.

    With 44 bands of 6 components a pair of similarity 0.8 has no band in common with
    probability (1 - 0.8**6)**44, or 2 in a million; one of 0.1 has one with 4 in 100,000, so
    that texts with a common line do not hang together.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 44
    rows: int = 6
    block: int = 512  # texts of a large group that are compared with as many others at a time

    @property
    def components(self) -> int:
        return self.bands * self.rows


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle; a row with fewer words has one shingle of them all."""
    row = words.row_of_word()
    grams = words.grams(size)
    at = np.flatnonzero(row[: len(grams)] == row[size - 1 : size - 1 + len(grams)])
    lengths = np.diff(words.first)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    whole = np.zeros(len(short), dtype=np.uint64)
    for k in range(size):
        has = lengths[short] > k
        whole[has] = mixed(whole[has] + words.hashes[words.first[short[has]] + k] + _U64(k + 1))
    return np.concatenate((row[at], short)), np.concatenate((grams[at], whole))


def counted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) with their counts, in that order."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def _unit(x: np.ndarray) -> np.ndarray:
    """From 64 random bits a number above 0, up to 1."""
    return ((x >> _U64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def signatures(
    n_rows: int, rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, m: int
) -> np.ndarray:
    """(n_rows, m) 64-bit components; equal components estimate the weighted Jaccard similarity."""
    out = np.zeros((n_rows, m), dtype=np.uint64)
    totals = np.bincount(rows, weights=counts, minlength=n_rows)
    todo = np.flatnonzero(totals > 0)
    if not len(todo):
        return out
    # A process for each dyadic range that reaches below the count: low, length, seed.
    depth = np.ceil(np.log2(counts)).astype(np.int64) + 1
    entry = np.repeat(np.arange(len(counts)), depth)
    level = np.arange(len(entry)) - np.repeat(np.cumsum(depth) - depth, depth)
    low = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    length = np.where(level == 0, 1.0, low)
    owner, top = rows[entry], counts[entry].astype(np.float64)
    seed = mixed(hashes[entry] + level.astype(np.uint64) * _U64(0x9FB21C651E98DF25))
    wait = np.log(m) + 5.0  # with probability above 0.99 all components have a point by then
    while len(todo):
        until = np.zeros(n_rows)
        until[todo] = wait / totals[todo]
        first = np.full(n_rows * m, np.inf)
        active = np.flatnonzero(until[owner] > 0)
        time = np.zeros(len(active))
        point = 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(active):
            point += 1
            a = mixed(seed[active] + _U64(point * 0xA0761D6478BD642F % (1 << 64)))
            time = time - np.log(_unit(a)) / (length[active] * m)
            near = time <= until[owner[active]]
            active, time, a = active[near], time[near], a[near]
            b = mixed(a ^ _U64(0xE7037ED1A0B428DB))
            seen = low[active] + _unit(b) * length[active] <= top[active]
            slot = owner[active] * m + (mixed(b) % _U64(m)).astype(np.int64)
            slot, when, value = slot[seen], time[seen], b[seen]
            np.minimum.at(first, slot, when)
            found.append((slot, when, value))
        flat = out.reshape(-1)
        for slot, when, value in found:
            won = when == first[slot]
            flat[slot[won]] = value[won]
        missing = np.isinf(first.reshape(n_rows, m)).any(axis=1)
        todo = todo[missing[todo]]
        wait *= 2
    return out


def _signed(docs: DataFrame, near: Near) -> DataFrame:
    """``node, doc_id, bands`` (a hash of each band) of the texts that have a word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_chunks(batch.column(2)):
                rows, hashes, counts = counted(*shingles(words, near.words))
                full = signatures(b - a, rows, hashes, counts, near.components)
                has = np.flatnonzero(np.diff(words.first) > 0)
                parts = full[has].reshape(len(has), near.bands, near.rows)
                bands = np.full((len(has), near.bands), 1, dtype=np.uint64) * np.arange(1, near.bands + 1, dtype=np.uint64)
                for k in range(near.rows):
                    bands = mixed(bands + parts[:, :, k])
                offsets = np.arange(len(has) + 1, dtype=np.int32) * near.bands
                kept = pa.array(has + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(kept),
                        batch.column(1).take(kept),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1).view(np.int64))),
                    ],
                    ["node", "doc_id", "bands"],
                )

    return docs.select("node", "doc_id", "text").mapInArrow(
        sign, "node binary, doc_id bigint, bands array<bigint>"
    )


def overlaps(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """(n, n) weighted Jaccard similarities of the multisets (row, hash, count).

    The overlap of two counts is the number of steps both reach, so each step of each hash is
    a column of zeros and ones, and overlaps are products. Columns that a single row has
    add nothing and are left out; the others are taken a few thousand at a time.
    """
    totals = np.bincount(rows, weights=counts, minlength=n)
    each = np.repeat(np.arange(len(rows)), counts)
    step = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
    key = mixed(hashes[each] + step.astype(np.uint64) * _U64(0x9FB21C651E98DF25))
    order = np.argsort(key)
    ordered, owner = key[order], rows[each][order]
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(ordered)))
    shared = np.repeat(size > 1, size)
    column = (np.cumsum(size > 1) - 1).repeat(size)[shared]
    owner = owner[shared]
    same = np.zeros((n, n), dtype=np.float32)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1, width))
    for low, high in zip(cuts, np.append(cuts[1:], len(column)), strict=True):
        part = np.zeros((n, width), dtype=np.float32)
        part[owner[low:high], column[low:high] % width] = 1
        same += part @ part.T
    union = totals[:, None] + totals[None, :] - same
    return same / np.maximum(union, 1)


def linked(texts: pa.Array, near: Near) -> np.ndarray:
    """For each text the first one that it hangs together with by links among the texts."""
    rows, hashes, counts = [], [], []
    for a, _, words in word_chunks(texts):
        r, h, c = counted(*shingles(words, near.words))
        rows.append(r + a)
        hashes.append(h)
        counts.append(c)
    n = len(texts)
    links = overlaps(*(np.concatenate(x) for x in (rows, hashes, counts)), n) >= near.similarity
    np.fill_diagonal(links, True)
    label = np.arange(n)
    while True:
        nearer = np.where(links, label[None, :], n).min(axis=1)
        if (nearer == label).all():
            return label
        label = nearer


def _links(nodes: DataFrame, groups: DataFrame, near: Near) -> DataFrame:
    """``a, b``: links that hold the classes together, from all pairs inside the groups.

    ``groups`` has the ``label`` of each ``node`` and its ``first`` id. Groups up to a block go
    many to a task; of a larger one every two blocks are a task of their own.
    """
    sizes = stored(groups.groupBy("label").agg(F.count("*").alias("size")))
    blocks = F.ceil(F.col("size") / near.block).cast("int")
    placed = groups.join(sizes.where("size > 1"), "label").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    n_shards = shards(groups.sparkSession)
    dealt = placed.withColumn(
        "deal",
        F.when(
            F.col("blocks") == 1, F.array(F.pmod(F.xxhash64("label"), F.lit(n_shards)))
        ).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda other: F.xxhash64("label", F.least(own, other), F.greatest(own, other)),
            )
        ),
    ).select(F.col("node").alias("of_node"), "first", "label", "deal")
    whole = nodes.join(
        dealt.hint("shuffle_hash"),
        (F.col("node") == F.col("of_node")) & F.col("doc_id").eqNullSafe(F.col("first")),
    ).select(F.explode("deal").alias("deal"), "label", "node", "text")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("node", "ascending")]).combine_chunks()
        labels, found = table.column("label").to_pylist(), table.column("node").to_pylist()
        texts = table.column("text").combine_chunks()
        out: tuple[list[bytes], list[bytes]] = ([], [])
        start = 0
        for end in range(1, len(labels) + 1):
            if end < len(labels) and labels[end] == labels[start]:
                continue
            if end - start > 1:
                roots = linked(texts.slice(start, end - start), near)
                for i in np.flatnonzero(roots != np.arange(end - start)).tolist():
                    a, b = found[start + roots[i]], found[start + i]
                    if a != b:
                        out[0].append(a)
                        out[1].append(b)
            start = end
        return pa.table({"a": pa.array(out[0], pa.binary()), "b": pa.array(out[1], pa.binary())})

    return whole.groupBy("deal").applyInArrow(compare, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of the connected part each node of ``edges`` is in.

    Labels spread along the links and along the labels themselves, so that the rounds grow
    with the logarithm of the longest chain. Every round is a written table.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
            "node", F.least("node", "b").alias("label")
        )
    )
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        around = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        nearer = labels.join(around, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "seen").alias("label")
        )
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stored(
            nearer.join(further, "label", "left").select(
                "node", "old", F.least("label", "next").alias("label")
            )
        )
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """``doc_id, node, class_id, part`` of every row of ``docs``: rows of a class are near-duplicates.

    A class is a connected part of the texts linked by a similarity of at least
    ``near.similarity``; ``class_id`` is its smallest ``doc_id``. ``node`` is a digest of the text,
    ``part`` the smallest of the class; it is null for texts without words.

    1. Equal texts are one node. Each node is signed and put into a bucket for every band.
    2. Buckets join their nodes into groups, by ties to each bucket's smallest node, the leader.
    3. Inside the groups all pairs are checked exactly, so no link between candidates is lost.

    Texts without words, null ones included, are each alone: their ``class_id`` is their own
    ``doc_id``. Rows without id take part; a class of only such rows has a null ``class_id``.
    Rows with one id and different texts are different nodes. An empty table gives none.
    """
    nodes = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"),
        "text",
    )
    signed = stored(
        _signed(nodes, near)
        .groupBy("node")
        .agg(F.min("doc_id").alias("first"), F.any_value("bands").alias("bands"))
    )
    buckets = signed.select("node", F.explode("bands").alias("bucket"))
    leaders = stored(
        buckets.groupBy("bucket")
        .agg(F.min("node").alias("leader"), F.count("*").alias("size"))
        .where("size > 1")
        .select("bucket", "leader")
    )
    # A node's leaders are at most as many as there are bands. It is tied to the smallest of them,
    # and that one to the others: in a large group one tie a node, and a few between leaders.
    led = buckets.join(leaders, "bucket").groupBy("node").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))
    smallest = F.get("leaders", F.lit(0))
    others = F.array_union(F.slice("leaders", 2, F.size("leaders")), F.array("node"))
    ties = led.select(smallest.alias("a"), F.explode(others).alias("b")).where("a <> b").distinct()
    groups = stored(components(ties).join(signed.select("node", "first"), "node"))
    links = stored(_links(nodes, groups, near))
    return _classes(
        nodes.select("doc_id", "node", F.expr(_HAS_WORD).alias("has_word")), components(links)
    )


_HAS_WORD = r"coalesce(text rlike '[^\\x20\\x09-\\x0D]', false)"


def _classes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Classes of all rows; hot nodes and classes are on the left of joins, where they can be cut."""
    worded = rows.where("has_word")
    first = stored(worded.groupBy("node").agg(F.min("doc_id").alias("first")))
    labelled = stored(
        first.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    )
    class_ids = stored(labelled.groupBy("label").agg(F.min("first").alias("class_id")))
    of_node = stored(
        labelled.join(class_ids, "label").select(F.col("node").alias("known"), "class_id", F.col("label").alias("part"))
    )
    alone = rows.where("not has_word").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary").alias("part"))
    return (
        worded.join(of_node, F.col("node") == F.col("known"))
        .select("doc_id", "node", "class_id", "part")
        .unionByName(alone)
    )


def one_of_each(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row of ``docs`` for every class, that with the smallest id; all columns as they are.

    Rows alike in id and text count as one. Texts without words all stay. Rows without id
    come last in their class.
    """
    (node,) = fresh(docs, "node")
    classes = stored(near_duplicates(docs.select("doc_id", "text"), near))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("best")
    winners = classes.where("part is not null").groupBy("part").agg(best).select(
        F.col("best.node").alias("win_node"), F.col("best.doc_id").alias("win_id")
    )
    same = (F.col(node) == F.col("win_node")) & F.col("doc_id").eqNullSafe(F.col("win_id"))
    keyed = docs.where(F.expr(_HAS_WORD)).withColumn(node, F.unhex(F.md5(F.col("text").cast("binary"))))
    kept = keyed.join(winners, same, "left_semi").dropDuplicates(["doc_id", node]).drop(node)
    return kept.union(docs.where(~F.expr(_HAS_WORD)))
