"""Nearest vectors by cosine: probed lists, scanned with adaptive dimensions.

Vectors are dealt into lists by their nearest centroid, fitted on a bounded sample. How many
lists a query has to probe is measured, not guessed: a few test queries are searched exactly
against all vectors, and the number of nearest lists that hold enough of what they find is
taken for all queries.

Within a list the vectors, of length one and rotated at random, lie in blocks of columns. After
each block the partial distance to a query, scaled up to all dimensions, is an estimate of the
whole one; a candidate whose estimate is too far off to be a false alarm (or whose partial
distance alone is too large) is abandoned, so most are dropped after the first block. The bound
they have to meet is that of the nearest found so far, which begins with a few vectors chosen
beforehand, the starters. Scores of what is left are computed anew on the original vectors.

Lists are packed into bins of bounded size, a list that is larger is spread over several, and
the queries of a bin are dealt into blocks of bounded size. A task holds one bin and one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .frames import stored


@dataclass(frozen=True)
class Search:
    k: int = 5
    list_rows: int = 512  # wanted in a list
    most_lists: int = 4096
    sample_rows: int = 16  # of the sample for each list; at most 65,536 in all
    rounds: int = 6  # of fitting
    starters: int = 2048  # vectors whose distances give each query its first bound
    test_queries: int = 256  # of the starters
    least_recall: float = 0.97  # of the test queries, when probes are counted
    bin_rows: int = 8192
    block_queries: int = 1024
    block_dims: int = 16
    slack: float = 2.1  # of the test that abandons; larger abandons less
    seed: int = 11


@dataclass
class Index:
    """What every task needs: some megabytes, whatever the number of vectors."""

    dims: int
    rotation: np.ndarray
    centroids: np.ndarray  # of length one, one a row
    starter_ids: np.ndarray | None = None
    starters: np.ndarray | None = None  # of length one
    starter_lists: np.ndarray | None = None
    sizes: np.ndarray | None = None  # rows of each list
    first: np.ndarray | None = None  # first bin of each list
    spread: np.ndarray | None = None  # number of bins of each list
    probes: int = 1


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def unit(vectors: np.ndarray) -> np.ndarray:
    """The rows scaled to length one; first by their largest component, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of corresponding rows, in double precision; equal rows give equal scores."""
    largest = [np.abs(x).max(axis=1) for x in (a, b)]
    if any(m.size and (m.max() > 1e100 or m.min() < 1e-100) for m in largest):
        a, b = a / largest[0][:, None], b / largest[1][:, None]
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Directions that a sample of unit vectors gathers around."""
    found = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = nearest(sample, found)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        found[length > 0] = sums[length > 0] / length[length > 0, None]
    return found


def nearest(vectors: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row."""
    rows = max(1, (1 << 22) // len(found))
    parts = [(vectors[a : a + rows] @ found.T).argmax(axis=1) for a in range(0, len(vectors), rows)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _chosen(vectors: DataFrame, wanted: int, rows: int, s: Search) -> pa.Table:
    """``wanted`` of the ``rows`` rows, by a hash of their id: the same at every run."""
    order = F.pmod(F.xxhash64("vec_id", F.lit(s.seed)), F.lit(1 << 30))
    below = math.ceil((1 << 30) * min(1.0, (1.2 * wanted + 64) / rows))
    near = vectors.where(order < below).orderBy(order, "vec_id", "vector").limit(wanted)
    return near.toArrow()


def _fitted(vectors: DataFrame, dims: int, rows: int, s: Search) -> Index:
    """Centroids from at most 65,536 rows."""
    lists = min(max(1, rows // s.list_rows), s.most_lists)
    sample = _chosen(vectors.select("vec_id", "vector"), min(s.sample_rows * lists, 1 << 16), rows, s)
    directions = unit(matrix(sample["vector"], dims))
    return Index(dims, rotation(dims, s.seed), centroids(directions, lists, s.rounds, s.seed))


def _with_lists(vectors: DataFrame, shared) -> DataFrame:
    """The vectors with their ``list``."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            place = nearest(unit(matrix(batch["vector"], index.dims)), index.centroids)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["vector"], batch["asked"], pa.array(place.astype(np.int32))],
                ["vec_id", "vector", "asked", "list"],
            )

    return vectors.mapInArrow(assign, "vec_id bigint, vector array<double>, asked boolean, list int")


def _best(owner: np.ndarray, distance: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` rows of each owner that are nearest, then first in ``place``."""
    order = np.lexsort((place, distance, owner))
    ranked = owner[order]
    first = np.searchsorted(ranked, ranked, side="left")
    return order[np.arange(len(order)) - first < k]


def _probes(listed: DataFrame, shared, s: Search) -> int:
    """The number of nearest lists that hold ``least_recall`` of the nearest of the test queries.

    All vectors are compared with the test queries, some hundred; ``k`` a query leave a task.
    """
    dims, k = shared.value.dims, s.k
    ids, asked = shared.value.starter_ids[: s.test_queries], shared.value.starters[: s.test_queries]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        rank = np.argsort(np.argsort(-(asked @ index.centroids.T), axis=1, kind="stable"), axis=1)
        best = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), dtype=np.int64), np.zeros((len(ids), k), dtype=np.int64)
        for batch in batches:
            own = batch["vec_id"].to_numpy()
            away = 1.0 - asked @ unit(matrix(batch["vector"], dims)).T
            away[ids[:, None] == own[None, :]] = np.inf
            place = rank[:, batch["list"].to_numpy()]
            many = [
                np.concatenate([x, y], axis=1)
                for x, y in zip(best, (away, np.broadcast_to(own, away.shape), place), strict=True)
            ]
            top = np.argsort(many[0], axis=1, kind="stable")[:, :k]
            best = tuple(np.take_along_axis(x, top, axis=1) for x in many)
        found = np.isfinite(best[0])
        query = np.broadcast_to(np.arange(len(ids))[:, None], found.shape)[found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(best[0][found]), pa.array(best[1][found]), pa.array(best[2][found])],
            ["query", "away", "vec_id", "place"],
        )

    near = listed.mapInArrow(compare, "query bigint, away double, vec_id bigint, place bigint")
    order = Window.partitionBy("query").orderBy("away", "vec_id")
    found = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("place").count()
    counts = np.zeros(len(shared.value.centroids), dtype=np.int64)
    for row in found.collect():  # one number a list
        counts[row["place"]] = row["count"]
    if not counts.sum():
        return len(counts)
    return int(np.searchsorted(np.cumsum(counts) / counts.sum(), s.least_recall)) + 1


def _bins(sizes: np.ndarray, s: Search) -> tuple[np.ndarray, np.ndarray]:
    """First bin of each list, and over how many it is spread."""
    first, spread = np.zeros(len(sizes), dtype=np.int64), np.maximum(1, -(-sizes // s.bin_rows))
    bin_number, filled = 0, 0
    for number, rows in enumerate(sizes.tolist()):
        if filled and filled + rows > s.bin_rows:
            bin_number, filled = bin_number + 1, 0
        first[number] = bin_number
        filled += rows
        if spread[number] > 1:
            bin_number, filled = bin_number + int(spread[number]), 0
    return first, spread


def _routed(queries: DataFrame, shared, k: int) -> DataFrame:
    """A row per query and bin that holds some of its probed lists.

    ``near`` are the ``k`` nearest starters that lie in a probed list, ``bound`` is the squared
    distance to the last of them: what is farther cannot be among the ``k`` nearest. A query
    probes more lists than usual if those hold less than ``k`` rows besides its own.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids, own = part["vec_id"].to_numpy(), part["own"].to_numpy()
                asked = unit(matrix(part["vector"], index.dims))
                order = np.argsort(-(asked @ index.centroids.T), axis=1, kind="stable")
                reach = np.cumsum(index.sizes[order], axis=1)
                probes = np.maximum(index.probes, (reach < (k + own)[:, None]).sum(axis=1) + 1)
                rank = np.argsort(order, axis=1, kind="stable")
                away = 2.0 - 2.0 * (asked @ index.starters.T)
                away[ids[:, None] == index.starter_ids[None, :]] = np.inf
                away[rank[:, index.starter_lists] >= probes[:, None]] = np.inf
                closest = np.argsort(away, axis=1, kind="stable")[:, :k]
                rows = [
                    (q, int(b), lists, near, bound)
                    for q in range(len(ids))
                    for near, bound in [_start(away[q], closest[q], index.starter_ids, k)]
                    for b, lists in _by_bin(order[q, : probes[q]], index)
                ]
                q, bins, lists, near, bound = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["vec_id"].take(pa.array(q)),
                        part["vector"].take(pa.array(q)),
                        pa.array(bins, pa.int64()),
                        pa.array(lists, pa.list_(pa.int64())),
                        pa.array(near, pa.list_(pa.int64())),
                        pa.array(bound, pa.float64()),
                    ],
                    ["query_id", "vector", "bin", "lists", "near", "bound"],
                )

    return queries.mapInArrow(
        route,
        "query_id bigint, vector array<double>, bin bigint, lists array<bigint>, near array<bigint>, bound double",
    )


def _start(away: np.ndarray, closest: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, float]:
    """Ids of the nearest starters, and the distance none of the results exceeds."""
    if len(closest) < k or not np.isfinite(away[closest[-1]]):
        return [], math.inf
    return ids[closest].tolist(), float(away[closest[-1]])


def _by_bin(lists: np.ndarray, index: Index) -> list[tuple[int, list[int]]]:
    """Bins that hold some of the lists, with those they hold."""
    spread = index.spread[lists]
    bins = np.repeat(index.first[lists], spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
    order = np.argsort(bins, kind="stable")
    cuts = np.flatnonzero(np.diff(bins[order])) + 1
    held = np.repeat(lists, spread)
    return [(bins[part[0]], held[part].tolist()) for part in np.split(order, cuts)]


def scan(asked: np.ndarray, bound: np.ndarray, rows: list[np.ndarray], dims: int, s: Search) -> tuple[np.ndarray, ...]:
    """Pairs of a query and a row that the test does not abandon, with their squared distances.

    ``rows`` are the column blocks of one list, ``bound`` the squared distance each query has
    found so far. Partial distances of the first block come from one product of matrices, those
    of the next ones are computed for the pairs that are left.
    """
    done = rows[0].shape[1]
    block = asked[:, :done]
    partial = (block * block).sum(axis=1)[:, None] + (rows[0] * rows[0]).sum(axis=1)[None, :] - 2.0 * (block @ rows[0].T)
    query, row = np.nonzero(partial <= _limit(bound, done, dims, s)[:, None])
    away = partial[query, row]
    for columns in rows[1:]:
        apart = asked[query, done : done + columns.shape[1]] - columns[row]
        away = away + np.einsum("ij,ij->i", apart, apart)
        done += columns.shape[1]
        left = away <= _limit(bound, done, dims, s)[query]
        query, row, away = query[left], row[left], away[left]
    return query, row, away


def _limit(bound: np.ndarray, done: int, dims: int, s: Search) -> np.ndarray:
    """Largest partial distance of a candidate that is not abandoned; room for rounding is added."""
    if done >= dims:
        return bound * (1 + 1e-9) + 1e-12
    likely = done / dims * (1 + s.slack / math.sqrt(done)) ** 2
    return bound * min(1.0 + 1e-9, likely) + 1e-12


def _searched(shared, s: Search):
    k = s.k
    answer = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(key, vectors, queries):
        index = shared.value
        dims = index.dims
        if not vectors.num_rows or not queries.num_rows:
            return answer.empty_table()
        order = np.argsort(vectors["list"].to_numpy(), kind="stable")
        ids, original = vectors["vec_id"].to_numpy()[order], matrix(vectors["vector"], dims)[order]
        turned = unit(original) @ index.rotation
        blocks = [np.ascontiguousarray(turned[:, a : a + s.block_dims]) for a in range(0, dims, s.block_dims)]
        lists, starts = np.unique(vectors["list"].to_numpy()[order], return_index=True)
        ends = np.append(starts[1:], len(ids))
        query_ids, asked_original = queries["query_id"].to_numpy(), matrix(queries["vector"], dims)
        asked, bound = unit(asked_original) @ index.rotation, queries["bound"].to_numpy().copy()
        owner, probing = _flat(queries["lists"])
        # The starters that gave the bound are found whatever the test says.
        sure, known = _pairs(*_flat(queries["near"]), ids)
        apart = asked[sure] - turned[known]
        held = sure, known, np.einsum("ij,ij->i", apart, apart)
        codes = sure * len(ids) + known
        for number, a, b in zip(lists, starts, ends, strict=True):
            among = owner[probing == number]
            if not len(among):
                continue
            for c in range(a, b, 1024):  # bounds the matrix of partial distances
                d = min(c + 1024, b)
                query, row, away = scan(asked[among], bound[among], [x[c:d] for x in blocks], dims, s)
                query, row = among[query], row + c
                other = (query_ids[query] != ids[row]) & ~np.isin(query * len(ids) + row, codes)
                held = tuple(np.concatenate(x) for x in zip(held, (query[other], row[other], away[other]), strict=True))
                # Those as far as the k-th stay as well: the exact scores decide between them.
                best = _best(held[0], held[2], ids[held[1]], k)
                full = np.bincount(held[0][best], minlength=len(bound)) >= k
                reached = np.zeros(len(bound))
                np.maximum.at(reached, held[0][best], held[2][best])
                bound = np.where(full, np.minimum(bound, reached), bound)
                stay = held[2] <= _limit(bound, dims, dims, s)[held[0]]
                held = tuple(x[stay] for x in held)
        score = cosines(asked_original[held[0]], original[held[1]])
        best = _best(held[0], -score, ids[held[1]], k)
        return pa.table([query_ids[held[0][best]], ids[held[1][best]], score[best]], schema=answer)

    return search


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every entry of a column of lists."""
    lists = lists.combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    return np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy()


def _pairs(query: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query with every row whose id it names."""
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids[order], wanted, side=side) for side in ("left", "right"))
    times = high - low
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    pairs = np.unique(np.stack([np.repeat(query, times), order[at]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _search_one_size(vectors: DataFrame, dims: int, rows: int, s: Search) -> DataFrame:
    """``query_id, vec_id, score``: up to ``k`` of each query and task."""
    spark = vectors.sparkSession
    index = _fitted(vectors, dims, rows, s)
    lists = len(index.centroids)
    listed = stored(_with_lists(vectors, spark.sparkContext.broadcast(index)))
    starters = _chosen(listed.select("vec_id", "vector", "list"), min(s.starters, rows), rows, s)
    index.starter_ids, index.starters = starters["vec_id"].to_numpy(), unit(matrix(starters["vector"], dims))
    index.starter_lists = starters["list"].to_numpy()
    index.sizes = np.zeros(lists, dtype=np.int64)
    for row in listed.groupBy("list").count().collect():  # one number a list
        index.sizes[row["list"]] = row["count"]
    index.first, index.spread = _bins(index.sizes, s)
    index.probes = min(lists, _probes(listed, spark.sparkContext.broadcast(index), s))
    shared = spark.sparkContext.broadcast(index)
    # Rows alike in id are one query, asked by the least of their vectors.
    queries = listed.where("asked").groupBy("vec_id").agg(F.min("vector").alias("vector"), F.count("*").alias("own"))
    routed = stored(_routed(queries, shared, s.k))
    places = spark.createDataFrame(
        [(n, int(index.first[n]), int(index.spread[n])) for n in range(lists)], "list int, first long, spread long"
    )
    placed = listed.join(F.broadcast(places), "list").select(  # at most most_lists rows
        "vec_id", "vector", "list",
        (F.col("first") + F.pmod(F.xxhash64("vec_id", "vector"), "spread")).alias("bin"),
    )
    blocks = routed.groupBy("bin").agg(F.ceil(F.count("*") / s.block_queries).alias("blocks"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    held = placed.join(blocks, "bin").select("vec_id", "vector", "list", "bin", each)
    dealt = routed.join(blocks, "bin").select(
        "query_id", "vector", "lists", "near", "bound", "bin", F.pmod(F.xxhash64("query_id"), "blocks").alias("block")
    )
    return (
        held.groupBy("bin", "block")
        .cogroup(dealt.groupBy("bin", "block"))
        .applyInArrow(_searched(shared, s), "query_id bigint, vec_id bigint, score double")
    )


def nearest_vectors(
    table: DataFrame, asked: Column, id_column: str = "vec_id", vector_column: str = "embedding", s: Search = Search()
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of the rows for which ``asked`` is true.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows
    without id, take no part. A query is compared with vectors of as many components, so a
    table of several sizes is searched size by size. Rows with the query's id are its own;
    other rows alike in id or vector are candidates each, ties go to the smaller id. A query
    with fewer than ``k`` candidates gets all that were found; an empty table gives an empty
    result. Further columns are not read, whatever their names.
    """
    key, vector = F.col(f"`{id_column}`"), F.col(f"`{vector_column}`")
    given = table.where(key.isNotNull() & usable(vector)).select(
        key.cast("long").alias("vec_id"),
        vector.cast("array<double>").alias("vector"),
        F.coalesce(asked, F.lit(False)).alias("asked"),
    )
    sizes = given.groupBy(F.size("vector").alias("dims")).count().collect()  # a row per length of vector
    found = _nothing(table.sparkSession)
    for size in sorted(sizes):
        alike = given.where(F.size("vector") == size["dims"])
        found = found.unionByName(_search_one_size(alike, size["dims"], size["count"], s))
    nearest_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= s.k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
