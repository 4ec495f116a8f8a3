"""How the vocabulary of each source departs from its language's and from other sources'.

Terms are counted per language and source in Arrow batches and added up by Spark. From there
on all is exact integer arithmetic on shares ``p`` (in billionths, with two counts added to
each term) and the divergence ``(p - q)^2 / (p + q)`` of a term, rounded down.

The terms of a group are ranked by cells: terms with the same count in the group and the same
count in the language have the same divergence, so it is computed once a cell, cells of equal
value are merged, and the number of terms in greater values tells which values reach the top.
Only the terms of those are ranked themselves, in the order of their UTF-8 bytes.

The divergence between two sources is a sum over all kept terms. Terms are dealt into blocks
of bounded size, a block is a matrix of terms by sources, and only sums per block and pair of
sources are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import stored
from .words import row_chunks, text_buffers

BILLION = 1_000_000_000

# Bytes of terms: letters A to Z, a to z, and all bytes of characters beyond ASCII.
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass(frozen=True)
class Audit:
    least_docs: int = 10  # documents of the language that hold a kept term
    most_rank: int = 10  # of terms
    rows_per_block: int = 100_000  # counts in a block of terms
    cells_at_once: int = 1 << 21  # numbers of a matrix that are worked on at a time


CHUNK_BYTES = 4 << 20
MERGE_ROWS = 1 << 19
COUNTS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The row of each term of consecutive texts, and the terms with A to Z lower-cased."""
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    # Without what lies between them, terms follow one another as in an Arrow array.
    before = np.cumsum(inside) - inside
    places = np.append(before[starts], inside.sum()).astype(np.int64)
    letters = _LOWER[data[inside]]
    terms = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)]
    )
    return np.searchsorted(offsets, starts, side="right") - 1, terms


def _chunk_counts(groups: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """Counts per language, source and term of the texts of a chunk."""
    rows, terms = terms_of(data, offsets)
    words = terms.dictionary_encode()
    code, size = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(words.dictionary))
    in_doc, times = np.unique(rows * size + code, return_counts=True)
    known: dict[tuple, int] = {}
    pairs = zip(groups["lang"].to_pylist(), groups["source"].to_pylist(), strict=True)
    group = np.array([known.setdefault(pair, len(known)) for pair in pairs], dtype=np.int64)
    keys, place = np.unique(group[in_doc // size] * size + in_doc % size, return_inverse=True)
    names = pa.array([k[0] for k in known], pa.string()), pa.array([k[1] for k in known], pa.string())
    n = np.zeros(len(keys), dtype=np.int64)
    np.add.at(n, place, times)
    return pa.table(
        [
            names[0].take(pa.array(keys // size)),
            names[1].take(pa.array(keys // size)),
            words.dictionary.cast(pa.string()).take(pa.array(keys % size)),
            pa.array(n),
            pa.array(np.bincount(place, minlength=len(keys)).astype(np.int64)),
        ],
        schema=COUNTS,
    )


def _merged(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(COUNTS.names)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the rows of a task, merged whenever ``MERGE_ROWS`` have gathered."""
    held: list[pa.Table] = []
    rows, limit = 0, MERGE_ROWS
    for batch in batches:
        data, offsets = text_buffers(batch["text"])
        groups = batch.select(["lang", "source"])
        for a, b in row_chunks(offsets, CHUNK_BYTES):
            part = offsets[a : b + 1]
            held.append(_chunk_counts(groups.slice(a, b - a), data[part[0] : part[-1]], part - part[0]))
            rows += held[-1].num_rows
            if rows > limit:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows > MERGE_ROWS // 2:  # merging gains little any more: pass on and begin anew
                    yield from held[0].to_batches(1 << 16)
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches(1 << 16)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and rows that hold the term; nulls count as ''."""
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    partial = filled.mapInArrow(_count_batches, "lang string, source string, term string, n bigint, docs bigint")
    # One shuffle by term serves the sums per source, per language, and the join of both.
    return partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact for counts of any size; null if nothing is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = F.nullif(wide(total) + wide(kept) + wide(kept), F.lit(0).cast("decimal(20,0)"))
    scaled = (wide(n) + 2) * F.lit(BILLION).cast("decimal(10,0)")
    return F.call_function("div", scaled, over) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _kept_counts(docs: DataFrame, audit: Audit) -> DataFrame:
    """Counts of kept terms: ``lang, term, source, n, lang_n``."""
    counts = stored(term_counts(docs))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = whole.where(F.col("docs") >= audit.least_docs).drop("docs")
    return stored(counts.drop("docs").join(kept, ["lang", "term"]))


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every language and source that occurs: its sums, the share of a term it lacks.

    ``lang, source, total, lang_total, kept, none``; ``kept`` is the language's number of terms.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = (
        kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
        .groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("kept"))
    )
    zero = F.lit(0).cast("long")
    found = docs.select(*names).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    filled = found.select("lang", "source", *[F.coalesce(F.col(c), zero).alias(c) for c in ("total", "lang_total", "kept")])
    return stored(filled.withColumn("none", share(zero, F.col("total"), F.col("kept"))))


def top_terms(kept: DataFrame, groups: DataFrame, audit: Audit) -> DataFrame:
    """``lang, source, item, value, rank``: terms that a source has more often than its language."""
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("terms"))
    p, q = (share(F.col(n), F.col(t), F.col("kept")) for n, t in (("n", "total"), ("lang_n", "lang_total")))
    valued = (
        cells.join(groups, ["lang", "source"])
        .withColumns({"p": p, "q": q})
        .where("p > q")
        .select("lang", "source", "n", "lang_n", "terms", divergence(F.col("p"), F.col("q")).alias("value"))
    )
    valued = stored(valued)
    # A value has one term at least, so no more values than ranks are needed of a group.
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    downward = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    top = merged.withColumn("place", F.row_number().over(downward)).where(F.col("place") <= audit.most_rank)
    above = F.sum("terms").over(downward) - F.col("terms")
    reached = top.withColumn("above", above).where(F.col("above") < audit.most_rank).select("lang", "source", "value")
    chosen = valued.join(reached, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value")
    named = kept.join(stored(chosen), ["lang", "source", "n", "lang_n"])
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= audit.most_rank)
    return ranked.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def _pair_sums(cells_at_once: int):
    """Sums of the divergence over the terms of one block, for all pairs of its language's sources.

    Rows without a term give each source's share of the terms it lacks.
    """

    def sums(key, block):
        is_term = pc.is_valid(block["term"])
        lacking, rows = block.filter(pc.invert(is_term)), block.filter(is_term)
        order = pc.sort_indices(lacking["source"])
        names = lacking["source"].combine_chunks().take(order)
        none = lacking["p"].combine_chunks().take(order).to_numpy(zero_copy_only=False).astype(np.int64)
        column = pc.index_in(rows["source"], names).to_numpy().astype(np.int64)
        p = rows["p"].to_numpy().astype(np.int64)
        line = pc.dictionary_encode(rows["term"].combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.argsort(line, kind="stable")
        line, column, p = line[at], column[at], p[at]
        lines, sources = (int(line[-1]) + 1 if len(line) else 0), len(names)
        total = np.zeros((sources, sources), dtype=np.int64)
        step = max(1, cells_at_once // max(1, sources))
        for a in range(0, lines, step):
            b = min(a + step, lines)
            x, y = np.searchsorted(line, (a, b))
            shares = np.repeat(none[:, None], b - a, axis=1)  # a line of it is one source
            shares[column[x:y], line[x:y] - a] = p[x:y]
            for s in range(sources - 1):
                apart, both = shares[s + 1 :] - shares[s], shares[s + 1 :] + shares[s]
                total[s, s + 1 :] += (apart * apart // both).sum(axis=1)
        first, second = np.triu_indices(sources, 1)
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * len(first), pa.string()),
                "a": names.take(pa.array(first)),
                "b": names.take(pa.array(second)),
                "value": pa.array(total[first, second]),
            }
        )

    return sums


def source_pairs(kept: DataFrame, groups: DataFrame, audit: Audit) -> DataFrame:
    """``lang, source, item, value, rank``: for each source all others of its language."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / audit.rows_per_block).alias("blocks"))
    shared = groups.join(sizes, "lang")
    p = share(F.col("n"), F.col("total"), F.col("kept"))
    rows = kept.join(shared.drop("none"), ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", p.alias("p")
    )
    lacking = shared.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        "source", F.lit(None).cast("string").alias("term"), F.col("none").alias("p"),
    )
    blocks = rows.unionByName(lacking).groupBy("lang", "block")
    sums = blocks.applyInArrow(_pair_sums(audit.cells_at_once), "lang string, a string, b string, value bigint")
    pairs = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # Both directions of a pair; sources of a language without kept terms are 0 apart.
    both = pairs.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value")
    apart = both.select("lang", "x.a", "x.b", "value")
    bare = groups.where("kept = 0").select("lang", "source")
    one, other = bare.select("lang", F.col("source").alias("a")), bare.select("lang", F.col("source").alias("b"))
    even = one.join(other, "lang").where("a <> b").withColumn("value", F.lit(0).cast("long"))
    order = Window.partitionBy("lang", "a").orderBy(F.col("value").desc(), "b")
    ranked = apart.unionByName(even).withColumn("rank", F.row_number().over(order))
    return ranked.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value", "rank")


def source_audit(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """``lang, source, part, item, value, rank`` of both reports, ``part`` is pair or term.

    A term is a run of letters A to Z of either case and of characters beyond ASCII, in lower
    case as to A to Z. Null texts, languages and sources count as ''. A language keeps the
    terms that at least ``least_docs`` of its rows hold, repeated rows included. A source that
    is alone in its language has no pairs; one without kept terms has no terms. Ties go by the
    item's UTF-8 bytes. Further columns are not read. An empty table gives an empty result.
    """
    kept = _kept_counts(docs.select("text", "lang", "source"), audit)
    groups = _groups(docs, kept)
    part = lambda frame, name: frame.select(
        "lang", "source", F.lit(name).alias("part"), "item", "value", "rank"
    )
    return part(source_pairs(kept, groups, audit), "pair").unionByName(part(top_terms(kept, groups, audit), "term"))
