"""Vector search, filter audit and source audit: brute force, SQL, odd rows."""

from __future__ import annotations

import dataclasses
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from conftest_llm import LONG, PROSE
from wrenchwork.llm import filter_audit as fa, oracle, source_audit as sa
from wrenchwork.llm.frames import stored
from wrenchwork.llm.queries import QUERIES
from wrenchwork.llm.vector_search import Search, nearest_vectors, scan, usable

FOLDER = "/root/testdata/sf0.01"
from pyspark.sql import functions as F  # noqa: E402


def vectors_of(folder):
    rows = duckdb.sql(f"select vec_id, embedding from '{folder}/embeddings.parquet' order by 1").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)


def brute(ids, x, every=50, k=5):
    length = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = (x * x[q]).sum(axis=1) / (length * length[q])
        score[ids == ids[q]] = -np.inf
        order = np.lexsort((ids, -score))[:k]
        out[int(ids[q])] = [(int(ids[i]), score[i]) for i in order if score[i] > -np.inf]
    return out


def by_query(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_search_recall(spark, folder):
    expected, found = brute(*vectors_of(folder)), by_query(QUERIES["op11_vector_search"](spark, folder))
    assert set(found) == set(expected)
    hits = 0
    for q, rows in found.items():
        scores = dict(expected[q])
        assert len(rows) == 5 and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        hits += len(scores.keys() & dict(rows).keys())
        for key, score in rows:
            assert score == pytest.approx(scores.get(key, score), abs=1e-12)
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_search_recall_with_many_lists_and_a_hot_one(spark):
    """Half of the vectors nearly alike, small bins and blocks: lists are spread, queries dealt."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 48))
    x[1500:] = x[0] + 0.01 * rng.standard_normal((1500, 48))
    ids = rng.permutation(3000)
    frame = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    s = Search(list_rows=100, bin_rows=64, block_queries=8, starters=300)
    found, expected = by_query(nearest_vectors(frame, F.col("vec_id") % 20 == 0, s=s)), brute(ids, x, 20)
    hits = sum(len(dict(expected[q]).keys() & dict(rows).keys()) for q, rows in found.items())
    assert set(found) == set(expected) and all(len(rows) == 5 for rows in found.values())
    assert hits >= 0.9 * 5 * len(expected)


def test_search_is_exact_if_all_is_probed_and_nothing_abandoned(spark):
    ids, x = vectors_of(FOLDER)
    frame = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    s = Search(list_rows=50, least_recall=1.0, test_queries=2048, slack=100.0, bin_rows=100)
    found = by_query(nearest_vectors(frame, F.col("vec_id") % 50 == 0, s=s))
    assert {q: [i for i, _ in rows] for q, rows in found.items()} == {
        q: [i for i, _ in rows] for q, rows in brute(ids, x).items()
    }


def test_scan_abandons_most_and_keeps_the_near():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    rows = [np.ascontiguousarray(x[:, a : a + 16]) for a in range(0, 64, 16)]
    asked, away = x[:20], ((x[:20, None, :] - x[None]) ** 2).sum(axis=2)
    bound = np.sort(away, axis=1)[:, 5]
    query, row, found = scan(asked, bound, rows, 64, Search())
    assert np.allclose(found, away[query, row], atol=1e-12)
    assert len(query) < 0.01 * away.size and len(query) >= 0.97 * 6 * 20
    # Directions without any structure are the hardest case: few go after a quarter of the columns.
    left = [len(scan(asked, bound, rows[:n], 64, Search())[0]) / away.size for n in (1, 2, 3)]
    assert left[0] < 0.95 and left[1] < 0.9 and left[2] < 0.25
    # With structure, nearly all that is far goes there.
    x[100:] = -x[100:] - 3 * x[0]
    x[:100] = x[0] + 0.05 * x[:100]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    away = ((x[:20, None, :] - x[None]) ** 2).sum(axis=2)
    first = scan(x[:20], np.sort(away, axis=1)[:, 5], [x[:, :16]], 64, Search())[0]
    assert len(first) <= 20 * 100


def test_search_on_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, 2.0]), (100, None), (150, []), (200, [0.0, 0.0]), (250, [nan, 1.0]),
        (300, [inf, 1.0]), (350, [1.0, None]), (None, [1.0, 1.0]), (7, [3.0, 0.0]), (3, [5.0, 0.0]), (3, [5.0, 0.0]),
        (9, [0.0, -1e200]), (11, [1e-200, 1e-200]), (400, [1.0, 2.0, 3.0]), (401, [1.0, 2.0, 3.0]), (450, [1.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("x") for c in ("vector", "asked", "list", "bin", "rank", "score", "query_id")}
    )
    found = by_query(nearest_vectors(frame, F.col("vec_id") % 50 == 0))
    assert set(found) == {0, 50, 400}  # 450 has no other vector of its length
    assert [i for i, _ in found[0]] == [3, 3, 7, 11, 9] and [s for _, s in found[0]][:3] == [1.0, 1.0, 1.0]
    assert found[0][3][1] == pytest.approx(math.sqrt(0.5)) and found[0][4][1] == 0.0
    assert found[400] == [(401, pytest.approx(1.0))]
    assert [i for i, _ in found[50]] == [11, 0, 3, 3, 7]
    assert nearest_vectors(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest_vectors(frame.where("vec_id in (0, 100)"), F.col("vec_id") % 50 == 0).count() == 0
    assert not any(r[0] for r in frame.where("vec_id in (100, 150, 200, 250, 300, 350)").select(usable(F.col("embedding"))).collect())


LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, 1, None), (9, None, 1), (None, 1, 1), (77, 1, 1)]


def in_sql(spark, docs, name, labels=None):
    """The query's SQL on the rows of a frame."""
    with duckdb.connect() as connection:
        connection.execute("create table documents(doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
        connection.execute("create table labels(doc_id bigint, quality int, toxic int)")
        rows = [list(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        if rows:
            connection.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
        for row in labels or []:
            connection.execute("insert into labels values (?, ?, ?)", row)
        result = connection.execute(oracle.SQL[name])
        columns = [d[0] for d in result.description]
        return columns, Counter(result.fetchall())


def rows_of(frame, columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("rows", ["odd", "none", "clashing"])
def test_filter_audit_on_odd_rows(rows, request, spark):
    docs = request.getfixturevalue(rows)
    docs = docs.withColumns({c: F.lit("x") for c in ("part", "mask", "h", "h2", "first", "block", "counters")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    columns, expected = in_sql(spark, docs, "op12_filter_audit", LABELS)
    assert rows_of(fa.filter_audit(docs, labels), columns) == expected
    parts = {r.lang or "" for r in docs.collect()}
    assert sum(expected.values()) == 600 * len(parts)


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_source_audit"])
def test_audits_in_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    with duckdb.connect() as connection:
        for table in ("documents", "labels"):
            connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
        result = connection.execute(oracle.SQL[name])
        columns = [d[0] for d in result.description]
        assert rows_of(frame, columns) == Counter(result.fetchall())


def test_masks_one_by_one(spark):
    plain = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, plain), (2, plain), (3, plain + "\xa0x"), (4, "#" + plain), (5, "a " * 200), (6, "AB " * 40),
        (7, "é漢 " * 99), (8, ""), (9, None), (None, plain), (1, plain),
    ]
    frame = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")
    found = Counter((r.doc_id, r.mask) for r in fa.failures(frame).collect())
    assert found == Counter({
        (1, 0): 2, (2, 16): 1, (3, 0): 1, (4, 8): 1, (5, 2): 1, (6, 7): 1, (7, 3): 1, (8, 1): 1, (9, 17): 1, (None, 0): 1,
    })


@pytest.mark.parametrize("limits", [fa.Limits(rows_per_block=1000), fa.Limits(most_blocks=1)])
def test_a_crowded_sketch_changes_nothing(odd, limits):
    assert rows_of(fa.failures(odd, limits), ["doc_id", "part", "mask"]) == rows_of(fa.failures(odd), ["doc_id", "part", "mask"])


def test_texts_of_equal_digests_are_told_apart(odd, monkeypatch):
    expected = rows_of(fa.failures(odd), ["doc_id", "part", "mask"])
    monkeypatch.setattr(fa, "digest", lambda text: [F.length(text).cast("long") * 0, F.lit(0).cast("long")])
    assert rows_of(fa.failures(odd), ["doc_id", "part", "mask"]) == expected


def test_unique_texts_are_cleared(spark):
    """Nearly all texts that occur once are left out of what is compared in full."""
    docs = spark.range(20_000).selectExpr("concat('text ', id) as text")
    hashes = docs.select(F.xxhash64("text").alias("h"))
    blocks = 20_000 // fa.Limits().rows_per_block
    used = fa.sketch(hashes, blocks)
    looked_up = hashes.withColumn("block", F.pmod("h", F.lit(blocks))).join(used, "block")
    left = looked_up.where(fa._may_repeat(F.col("counters"), F.col("h"))).count()
    assert left < 0.06 * 20_000
    twice = hashes.limit(100).unionByName(hashes)
    used = fa.sketch(stored(twice), blocks)
    again = hashes.limit(100).withColumn("block", F.pmod("h", F.lit(blocks))).join(used, "block")
    assert again.where(fa._may_repeat(F.col("counters"), F.col("h"))).count() == 100


@pytest.mark.parametrize("rows", ["odd", "none", "clashing"])
def test_source_audit_on_odd_rows(rows, request, spark):
    docs = request.getfixturevalue(rows)
    docs = docs.withColumns({c: F.lit("x") for c in ("term", "item", "value", "rank", "p", "q", "total")})
    docs = docs.unionByName(docs).unionByName(docs).unionByName(docs)  # so that some terms are kept
    columns, expected = in_sql(spark, docs, "op13_source_audit")
    assert rows_of(sa.source_audit(docs), columns) == expected
    assert (rows == "none") == (not expected)


def test_source_audit_in_small_blocks(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    few = docs.where("source in ('src0', 'src1', 'src2', 'src3')")
    columns, expected = in_sql(spark, few, "op13_source_audit")
    small = dataclasses.replace(sa.Audit(), rows_per_block=37, cells_at_once=16)
    assert rows_of(sa.source_audit(few, small), columns) == expected


def test_shares_beyond_64_bits(spark):
    n, total, kept = 3 * 10**12, 7 * 10**13, 10**8
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(
        sa.share(F.col("n"), F.col("total"), F.col("kept"))
    ).first()
    assert row[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_terms(spark):
    from wrenchwork.llm.words import text_buffers
    import pyarrow as pa
    import re

    texts = ["Ab-cD1eÉ ÀÉ\x7fx", None, "", "0 9", "漢字Z", "x" * 9, LONG[:500], PROSE, "\U0001f600a"]
    rows, terms = sa.terms_of(*text_buffers(pa.array(texts)))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expected = [
        (i, t.translate(lower)) for i, text in enumerate(texts)
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    ]
    assert list(zip(rows.tolist(), terms.to_pylist(), strict=True)) == expected


def test_counts_are_merged_within_a_task(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text", "lang", "source")
    whole = rows_of(sa.term_counts(docs), ["lang", "source", "term", "n", "docs"])
    batches = docs.na.fill("").limit(300).toArrow()
    monkeypatch.setattr(sa, "MERGE_ROWS", 2000)
    monkeypatch.setattr(sa, "CHUNK_BYTES", 5000)
    found = Counter()
    for batch in sa._count_batches(iter(batches.to_batches(50))):
        for row in batch.to_pylist():
            found[(row["lang"], row["source"], row["term"], "n")] += row["n"]
            found[(row["lang"], row["source"], row["term"], "docs")] += row["docs"]
    part = spark.createDataFrame(batches.to_pandas())
    for row in rows_of(sa.term_counts(part), ["lang", "source", "term", "n", "docs"]):
        assert (found[(*row[:3], "n")], found[(*row[:3], "docs")]) == row[3:]
    assert len(whole) > 0
