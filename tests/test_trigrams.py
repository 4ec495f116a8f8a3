"""Search by postings against the scan, and what it reads."""

from __future__ import annotations

import random
import re

import pytest

from wrenchwork import operators as op
from wrenchwork.plans.tables import Tables
from wrenchwork.sources.postings import search_stored, write_postings

SIGNS = "aAbB01-%_ É"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    some = lambda: rng.choice([None, "", "".join(rng.choices(SIGNS, k=rng.randrange(1, 12)))])
    rows = [(k, some(), some()) for k in range(400)] + [(1000, "ΟΔΟΣ İst", None), (1001, "漢字かな😀交じり", "ab")]
    return spark.createDataFrame(rows, "id int, one string, two string").cache()


QUERIES = ["", "a", "ab", "aB0", "b01-", "%_", "%_a", "é b", "ΟΔΟΣ", "İst", "字かな😀", "zzz", "a" * 30, "   ", "aaa"]


def same(left, right):
    return sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_as_the_scan(texts, tmp_path):
    path = str(tmp_path / "index")
    write_postings(texts, path, "id", "one", "two", buckets=8)
    postings = op.trigram_postings(texts, "id", "one", "two")
    rng = random.Random(5)
    rows = [t for r in texts.collect() for t in (r.one, r.two) if t and len(t) > 3]
    cut = lambda t, a: t[a : a + rng.randrange(2, 8)].swapcase()
    random_queries = [cut(t, rng.randrange(len(t) - 2)) for t in rng.sample(rows, 10)]
    for query in QUERIES + random_queries:
        expected = op.search(texts, query, "one", "two")
        assert same(op.search_postings(texts, postings, "id", query, "one", "two"), expected), query
        for rarest in (1, 3):
            assert same(search_stored(texts, path, "id", query, "one", "two", rarest=rarest), expected), query


def test_postings(spark):
    rows = spark.createDataFrame([(1, "abcabc", "bca"), (2, None, "ab"), (None, "abc", "")], "id int, a string, b string")
    found = op.trigram_postings(rows, "id", "a", "b").collect()
    assert sorted((r.trigram, r.key) for r in found) == [("abc", 1), ("bca", 1), ("cab", 1)]
    assert op.query_trigrams(spark, "ABCABC") == ["abc", "bca", "cab"] and op.query_trigrams(spark, "ab") == []


def test_only_the_rarest_postings_are_read(spark, tmp_path):
    claims = Tables(spark, "/root/testdata/sf0.01").claims()
    path = str(tmp_path / "index")
    write_postings(claims, path, "no", "no", "vehicle")
    stored = spark.read.parquet(f"{path}/postings")
    query = "0000012345"
    found = search_stored(claims, path, "no", query, "no", "vehicle")
    assert same(found, op.search_claims(claims, query)) and not found.isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "postings" in line)
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=)", scan)
    grams = set(re.search(r"In\(trigram, \[(.*?)\]\)", scan)[1].split(","))
    counts = dict(spark.read.parquet(f"{path}/counts").select("trigram", "n").collect())
    rarest = sorted(op.query_trigrams(spark, query), key=lambda g: (counts[g], g))[:2]
    assert grams == set(rarest)
    assert sum(counts[g] for g in rarest) < 0.05 * stored.count()


def test_a_missing_trigram_ends_the_search(texts, tmp_path):
    path = str(tmp_path / "index")
    write_postings(texts, path, "id", "one")
    assert search_stored(texts, path, "id", "no such text", "one").isEmpty()
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        write_postings(texts, path, "id", "one")
