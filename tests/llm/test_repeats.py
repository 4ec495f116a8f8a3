"""What repeated passages put on disk: copies are not sent, segments go in passes, shuffles go after use."""

import random
from pathlib import Path

import pytest

from test_brute import brute_removed
from wrenchwork.llm import substring_dedup as module
from wrenchwork.llm.substring_dedup import Windows, repeated_words

SCHEMA = "doc_id bigint, text string"


def copies(seed, near=0.0, documents=40, times=5):
    """Texts of few words, so that anchors meet by chance; copies of each, some words of which differ."""
    rng = random.Random(seed)
    some = [" ".join(f"w{min(int(rng.expovariate(0.4)), 60)}" for _ in range(rng.randrange(5, 120))) for _ in range(documents)]
    rows = [
        (100 * k + i, " ".join("other" if rng.random() < near else w for w in text.split()))
        for k in range(times)
        for i, text in enumerate(some)
    ]
    rng.shuffle(rows)
    # Rows of one id, the same and others; a line that is only repeated inside itself.
    return [*rows, rows[3], (rows[3][0], rows[7][1]), (9_000, "a b c " * 60), (9_001, "")]


def distinct(rows):
    """One row of each id, as plain loops want them."""
    return list(dict(rows).items())


def sent(spark, rows, tasks):
    docs = module._keyed(spark.createDataFrame(rows, SCHEMA).repartition(tasks))
    found = module._candidates(docs, Windows(), 8)[0]
    return sum(len(blob) for row in found.collect() for blob in row[2])


@pytest.mark.parametrize("tasks", [1, 6])
def test_words_of_whole_copies_are_not_sent(spark, tasks):
    rng = random.Random(tasks)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 90))) for _ in range(50)]
    rows = [(100 * k + i, text) for k in range(5) for i, text in enumerate(texts)]
    assert sent(spark, rows, tasks) == 0
    got = repeated_words(spark.createDataFrame(rows, SCHEMA).repartition(tasks)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_removed(rows)
    assert sum(r.n_removed for r in got) == 4 * sum(len(t.split()) for t in texts)


@pytest.mark.parametrize("near, share", [(0.0, 0.1), (0.05, 0.6)])
@pytest.mark.parametrize("asked", [1, 32])
def test_passes_and_gathers_change_nothing(spark, monkeypatch, near, share, asked):
    turns, run = [], module._repeats
    monkeypatch.setattr(module, "_repeats", lambda *a: turns.append(a[4:]) or run(*a))
    monkeypatch.setattr(module, "PASS_SHARE", share, raising=False)
    monkeypatch.setattr(module, "ASKED", asked, raising=False)
    monkeypatch.setattr(module, "GATHERED", 300)
    rows = distinct(copies(asked, near))
    got = repeated_words(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_removed(rows)
    assert len(turns) > 1 and turns == [(t, len(turns)) for t in range(len(turns))]


def test_rows_of_one_id_take_nothing_from_each_other(spark):
    rows = copies(5)
    got = repeated_words(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    smallest = min(r[0] for r in rows)
    assert all(r.n_removed == 0 for r in got if r.doc_id == smallest)
    alone = (77, " ".join(f"v{i}" for i in range(40)))
    got = repeated_words(spark.createDataFrame([alone, alone, (78, alone[1]), (78, alone[1])], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(77, 0), (77, 0), (78, 40), (78, 40)]


def test_what_is_shuffled_goes_when_it_is_written(spark, monkeypatch):
    folder = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    seen = []

    def shuffled():
        return sum(p.stat().st_size for p in folder.rglob("shuffle_*.data"))

    monkeypatch.setattr(module, "passed", lambda f, run=module.passed: (lambda x: (seen.append(shuffled()), x)[1])(run(f)))
    before = shuffled()
    repeated_words(spark.createDataFrame(copies(1, 0.05), SCHEMA).repartition(4)).count()
    assert len(seen) >= 2 and max(seen) < before + 2_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
