"""The pipeline against the same stages in plain loops."""

from __future__ import annotations

import duckdb

import __spark_entry__ as driver
import corpus_pipeline
from test_brute import FOLDER, brute_classes, brute_removed, given
from wrenchwork.llm import oracle
from wrenchwork.llm.frames import stored


def test_registered(spark):
    assert "pipeline" in driver.queries() and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules"
    for n in range(1, 11):
        assert any(name.startswith(f"op{n}_") for name in driver.queries())


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    after = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
        after.append({r.doc_id: r.asDict() for r in docs.collect()})
    rules, near, passages, clean, mix = after
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    kept = connection.execute(f"select doc_id from ({oracle.SQL['op1_quality_rules']}) where kept").fetchall()
    assert set(rules) == {k for (k,) in kept}
    classes = brute_classes([(k, r["text"]) for k, r in rules.items()])
    assert set(near) == set(classes.values()) and all(near[k] == rules[k] for k in near)
    removed = brute_removed([(k, r["text"]) for k, r in near.items()])
    for key, (n, gone, text) in removed.items():
        if gone == n and n:
            assert key not in passages
        else:
            expected = text if gone else near[key]["text"]
            assert passages[key]["text"] == expected and passages[key]["n_chars"] == len(expected)
    items = [t for _, t in given("benchmark")]
    assert set(clean) < set(passages)
    for key in set(passages) - set(clean):
        assert any(len(set(t.lower().split()) & set(passages[key]["text"].lower().split())) > 6 for t in items)
    assert all(clean[k] == passages[k] for k in clean)
    assert set(mix) <= set(clean) and all(1 <= r["copies"] <= 3 for r in mix.values())
    assert all(list(r)[: len(columns)] == columns for r in mix.values())
