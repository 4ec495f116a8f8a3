"""Odd rows: nulls in any column, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from conftest_llm import LONG, PROSE
from wrenchwork.llm import language_id, quality_model
from wrenchwork.llm.bag_minhash import near_duplicates, one_of_each
from wrenchwork.llm.decontaminate import overlaps, without_benchmark
from wrenchwork.llm.html_extract import with_main_text
from wrenchwork.llm.license_scan import license_notices
from wrenchwork.llm.quality_rules import quality_rules
from wrenchwork.llm.source_mix import mixed, with_copies
from wrenchwork.llm.substring_dedup import repeated_words, without_repeats
from wrenchwork.llm.token_counts import count_tokens


def test_quality_rules(odd):
    rows = quality_rules(odd).collect()
    by_id = {r.doc_id: r.quality for r in rows if r.doc_id not in (None, 10)}
    assert len(rows) == odd.count()
    assert by_id[1].kept and by_id[1].clean_text == PROSE and by_id[2] == by_id[1]
    for empty in (3, 4, 5):
        assert by_id[empty].n_words == 0 and by_id[empty].base_failed and not by_id[empty].kept
    assert by_id[3].clean_text is None and by_id[4].clean_text == ""
    assert by_id[7].n_words == 60_000 and by_id[7].word_chars == len(LONG.replace(" ", ""))
    assert by_id[9].n_repeat_words == 28 and by_id[9].base_failed
    menu = next(r.quality for r in rows if r.doc_id == 10 and "menu" in r.text)
    assert menu.lost_words == 140 and not menu.kept and menu.clean_text == "" and menu.n_dup_lines == 19


@pytest.mark.parametrize("mark", "। ॥ ۔ ؟ ። ፧ ။ ។ ། ！ ？ ：".split())
def test_sentences_of_other_scripts_are_closed(mark, spark):
    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(34)) + mark for i in range(4))
    rows = quality_rules(spark.createDataFrame([(1, text), (2, text.replace(mark, ""))], "doc_id bigint, text string"))
    found = {r.doc_id: r.quality for r in rows.collect()}
    assert found[1].kept and found[1].lost_words == 0 and found[1].clean_text == text
    assert not found[2].kept and found[2].lost_words == 136


def test_near_duplicates(odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    classes = Counter((r.doc_id, r.class_id) for r in rows)
    assert classes[(1, 1)] == 1 and classes[(2, 1)] == 2 and classes[(None, 1)] == 1
    for alone in (3, 4, 5, 6, 7, 8, 9):
        assert classes[(alone, alone)] == 1
    assert classes[(10, 10)] == 2 and classes[(None, None)] == 1


def test_one_of_each(odd):
    kept = Counter(r.doc_id for r in one_of_each(odd).collect())
    assert kept == Counter({1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 2, None: 1})


def test_substring_dedup(odd):
    rows = {(r.doc_id, r.text): r for r in repeated_words(odd).collect()}
    assert rows[(1, PROSE)].n_removed == 0 and rows[(1, PROSE)].kept_text == PROSE
    assert rows[(2, PROSE)].n_removed == rows[(2, PROSE)].n_words and rows[(2, PROSE)].kept_text == ""
    assert rows[(None, PROSE + " tail")].n_removed == 0  # no id: neither source nor target
    assert rows[(3, None)].n_words == 0 and rows[(3, None)].kept_text == ""
    assert rows[(7, LONG)].n_words == 60_000 and rows[(7, LONG)].n_removed == 0
    assert all(r.n_removed == 0 for (i, _), r in rows.items() if i == 10)
    left = Counter(r.doc_id for r in without_repeats(odd).collect())
    assert left[2] == 0 and left[None] == 2 and left[10] == 2


def test_decontamination(odd, none, spark):
    items = spark.createDataFrame(
        [(1, PROSE[:200]), (2, None), (3, ""), (None, "short one"), (1, PROSE[:200])], "item_id bigint, text string"
    )
    found = overlaps(odd, items).collect()
    assert Counter(r.doc_id for r in found) == Counter({1: 2, 2: 4, None: 2})
    assert Counter(r.doc_id for r in without_benchmark(odd, items).collect())[1] == 0
    assert overlaps(odd, none.selectExpr("doc_id as item_id", "text")).count() == 0
    assert without_benchmark(odd, none.selectExpr("doc_id as item_id", "text")).count() == odd.count()


def test_source_mix(odd):
    rows = mixed(odd).collect()
    assert sum(r.times for r in rows) == odd.count()
    sources = {r.source: r for r in rows}
    assert set(sources) == {"a", "b", "c", "ü", None}
    for r in rows:
        assert 0 <= r.copies <= 3 and r.target <= 3 * r.source_size
    assert sources["b"].source_size == 1  # "one" and white space
    taken = Counter()
    for r in rows:
        taken[r.source] += r.size * r.times * r.copies
    assert all(r.copies > 0 for r in with_copies(odd).collect())


def test_language(odd):
    network = language_id.fitted(odd)
    rows = language_id.with_language(odd, network).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r.lang_score <= 1
        lettered = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not lettered)
    unlearned = language_id.with_language(odd, language_id.fitted(odd.where("false")))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}


def test_quality_model(odd, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (9, 0), (10, None), (None, 1), (77, 0)], "doc_id bigint, quality int")
    rows = quality_model.with_quality(odd, quality_model.fitted(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.quality_score <= 1 for r in rows)
    no_labels = quality_model.with_quality(odd, quality_model.fitted(odd, labels.where("false")))
    assert {r.quality_score for r in no_labels.collect()} == {0.5}


def test_pages(spark):
    pages = [(1, None, None), (2, "u", ""), (3, "u", "<p>a &lt; b<p>" + LONG), (3, "u", "no tags"), (None, None, "<script>x</script>")]
    rows = with_main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert [r.main_text for r in rows] == ["", "", "a < b\n" + LONG, "no tags", ""]


def test_token_counts_and_licenses(odd, spark, tmp_path):
    odd.write.parquet(str(tmp_path / "odd"))
    rows = count_tokens(spark.read.parquet(str(tmp_path / "odd"))).collect()
    assert len(rows) == odd.count()
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert license_notices(odd).count() == 0


@pytest.mark.parametrize("rows", ["none", "clashing"])
def test_frames_that_are_empty_or_have_more_columns(rows, request, spark, tmp_path):
    docs = request.getfixturevalue(rows)
    n, items = docs.count(), docs.selectExpr("doc_id as item_id", "text").limit(0)
    labels = spark.createDataFrame([(1, 1), (9, 0)], "doc_id bigint, quality int")
    for frame in (
        quality_rules(docs),
        repeated_words(docs),
        without_benchmark(docs, items),
        language_id.with_language(docs, language_id.fitted(docs)),
        quality_model.with_quality(docs, quality_model.fitted(docs, labels)),
    ):
        assert frame.columns[: len(docs.columns)] == docs.columns and frame.count() == n
        assert len({c.lower() for c in frame.columns}) == len(frame.columns)
    assert near_duplicates(docs).count() == n
    assert one_of_each(docs).columns == docs.columns
    assert without_repeats(docs).columns == docs.columns
    assert sum(r.times for r in mixed(docs).collect()) == n
    assert with_copies(docs).columns[:-1] == docs.columns
    docs.write.parquet(str(tmp_path / "docs"))
    assert count_tokens(spark.read.parquet(str(tmp_path / "docs"))).count() == n
    assert license_notices(docs).count() == 0


@pytest.mark.parametrize("rows", ["odd", "none", "clashing"])
def test_stages(rows, request, spark):
    docs = request.getfixturevalue(rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        docs = spark.createDataFrame(out.collect(), out.schema)
        if name != "source_mix":
            assert docs.columns == columns
    assert docs.columns[: len(columns)] == columns


MALFORMED = [
    "<![foo[ x ]]><p>hello</p>", "<![CDATA[ x ]]><p>hello</p>", "<![if !IE]><p>hello</p><![endif]>", "<![foo[ x <p>hello</p>",
    "<!doctype html [<!ENTITY a 'b'>]><p>hello</p>", "<!><p>hello</p>", "<!-- open <p>hello</p>", "<?php echo 1 ?><p>hello</p>",
    "<p>hello</p><![", "<p>hello</p></", "<p>hello</p><a href='", "<p class=\"a>hello</p>", "</nothing><p>hello</p>", "<p>hello &#xFFFFFFF; &#0; &bad;</p>",
    "<!ELEMENT br EMPTY><p>hello</p>", "<p>hello<p", "<\x00p>hello", "<![rcdata[<p>hello</p>]]>",
]


def test_malformed_pages(spark):
    """None ends the job, and what is plainly text is found."""
    frame = spark.createDataFrame([(k, "u", h, "x") for k, h in enumerate(MALFORMED)], "page_id int, url string, html string, main_text string")
    rows = {r.page_id: r for r in with_main_text(frame).collect()}
    assert len(rows) == len(MALFORMED) and all(r["_main_text"] is not None and r["main_text"] == "x" for r in rows.values())
    for k in (0, 1, 2, 5, 7, 8, 9, 12, 14):
        assert "hello" in rows[k]["_main_text"], MALFORMED[k]
    assert with_main_text(frame.limit(0)).count() == 0
