from __future__ import annotations

import pytest

# Texts that operators have to bear: none, nothing, white space, odd separators, long, alike.
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
PROSE = " ".join(f"a{i} b{i} c{i} d{i} e{i} f{i}." for i in range(40))
ODD = [
    (1, PROSE, "en", "a", 1),
    (2, PROSE, "en", "a", 1),  # a copy
    (2, PROSE, "en", "a", 1),  # a repeated row
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n\x0b\f\r ", "de", "b", 7),
    (6, "one", "fr", "b", 3),
    (7, LONG, "en", None, len(LONG)),
    (8, "é ü ñ 漢字 \U0001f600 " * 30, "es", "ü", 1),
    (None, PROSE + " tail", "en", "a", 1),
    (None, None, None, None, None),
    (9, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "en", "c", 1),
    (10, "the | menu | of | it\n" * 20, "en", "c", 1),
    (10, "another text of the same id " * 12, "en", "c", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with more columns, under the names that operators give theirs."""
    names = (
        "quality words lines counts Quality_Score copies fingerprint node marks n_words n_removed "
        "kept_text lang_pred lang_score has_letter key bad signature label class_id print"
    ).split()
    return odd.selectExpr("*", *[f"'x' as {n}" for n in names])
