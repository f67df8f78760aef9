from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, rank long, row string, size long, fp long, key string, bucket int, slot int, score double, lang_pred string, copies int, label int"
LONG = "straße année último the and " * 6000
TEXTS = [
    (7, "The quick brown fox jumps over the lazy dog and runs away", "en", "b"),
    (3, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (1, None, "en", None),
    (2, "", None, "a"),
    (9, " \t\n", "de", "a"),
    (4, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b"),
    (4, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b"),
    (None, "sans numéro, mais avec un texte français assez long", "fr", "c"),
    (11, "12345 !!! <|endoftext|> Σίσυφος 日本語 don't", None, "c"),
    (10, LONG, "en", "a"),
    (6, "a", "en", ""),
    (5, "word " * 40 + "end", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and extra columns whose names clash."""
    rows = [(i, t, lang, source, len(t or ""), 0, 0, "x", 5, 1, "k", 2, 3, 0.5, "zz", 9, 1) for i, t, lang, source in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
