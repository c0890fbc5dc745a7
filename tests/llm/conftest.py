"""Small tables with the odd cases every operator must stand."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part long, fp long, n long, at long, base long, total long"

ODD_TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog and runs away."),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "The quick brown fox jumps over the lazy dog and runs away."),
    (5, "a  b c d <|endoftext|> e's DON'T \x1c x\n\n\ny"),
    (6, "Éa ÀÉ ünïcödé ß İstanbul Σας ＡＢ 漢字 🙂"),
    (7, "word " * 5000),
    (8, "one"),
    (8, "one"),
    (9, "\nleading and trailing \n"),
    (None, "a row without an id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if i == 2 else "en", None if i == 3 else "s", None, 1, 2, 3, 4, 5, 6) for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
