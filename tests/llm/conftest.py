import pytest

SMALL = "/root/testdata/sf0.001"

TEXTS = [
    None,
    "",
    " \n\t\n ",
    "a",
    "one line only",
    "x y\nx y\n\nx y \nx y",
    "\nstarts and ends\n",
    "é ü ß 漢字 \U0001f600 mixed\x0bvertical\x0cform\r\nreturn",
    "nbsp stays inside\x1cwords\x85too",
    "the cat sat on the mat and ran off " * 3,
    "A B C D E F G H",
    "word " * 30,
    "### $$$ *** %%% &&& || << >>",
    "It's don't we'll 'tis o'clock ''s 12,345.67 e.g.... a…b “quoted” cómbine",
    "tail <|endoftext|> and <|startoftext|> inside",
    "long " + "abc def ghi. " * 9000,
]


def doc_rows(texts=TEXTS):
    return [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", -1 if t is None else len(t)) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null, empty, odd and very long texts; null columns; and one repeated row."""
    rows = doc_rows()
    return spark.createDataFrame(rows + [rows[9]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
