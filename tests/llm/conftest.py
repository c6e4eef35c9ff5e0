import pytest

COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS)

    return make


@pytest.fixture(scope="session")
def sf(spark, docs, tmp_path_factory):
    """A folder with a documents table, and others given by name."""

    def make(rows, **tables):
        path = str(tmp_path_factory.mktemp("sf"))
        docs(rows).write.parquet(f"{path}/documents.parquet")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return path

    return make


ODD = [
    (0, None), (1, ""), (2, " \t\n "), (3, "a"), (4, "one two three"), (5, "one two three"), (None, "no id here"),
    (6, "é ü 漢字 😀 　x y"), (7, "x " * 5000), (8, "y" * 30000), (9, "line\n" * 300), (3, "a"),
    (10, "<|endoftext|> a<|endoftext|>"), (11, "a\x00b c \x1c\x85d"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
