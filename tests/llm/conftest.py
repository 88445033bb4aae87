import pytest
from odd_rows import ODD

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int, size long, h string, found string, node long"


def clash(rows):
    """Rows of documents with extra columns whose names the operators use themselves."""
    return [(i, t, lang, src, len(t or ""), True, 7, 7, "x", "y", 1) for i, t, lang, src in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(clash(ODD), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(folder):
    import pandas as pd

    return pd.read_parquet(f"{folder}/documents.parquet")
