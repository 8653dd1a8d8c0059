from __future__ import annotations

import os

import pyarrow.dataset as ds
import pytest

SF = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(table: str) -> dict:
    return ds.dataset(f"{SF}/{table}.parquet").to_table().to_pydict()


@pytest.fixture(scope="session")
def sf() -> str:
    if not os.path.exists(SF):
        pytest.skip("test data not present")
    return SF


@pytest.fixture
def documents(spark):
    def make(texts, ids=None, lang="en", source="s", extra: bool = False):
        """Documents of the texts; with ``extra``, columns whose names the operators use themselves."""
        ids = range(len(texts)) if ids is None else ids
        kind = DOCUMENT + (", fp long, component_id long, row string, node long, score double, size long, _size long, n_words long" if extra else "")
        tail = (7, 7, "r", 7, 0.5, 7, 7, 7) if extra else ()
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), *tail) for i, t in zip(ids, texts)], kind)

    return make


ODD = [None, "", "   \n\t ", "a", "A b", "the same text here", "the same text here", "é ß ñ !!! 123", "word " * 30_000, "\x00\x01 x"]
