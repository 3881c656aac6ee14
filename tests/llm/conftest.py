from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"

#: Texts at the edges of every operator's input.
ODD = [None, "", " ", "!!! ...", "a", "Ünï çödé 😀 中文", "x" * 5_000, "word " * 3_000, "a\x00b\n\n\tc  d", "▁odd▁ marks", "same text twice here", "same text twice here"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with null, repeated and plain ids, and columns whose names clash with the operators' own."""
    ids = [None if i == 3 else 7 if i in (10, 11) else i for i in range(len(ODD))]
    rows = [(i, t, None if n % 3 else "en", "src", "r", "h", 1) for n, (i, t) in enumerate(zip(ids, ODD))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_id string, host string, n_words int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
