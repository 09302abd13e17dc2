from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (id, text) or (id, text, source), with columns whose names could clash."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "1 as size", "'x' as id", "2 as rank", "'y' as norm", "3 as `row`", "4 as body", "5 as score_2") if extra else df

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Nulls, empty and blank texts, ties, repeated rows and a long text.
ODD = [
    (1, "the cat sat on the mat"), (2, "THE cat sat on the mat"), (2, "THE cat sat on the mat"), (3, None), (4, ""), (5, "  \n\t "), (None, "the cat sat on the mat"),
    (None, None), (6, "word " * 50_000), (7, "a\nb\nc\nd\ne\nf\ng\nh"), (8, "a\nb\nc\nd\ne\nf\ng\nh"), (9, "Émile à la plage"), (10, "x"),
]


@pytest.fixture
def odd():
    return list(ODD)
