import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: nulls, empty and blank texts, repeats, ties, non-ASCII, one long text and one long word
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "the cat sat on the mat"), (5, "the  cat sat on the mat"), (6, "the cat sat on the mat"),
    (7, "Ünïcödé wörds — 日本語 テキスト 😀 é"), (8, "x" * 5000), (9, "lorem ipsum dolor sit amet " * 800), (10, "one"), (10, "one"),
    (11, "a<|endoftext|>b  c\n\nd e"), (12, "3.14 'tis they'll\tgo\r\n"), (None, "a row without an id"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Difficult rows, with extra columns whose names clash with those of results."""
    rows = [(i, t, None if k % 3 == 0 else "en", None, len(t or ""), True, 1.0, "x") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS + ", kept boolean, score double, digest string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder of empty tables."""
    path = tmp_path_factory.mktemp("empty")
    for name, schema in {
        "documents": DOCS, "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string",
        "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "conversations": "conv_id long, turn long, role string, text string",
    }.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)
