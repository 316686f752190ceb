import pytest

#: Null, empty, blank, repeated, special, long.
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "One two three don't"), (4, "One two three don't"), (5, "x<|endoftext|>y </s>[INST] ok [/INST]"), (6, "Ünïcode été 한글 🙂 \x1c sep"), (7, "long words here and there " * 4000), (None, "no id")]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with hard cases, and columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", 0, "k", 1, "c") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, node long, copy string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def tokenizer():
    from loomgraph.llm.vocab import default_path, load_tokenizer

    return load_tokenizer(default_path())
