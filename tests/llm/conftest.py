import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A builder of documents tables with a clashing extra column."""

    def build(texts, ids=None, sources=None):
        rows = [(i, t, "en", s, "clash") for i, t, s in zip(ids or range(len(texts)), texts, sources or ["a"] * len(texts))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")

    return build


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, unicode, control, long and repeated texts."""
    return [None, "", "   ", "\n\t", "a", "Hello, World! it's 42 <|startoftext|> x\x01y", "été ÉTÉ ﬁ İ ǰ J̌ naïve ▁ ▁▁ x", "日本語 \U0001f600 ok", "same text here", "same text here", "z" * 20_000, "word " * 3_000, "\x00 nul \x00", "é" * 63 + "a", "tail.  two   spaces \n\n new"]
