"""Small document tables with nulls, ties, repeats, empty and long texts and clashing extra columns."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, words string"


@pytest.fixture(scope="session")
def make(spark):
    def docs(*rows):
        """Rows of (doc_id, text); the other columns clash with names used inside the operators."""
        return spark.createDataFrame([(i, t, "en", None, len(t or ""), 1, "k", "w") for i, t in rows], DOCS)
    return docs


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
