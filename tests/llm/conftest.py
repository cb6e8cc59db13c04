import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from odd import ODD  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, rep long, n_tokens string, kind string, mark binary, keys string, node string, sketch string, predicted string, verdict string, pre string, __gone long, __chosen long, __rank int, h long, items string, p int, chunk string"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text[, lang[, source]]), with columns whose names clash with the operators' own."""

    def make(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, None, None)[:4]
            full.append((doc_id, text, lang, source, len(text) if text is not None else None, "x", 7, "y", "z", b"m", "k", "o", "s", "q", "v", "p", doc_id, doc_id, 1, 5, "i", 2, "c"))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD)
