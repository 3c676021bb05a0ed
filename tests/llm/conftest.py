import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from slantspark.session import local_session
    s = local_session("*", shuffle_partitions=8, app="slantspark-llm-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from {id: text}, or from a list of (id, text)."""
    def make(texts):
        rows = list(texts.items()) if isinstance(texts, dict) else texts
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return make
