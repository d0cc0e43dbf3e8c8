import os
import sys

import pytest

from lumenframe.plans import catalog

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_image_queries_do_without_the_text_operators(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # its import fails, whatever the reason
    with pytest.warns(UserWarning, match="no text operators"):
        assert set(__spark_entry__.queries()) == set(catalog.QUERIES)
    with pytest.warns(UserWarning):
        assert __spark_entry__.oracle_sql() == catalog.ORACLE_SQL


def test_flagship_query(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["image_id", "y", "x", "v"] and found.count() == 32 * 32
