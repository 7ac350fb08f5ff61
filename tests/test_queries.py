import importlib.util

import pytest
from oracle import check

from gristmill.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, data):
    check(QUERIES[name], SQL[name], spark, data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_module_names_all_core_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    import os
    import re

    top = os.path.dirname(importlib.util.find_spec("gristmill").origin)
    for folder, _, files in os.walk(top):
        if "llm" in os.path.relpath(folder, top).split(os.sep):
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as h:
                    assert not re.search(r"import.*\bllm\b|from .*\bllm\b", h.read()), f


def test_flagship(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["a", "b", "similarity"]
