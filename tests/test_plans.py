import os

import pytest

from gristmill.plans.queries import QUERIES
from gristmill.session import clean_shared, delete_materialized, materialize, shared_dir, temporary


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops(name, spark, data):
    got = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in got and "NestedLoop" not in got


@pytest.mark.parametrize("name, unread", [("p4_found", "name"), ("kv_snapshot", "logged_at"), ("p2_found", "feed"), ("dict_keep_first", "text"), ("p5_found", "claim,")])
def test_only_needed_columns_are_read(name, unread, spark, data):
    got = plan(QUERIES[name](spark, data))
    schemas = [x.split(">")[0] for x in got.split("ReadSchema: struct<")[1:]]
    assert schemas and all(f"{unread.rstrip(',')}:" not in s for s in schemas)


def test_materialized_tables(spark):
    df = materialize(spark.range(10), "t")
    other = materialize(spark.range(3), "u")
    folders = [f.rsplit("/", 1)[0].removeprefix("file://") for d in (df, other) for f in d.inputFiles()[:1]]
    assert df.count() == 10 and all(map(os.path.isdir, folders)) and all(f.startswith(shared_dir(spark).removeprefix("file://")) for f in folders)
    delete_materialized(df)
    assert [os.path.isdir(f) for f in folders] == [False, True]
    clean_shared(spark)
    assert not os.path.isdir(folders[1])


def test_tables_of_a_temporary_scope(spark):
    kept = materialize(spark.range(2), "kept")
    with temporary(spark):
        df = materialize(spark.range(5), "scoped")
        folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert df.count() == 5 and os.path.isdir(folder)
    assert not os.path.isdir(folder) and kept.count() == 2
    delete_materialized(kept)
