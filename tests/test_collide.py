import itertools, random
import numpy as np, pytest
from gristmill.operators.collide import colliding_pairs


def entries(spark, rows, payload=True):
    load = lambda i, p: None if i is None else np.array([i, p] if payload else [i], np.int64).tobytes()
    return spark.createDataFrame([(k, load(i, p)) for k, i, p in rows], "key bigint, load binary")


def brute(rows, admit=None):
    by = {}
    for k, i, p in rows:
        if k is not None and i is not None:
            by.setdefault(k, []).append((i, p))
    return {(min(a[0], b[0]), max(a[0], b[0])) for v in by.values() for a, b in itertools.combinations(v, 2) if a[0] != b[0] and (admit is None or admit(a[1], b[1]))}


def near():
    def two_apart(load, i, j):
        keep = np.abs(load[i, 0] - load[j, 0]) <= 2
        return i[keep], j[keep]

    return two_apart


@pytest.mark.parametrize("chunk", [1, 3, 7, 4096])
def test_against_brute_force(spark, chunk):
    rng = random.Random(chunk)
    # One key has a third of all entries; ids repeat under several keys.
    rows = [(rng.choice([5, rng.randrange(-40, 40), rng.randrange(1 << 60)]), rng.randrange(150), rng.randrange(10)) for _ in range(300)]
    rows += [(None, 1, 1), (5, None, 1), (5, 7, 0), (5, 7, 0)]
    got = [tuple(r) for r in colliding_pairs(entries(spark, rows), 1, near(), chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, lambda a, b: abs(a - b) <= 2)
    assert {tuple(r) for r in colliding_pairs(entries(spark, rows, False), chunk=chunk).collect()} == brute(rows)


def test_chunks_across_batches_and_empty(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        rows = [(1, i, 0) for i in range(31)] + [(2, i, 0) for i in range(3)] + [(3, 99, 0)]
        for chunk in (4, 5, 10, 30, 31):
            assert {tuple(r) for r in colliding_pairs(entries(spark, rows, False), chunk=chunk).collect()} == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert colliding_pairs(entries(spark, [], False)).count() == 0
