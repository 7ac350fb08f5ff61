import random

from gristmill.operators.components import components


def by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def run(spark, edges):
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len({r.node for r in got})
    return {r.node: r.root for r in got}


def test_chains_stars_and_random_graphs(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    rng.shuffle(chain)
    star = [(1000, 1000 + i) for i in range(1, 100)]
    mixed = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    edges = chain + star + [e for e in mixed if e[0] != e[1]]
    assert run(spark, edges) == by_hand(edges)


def test_odd_edges(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, 1), (2, None), (None, 3)]) == {}
    assert run(spark, [(5, 4), (4, 5), (5, 4)]) == {4: 4, 5: 4}
