import random
from itertools import combinations

import numpy as np
import pytest

from gristmill.operators import blocks
from gristmill.operators import neardup as nd


def texts():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöжщ", k=5)) for _ in range(400)]
    bases = [rng.choices(words, k=n) for n in (3, 10, 40, 160, 700)]
    mixes = [" ".join(w if rng.random() > share else rng.choice(words) for w in b) for b in bases for share in (0.05, 0.15, 0.3, 0.5) for _ in range(6)]
    return mixes + ["", None, "ab", "日本語のテキスト", mixes[0].upper()]


@pytest.fixture(scope="module")
def found(spark):
    p = nd.Params(bands=30, rows=3)
    g = nd.classes(spark.createDataFrame(list(enumerate(texts())), "id bigint, t string").repartition(3), "id", "t", params=p, stored=False)
    sets = {r.id: set(r.shingles) for r in g.sets.collect()}
    exact = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    return p, g, exact


def test_all_pairs_by_blocks_against_brute_force(found, monkeypatch):
    p, g, exact = found
    monkeypatch.setattr(blocks, "TILE", 16)
    for t in (0.3, 0.5):
        got = [tuple(r) for r in nd.exact_pairs(g, t, dense=True).collect()]
        assert len(got) == len({x[:2] for x in got})
        assert {(a, b): s for a, b, s in got} == {k: s for k, s in exact.items() if s >= t}


def test_lsh_by_blocks_is_lsh_by_keys(found):
    p, g, exact = found
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    candidates = rows(nd.candidates(g.sigs, p))
    assert rows(nd.dense_candidates(g, p)) == candidates
    for verify in ("estimated", "exact"):
        assert rows(nd.dense_lsh_pairs(g, p, verify)) == rows(nd.lsh_pairs(g, p, verify)) != []


def test_pairs_are_not_shuffled(found):
    p, g, _ = found
    for df in (nd.dense_candidates(g, p), nd.dense_lsh_pairs(g, p), nd.dense_lsh_pairs(g, p, "exact"), nd.exact_pairs(g, dense=True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_an_id_with_two_texts_goes_by_keys(spark):
    rows = [(1, "the quick brown fox jumps over"), (1, "pack my box with five dozen jugs"), (2, "the quick brown fox leaps over")]
    g = nd.classes(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", params=nd.Params())
    assert g.count is None
    assert {(r.a, r.b) for r in nd.dense_lsh_pairs(g, nd.Params(), "exact").collect()} == {(1, 2)}


def test_long_bitmaps_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(3000, n, replace=False)).astype(np.int64) for n in rng.integers(0, 900, 60)]
    sets += [np.sort(np.append(s[: len(s) * 3 // 4], 5000 + np.arange(len(s) // 4))) for s in sets]
    table = nd.pa.table({"id": nd.pa.array(range(len(sets))), "shingles": nd.pa.array([s.tolist() for s in sets], nd.pa.list_(nd.pa.int64()))})
    one = blocks.Block(blocks.encoded(table, ["shingles"]))
    got = {tuple(sorted((int(one.ids[a]), int(one.ids[b])))) for i, j, _ in blocks.all_similar(one, one, 0.5) for a, b in zip(i, j)}
    share = lambda a, b: len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b)))
    assert got == {(a, b) for a, b in combinations(range(len(sets)), 2) if share(sets[a], sets[b]) >= 0.5}
