from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from gristmill.operators import blocks
from gristmill.operators import neardup as nd


def block_of(sets):
    return blocks.Block(blocks.encoded(nd.pa.table({"id": nd.pa.array(range(len(sets))), "shingles": nd.pa.array([s.tolist() for s in sets], nd.pa.list_(nd.pa.int64()))}), ["shingles"]))


def random_sets(rng, sizes, members=4000):
    sets = [np.sort(rng.choice(members, n, replace=False)).astype(np.int64) for n in sizes]
    return sets + [np.sort(np.append(s[: len(s) * 3 // 4], members + 1000 + np.arange(len(s) // 4))) for s in sets]


@pytest.mark.parametrize("low, high, fields", [(40, 160, 3), (300, 500, 2), (1000, 1500, 2), (40, 160, 1)])
def test_counts_side_by_side_are_the_counts(low, high, fields, monkeypatch):
    if fields == 1:
        monkeypatch.setattr(blocks, "WIDTHS", {1: 23})
    rng = np.random.default_rng(low)
    one = block_of(random_sets(rng, rng.integers(low, high, 50), 20000))
    bits = blocks._bits(one.sizes.mean(), 0.5)
    a = one.tile(0, bits, 1 / 3)
    assert a.fields(a) == fields
    want = a.flat.astype(np.int64) @ a.flat.T.astype(np.int64) >= a.least[:, None] + a.least[None, :]
    got = np.zeros_like(want)
    i, j = a.near(a)
    got[i, j] = True
    assert (np.diff(i) >= 0).all() and len(i) == want.sum() and (got == want).all() and not want.all()


def test_short_sets_and_the_empty_one(monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 16)
    monkeypatch.setattr(blocks, "PAIRS", 5)
    rng = np.random.default_rng(4)
    sets = random_sets(rng, [*range(12), *rng.integers(20, 200, 40)])
    sets = list({s.tobytes(): s for s in sets}.values())
    one = block_of(sets)
    share = lambda a, b: len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b)))
    for t in (0.1, 0.5, 1.0):
        got = [tuple(sorted((int(one.ids[a]), int(one.ids[b])))) for i, j, _ in blocks.all_similar(one, one, t) for a, b in zip(i, j)]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in combinations(range(len(sets)), 2) if share(sets[a], sets[b]) >= t}


@pytest.mark.parametrize("query", ["neardup_pairs_exact", "neardup_quality"])
def test_exact_pairs_of_claims_are_not_shuffled(spark, tmp_path, query, monkeypatch):
    from gristmill.plans import reference as ref

    plans = []
    held = nd.exact_pairs
    monkeypatch.setattr(nd, "exact_pairs", lambda *a, **k: plans.append(held(*a, **k)) or plans[-1])
    texts = [(i, f"claim {i % 40} of the {'large' if i % 3 else 'small'} mice of strain {i % 7}") for i in range(90)]
    spark.createDataFrame(texts, "id bigint, claim string").write.parquet(str(Path(tmp_path) / "claims_test.parquet"))
    assert getattr(ref, query)(spark, str(tmp_path)).count() > 0
    assert "Exchange" not in plans[0]._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
