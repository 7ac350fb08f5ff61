import random

import numpy as np
import pytest

from gristmill.operators import neardup as nd

FOX = ["the quick brown fox jumps over the lazy dog", "the quick brown fox leaps over the lazy dog", "completely different text about something else"]


def groups(spark, texts, k=3):
    return nd.classes(spark.createDataFrame(list(enumerate(texts)), "id bigint, t string"), "id", "t", k)


def jaccard(a, b, k=3):
    x, y = ({t.lower()[i : i + k] for i in range(len(t) - k + 1)} for t in (a, b))
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def pairs(df):
    return {(r.a, r.b) for r in df.collect()}


def test_known_values():
    h, n = nd.shingle_hashes(["abcde", "xan", "xc0", "ab", None, ""], 3)
    assert h.tolist() == [96354, 97347, 98340, 118437, 118437] and n.tolist() == [3, 1, 1, 0, 0, 0]
    sig = nd.min_hashes(h, n, nd.Params().functions)
    assert (sig[3:] == 2147483647).all() and (sig[:3] < 2147483647).all()


def test_long_shingles_wrap_with_the_sign_of_java():
    h, n = nd.shingle_hashes(["the quick brown fox jumps"], 14)
    a, b = nd.Params().functions[0]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    want = min((lambda v: abs(v) % nd.PRIME * (1 if v >= 0 else -1))(wrap(a * (x & (2**63 - 1)) + b)) for x in h.tolist())
    assert nd.min_hashes(h, n, [(a, b)])[0, 0] == want


def test_near_pair_and_thresholds(spark):
    g = groups(spark, FOX)
    found = nd.lsh_pairs(g).collect()
    assert [(r.a, r.b, round(r.similarity, 2)) for r in found] == [(0, 1, 0.82)]
    assert [(r.a, r.b, round(r.similarity, 6)) for r in nd.exact_pairs(g).collect()] == [(0, 1, 0.772727)]
    assert pairs(nd.exact_pairs(g, 0.9)) == set()
    with pytest.raises(ValueError):
        nd.exact_pairs(g, 0)
    with pytest.raises(ValueError):
        nd.lsh_pairs(g, verify="no")


def test_russian_pair(spark):
    g = groups(spark, ["быстрая лиса прыгает", "быстрая лиса прыгнет", "日本語のテキスト"])
    assert pairs(nd.exact_pairs(g, 0.5)) == {(0, 1)}


def test_short_empty_null_and_equal_texts_are_classes(spark):
    g = groups(spark, ["", "ab", "abc", None, "ABC", "abc"])
    assert {r.id: r.class_id for r in g.members.collect()} == {0: 0, 1: 0, 3: 0, 2: 2, 4: 2, 5: 2}
    assert nd.lsh_pairs(g, nd.Params(bands=10, rows=3)).count() == nd.exact_pairs(g).count() == 0
    empty = groups(spark, [])
    assert empty.members.count() == nd.lsh_pairs(empty).count() == nd.exact_pairs(empty).count() == 0


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "fox", "dog", "runs", "quickly", "over", "under"]
    bases = [" ".join(rng.choices(words, k=12)) for _ in range(8)]
    texts = bases + [" ".join(w if rng.random() > 0.15 else rng.choice(words) for w in b.split()) for b in bases for _ in range(5)] + ["x" * 50000 + " tail"]
    g = groups(spark, texts)
    reps = sorted(r.id for r in g.sets.collect())
    for t in (0.4, 0.8):
        brute = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if jaccard(texts[a], texts[b]) >= t}
        assert pairs(nd.exact_pairs(g, t)) == brute
        p = nd.Params(threshold=t)
        assert pairs(nd.lsh_pairs(g, p, "exact")) <= brute
        assert pairs(nd.lsh_pairs(g, p)) <= pairs(nd.candidates(nd.signatures(g.sets, p), p))
    q = nd.quality(nd.lsh_pairs(g), nd.exact_pairs(g)).first()
    assert q.recall > 0.3 and 0 <= q.precision <= 1


def test_lookup_does_not_add_the_query(spark):
    g = groups(spark, FOX)
    p = nd.Params(threshold=0.3)
    sigs = nd.signatures(g.sets, p)
    probe = nd.signatures(nd.shingle_sets(spark.createDataFrame([(7, "the quick brown fox jumped over the lazy dog")], "id bigint, t string"), "id", "t"), p)
    assert {(r.q, r.id) for r in nd.similar_to(probe, sigs, p).collect()} == {(7, 0), (7, 1)}
    assert nd.similar_to(probe, sigs, p, verified=False).count() >= 2


def test_signatures_do_not_depend_on_batches():
    texts = FOX * 5
    h, n = nd.shingle_hashes(texts, 3)
    sig = nd.min_hashes(h, n, nd.Params().functions)
    assert (sig[:3] == sig[3:6]).all() and np.unique(sig, axis=0).shape[0] == 3


def test_bit_planes_rule_out_no_pair_that_agrees():
    rng = np.random.default_rng(1)
    for places in (20, 100, 128):
        sig = rng.integers(0, 4, (60, places)) * 1_000_003
        i, j = np.triu_indices(60, 1)
        share = (sig[i] == sig[j]).mean(axis=1)
        kept = set(zip(*(x.tolist() for x in nd.may_agree(np.asfortranarray(nd.bit_planes(sig)), i, j, places, 0.3))))
        assert {(a, b) for a, b, s in zip(i.tolist(), j.tolist(), share) if s >= 0.3} <= kept < set(zip(i.tolist(), j.tolist()))


def test_index_that_grows(spark, tmp_path):
    index = nd.SignatureIndex(spark, str(tmp_path / "i"), nd.Params(threshold=0.3))
    assert index.size() == 0 and index.signature(0) is None and index.duplicates().count() == 0
    texts = spark.createDataFrame(list(enumerate(FOX)), "id bigint, text string")
    index.add(texts.where("id < 2"))
    index.add(texts.where("id = 2").unionByName(spark.createDataFrame([(3, None), (4, "ab"), (5, FOX[0].upper())], "id bigint, text string")))
    assert index.size() == 6 and len(index.signature(1)) == 100 and set(index.signature(3)) == {2147483647}
    probe = spark.createDataFrame([(7, "the quick brown fox jumped over the lazy dog")], "id bigint, text string")
    assert {(r.q, r.id) for r in index.similar_to(probe).collect()} == {(7, 0), (7, 1), (7, 5)}
    assert {(r.q, r.id) for r in index.candidates_of(probe).collect()} >= {(7, 0), (7, 5)}
    assert index.size() == 6 and pairs(index.duplicates()) == {(0, 1)}
