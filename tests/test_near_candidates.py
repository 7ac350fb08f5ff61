import random

from gristmill.operators import neardup as nd


def test_sizes_and_bitmaps_rule_out_most_candidates_but_no_similar_pair(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh", k=110))
    texts = [base[:40] + "".join(rng.choices("ijklmnop", k=k % 90)) + base[40:] for k in range(90)] + ["", None, base[:30]]
    g = nd.classes(spark.createDataFrame(list(enumerate(texts)), "id bigint, t string"), "id", "t")
    p = nd.Params(threshold=0.8)
    all_of = {(r.a, r.b) for r in nd.candidates(nd.signatures(g.sets, p), p).collect()}
    left = [(r.a, r.b) for r in nd.near_candidates(g.sets, p).collect()]
    shingles = {r.id: set(r.shingles) for r in g.sets.collect()}
    similar = {(a, b) for a, b in all_of if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])}
    assert len(left) == len(set(left)) and similar and similar <= set(left) < all_of
    assert {(r.a, r.b) for r in nd.lsh_pairs(g, p, "exact").collect()} == similar


def test_equal_rows_and_an_id_with_two_texts(spark):
    rows = [(1, "one text"), (1, "one text"), (2, "one text"), (3, "two texts"), (3, "another one")]
    g = nd.classes(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", params=nd.Params())
    assert sorted(r.id for r in g.sets.collect()) == sorted(r.id for r in g.sigs.collect()) == [1, 3, 3]
    assert sorted((r.id, r.class_id) for r in g.members.collect()) == [(1, 1), (2, 1), (3, 3)]
