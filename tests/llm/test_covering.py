import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import covering as cv

SCHEMA = "id bigint, claim string"


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_set_of_differing_places(radius):
    n = (1 << (radius + 1)) - 1
    field = (1 << cv.PLACE_BITS) - 1
    if n * cv.PLACE_BITS > 64:
        with pytest.raises((OverflowError, ValueError)):
            cv.masks(radius)
        return
    own = [int(m) for m in cv.masks(radius)]
    assert len(own) == n
    for places in itertools.combinations(range(n), radius):
        off = sum(field << (cv.PLACE_BITS * p) for p in places)
        assert any(m & off == 0 for m in own)


def jaccard(a, b):
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def texts_with_edits(seed, n):
    rng = random.Random(seed)
    syllables = ["kra", "mol", "tis", "ven", "quo", "rel", "pha", "zu", "gon", "dri", "ba", "xi"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(2, 5)))
    out = []
    for _ in range(n):
        base = [word() for _ in range(12)]
        out.append(" ".join(base))
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randrange(1, 6)):
                k = rng.randrange(len(t))
                x = rng.random()
                t[k] = word() if x < 0.5 else t[k][:-1] if x < 0.8 else t[k].upper()
            if rng.random() < 0.3:
                rng.shuffle(t)
            out.append(" ".join(t))
    return out


def test_found_pairs_are_all_and_only_the_similar_ones(spark):
    texts = texts_with_edits(4, 120)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {(r.id_a, r.id_b) for r in cv.all_pairs(*cv.near_duplicates(df)).collect()}
    folded = ["".join(c for c in t.lower() if c.isalnum()) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if folded[i] == folded[j] or jaccard(folded[i], folded[j]) >= 0.6}
    assert got <= want and len(got) >= 0.995 * len(want) > 100


def test_on_the_claims(spark, data):
    df = spark.read.parquet(f"{data}/claims_test.parquet")
    got = {(r.id_a, r.id_b) for r in cv.all_pairs(*cv.near_duplicates(df)).collect()}
    from gristmill.functions.text import fold

    rows = df.select("id", fold(F.col("claim")).alias("f")).where("f <> ''").distinct().collect()
    want = {tuple(sorted((a.id, b.id))) for a, b in itertools.combinations(rows, 2) if a.id != b.id and (a.f == b.f or jaccard(a.f, b.f) >= 0.6)}
    assert got == want


def test_edge_texts(spark):
    rows = [(1, None), (2, ""), (3, " ?!"), (4, "ab"), (5, "AB."), (6, "ac"), (7, "1.5 mg"), (8, "15 mg"), (9, "1,5 mg"), (None, "ab"), (5, "AB."), (10, "x" * 300_000), (11, "x" * 300_001), (12, "日本語のテキスト🙂です"), (13, "日本語のテキスト🙂で す")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rep", "'t' as text", "2 as key", "3 as a", "4 as c0")
    links, members = cv.near_duplicates(df)
    got = {(r.id_a, r.id_b) for r in cv.all_pairs(links, members).collect()}
    assert got == {(4, 5), (10, 11), (12, 13)}
    empty = cv.near_duplicates(df.limit(0))
    assert cv.all_pairs(*empty).count() == cv.group_near_duplicates(*empty).count() == 0


def test_groups_count_links_not_copies(spark):
    a = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(1, a), (2, a.upper()), (3, a + "s"), (4, a.replace("river", "rivers") + "s"), (9, "nothing like it at all, this one is by itself")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.class_id, r.group_id, r.n_links) for r in cv.group_near_duplicates(*cv.near_duplicates(df)).collect()}
    assert got == {1: (1, 1, 2), 2: (1, 1, 2), 3: (3, 1, 2), 4: (4, 1, 2), 9: (9, 9, 0)}


def test_many_copies_of_one_text_are_one_entry(spark):
    df = spark.range(3000).select(F.col("id"), F.lit("one and the same claim, word for word").alias("claim"))
    links, members = cv.near_duplicates(df)
    assert links.count() == 0 and members.where("rep = 0").count() == 3000


def test_sketch_does_not_depend_on_the_batch():
    texts = ["abcdefgh", "xy", "abcdefgx", "longer text with more in it"]
    some, keys, checks = cv.sketch(texts)
    assert some.tolist() == [True, False, True, True]
    for k, t in enumerate(["abcdefgh", "abcdefgx", "longer text with more in it"]):
        _, one, c = cv.sketch([t])
        assert np.array_equal(one[0], keys[k]) and np.array_equal(c[0], checks[k])


def test_parts_of_short_texts_only():
    for texts in (["ab"], ["", "a"], []):
        some, keys, checks = cv.sketch(texts)
        assert not some.any() and keys.shape == (0, 84) and len(checks) == 0


def test_common_counts_by_sets():
    texts = texts_with_edits(9, 6) + ["ab", "", "x" * 5000]
    a, b = texts, texts[::-1]
    sets = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    want = [(len(sets(x)), len(sets(y)), len(sets(x) & sets(y))) for x, y in zip(a, b)]
    assert list(zip(*(v.tolist() for v in cv.common_counts(a, b)))) == want


def test_exact_links_lose_none(spark):
    texts = texts_with_edits(4, 60)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {(r.id_a, r.id_b) for r in cv.all_pairs(*cv.near_duplicates(df, exact=True)).collect()}
    folded = ["".join(c for c in t.lower() if c.isalnum()) for t in texts]
    assert got == {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if folded[i] == folded[j] or jaccard(folded[i], folded[j]) >= 0.6}


def test_check_columns_rule_out_no_similar_pair():
    texts = ["".join(c for c in t.lower() if c.isalnum()) for t in texts_with_edits(2, 40)]
    _, _, checks = cv.sketch(texts)
    i, j = np.array(list(itertools.combinations(range(len(texts)), 2))).T
    may = set(zip(*(x.tolist() for x in cv.may_reach(checks, i, j, 0.6))))
    similar = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if jaccard(texts[a], texts[b]) >= 0.6}
    assert similar <= may and len(may) < 3 * len(similar)
