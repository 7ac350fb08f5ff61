import random

import pytest

from gristmill.llm import sampling
from gristmill.llm.sampling import TargetSample, Wish, repair

TARGETS = "plan_id int, sample_size bigint, evidence_label string, target_share double, min_rows bigint"


def rows_of(spark, counts):
    out, i = [], 0
    for label, n in counts.items():
        for _ in range(n):
            out.append((i, label))
            i += 1
    return spark.createDataFrame(out, "id bigint, evidence_label string").selectExpr("*", "1 as c", "2 as h", "3 as bucket", "4 as plan_id")


def test_repair_meets_targets_that_can_be_met():
    rng = random.Random(0)
    for _ in range(300):
        there = {c: rng.randrange(0, 400) for c in "abcde"}
        share = [rng.random() for _ in there]
        size = rng.randrange(1, 500)
        wishes = {c: Wish(s / sum(share), rng.randrange(0, 20), size) for c, s in zip(there, share)}
        take = repair(wishes, there, rng)
        floor = {c: min(w.least, there[c]) for c, w in wishes.items()}
        assert all(floor[c] <= take[c] <= there[c] for c in there)
        assert sum(take.values()) == max(sum(floor.values()), min(size, sum(there.values())))
        # No exchange of one row lowers the deviation.
        gap = {c: take[c] - wishes[c].share * size for c in there}
        for a in there:
            for b in there:
                if a != b and take[a] > floor[a] and take[b] < there[b]:
                    assert abs(gap[a] - 1) + abs(gap[b] + 1) >= abs(gap[a]) + abs(gap[b]) - 1e-6


def test_sample_and_report(spark):
    df = rows_of(spark, {"NEI": 600, " nei": 100, "SUPPORT": 250, "rare ": 7, None: 40, "other": 90, "": 5})
    targets = spark.createDataFrame([(1, 100, "NEI", 0.5, 0), (1, 100, "SUPPORT", 0.4, 0), (1, 100, "RARE", 0.1, 3), (2, 1000, "SUPPORT", 1.0, 0), (3, 10, "NEI", 1.0, 0), (3, 10, "RARE", 0.0, 5), (3, 10, "ABSENT", 0.0, 1)], TARGETS)
    s = TargetSample(df, targets)
    report = {(r.plan_id, r.evidence_label): (r.wanted, r.available, r.taken, r.short) for r in s.report().collect()}
    assert report[(1, "RARE")] == (10, 7, 7, True) and report[(1, "NEI")][:2] == (50, 700)
    assert report[(2, "SUPPORT")] == (1000, 250, 250, True)
    assert report[(3, "RARE")] == (5, 7, 5, False) and report[(3, "ABSENT")] == (1, 0, 0, True) and report[(3, "NEI")] == (10, 700, 5, False)
    assert sum(v[2] for k, v in report.items() if k[0] == 1) == 100
    got = [(r.plan_id, r.evidence_label, r.id) for r in s.sample().collect()]
    assert len(got) == len(set(got))
    for (p, c), v in report.items():
        assert sum(1 for x in got if x[:2] == (p, c)) == v[2]
    labels = {r.id: (r.evidence_label or "").strip().upper() for r in df.collect()}
    assert all(labels[i] == c for _, c, i in got)
    again = [(r.plan_id, r.evidence_label, r.id) for r in TargetSample(df.repartition(3), targets).sample().collect()]
    assert sorted(again) == sorted(got)
    other = [(r.plan_id, r.evidence_label, r.id) for r in TargetSample(df, targets, seed=8).sample().collect()]
    assert sorted(other) != sorted(got)


def test_every_id_has_a_chance(spark):
    df = rows_of(spark, {"A": 50})
    targets = spark.createDataFrame([(p, 10, "A", 1.0, 0) for p in range(60)], TARGETS)
    assert len({r.id for r in TargetSample(df, targets).sample().collect()}) == 50


def test_repeats_empty_and_null(spark):
    df = spark.createDataFrame([(1, "A"), (1, "A"), (None, "A"), (2, "a"), (3, None)], "id bigint, evidence_label string")
    targets = spark.createDataFrame([(1, 2, "A", 1.0, 0), (1, 2, "A", 1.0, 0), (1, None, None, None, None), (2, 5, "B", None, None)], TARGETS)
    s = TargetSample(df, targets)
    assert {(r.plan_id, r.evidence_label, r.available, r.taken) for r in s.report().collect()} == {(1, "A", 2, 2), (2, "B", 0, 0)}
    assert {r.id for r in s.sample().collect()} == {1, 2}
    assert TargetSample(df.limit(0), targets).sample().count() == 0
    nothing = TargetSample(df, targets.limit(0))
    assert nothing.sample().count() == nothing.report().count() == 0


def test_too_many_targets_are_refused(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MAX_TARGETS", 1)
    targets = spark.createDataFrame([(1, 2, "A", 1.0, 0), (1, 2, "B", 1.0, 0)], TARGETS)
    with pytest.raises(ValueError):
        TargetSample(rows_of(spark, {"A": 1}), targets)


def test_the_start_is_drawn_at_random():
    import statistics

    from gristmill.llm.sampling import drawn

    rng = random.Random(3)
    got = [drawn([10, 0, 90, 900], 100, rng) for _ in range(400)]
    assert all(sum(x) == 100 and x[1] == 0 and x[0] <= 10 for x in got)
    assert abs(statistics.mean(x[2] for x in got) - 9) < 0.6 and 2 < statistics.stdev(x[2] for x in got) < 3.6
    assert drawn([3, 4], 100, rng) == [3, 4] and drawn([], 5, rng) == [] and drawn([5], 0, rng) == [0]
    big = drawn([10**12, 3 * 10**12], 4 * 10**8, rng)
    assert sum(big) == 4 * 10**8 and abs(big[0] - 10**8) < 10**5
