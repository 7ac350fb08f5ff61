"""Samples that match target shares of categories, by swap repair."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import same_name

#: Rows of the table of targets that the driver reads; more are refused.
MAX_TARGETS = 100_000
#: Buckets of the ids' hashes that are counted for each category.
BUCKET_BITS = 10
SEED = 7


@dataclass
class Wish:
    """One plan's demand of one category."""

    share: float
    least: int
    size: int

    @property
    def wanted(self) -> int:
        return max(self.least, round(self.share * self.size))


def drawn(there: list[int], n: int, rng: random.Random) -> list[int]:
    """How many of each category are among ``n`` rows drawn at random, all of them if there are fewer.

    The multivariate hypergeometric distribution, category by category: given what is left, a category's
    count is hypergeometric.  Of more than 10**9 rows, which the sampler doesn't take, it is drawn by the normal
    distribution of the same mean and variance.
    """
    total = sum(there)
    n = min(n, total)
    gen = np.random.default_rng(rng.getrandbits(64))
    out = []
    for k in there:
        rest = total - k
        if n == 0 or k == 0:
            got = 0
        elif total < 10**9:
            got = int(gen.hypergeometric(k, rest, n))
        else:
            mean = n * (k / total)
            spread = (mean * (rest / total) * ((total - n) / max(total - 1, 1))) ** 0.5
            got = round(gen.normal(mean, spread))
        got = max(min(got, k, n), n - rest)
        out.append(got)
        n, total = n - got, rest
    return out


def repair(wishes: dict[str, Wish], there: dict[str, int], rng: random.Random) -> dict[str, int]:
    """How many rows of each signature (category) to take.

    Starts with all minimum counts that can be met and random rows for the rest of the sample; then
    counts are exchanged between signatures as long as this lowers the total deviation from the target
    counts.  No count exceeds what is there or falls below its minimum.
    """
    size = max((w.size for w in wishes.values()), default=0)
    floor = {c: min(w.least, there.get(c, 0)) for c, w in wishes.items()}
    take = dict(floor)
    free = max(0, size - sum(take.values()))
    left = {c: there.get(c, 0) - take[c] for c in sorted(wishes)}
    for c, n in zip(left, drawn(list(left.values()), free, rng)):
        take[c] += n
    aim = {c: w.share * w.size for c, w in wishes.items()}
    while True:
        over = max((c for c in take if take[c] > floor[c]), key=lambda c: (take[c] - aim[c], c), default=None)
        under = max((c for c in take if take[c] < there.get(c, 0)), key=lambda c: (aim[c] - take[c], c), default=None)
        if over is None or under is None or over == under:
            return take
        most = min(take[over] - floor[over], there.get(under, 0) - take[under])
        move = min(most, max(1, int(min(take[over] - aim[over], aim[under] - take[under]))))
        cost = lambda d: abs(take[over] - d - aim[over]) + abs(take[under] + d - aim[under])  # noqa: E731, B023
        if cost(move) >= cost(0) - 1e-9:
            return take
        take[over], take[under] = take[over] - move, take[under] + move


class TargetSample:
    """A sample for each plan of a table of targets, and the report of what could not be met.

    ``rows`` has one id or more per row, in column ``id_col``; an id counts once, with the smallest of
    its categories.  Categories are compared in upper case without outer blanks; rows without a
    category, or whose category no plan names, are in no sample.  ``targets`` has plan_id, sample_size,
    a category, target_share and min_rows; null numbers count as 0; repeated rows of a plan and category
    count once, the largest.  Empty tables give empty samples, with a report for each target.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, id_col: str = "id", category: str = "evidence_label", seed: int = SEED):
        self.spark, self.id_col, self.category, self.seed = rows.sparkSession, id_col, category, seed
        got = targets.select("plan_id", "sample_size", same_name(F.col(f"`{category}`")).alias("c"), "target_share", "min_rows", F.col(f"`{category}`").alias("shown")).limit(MAX_TARGETS + 1).collect()
        if len(got) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets")
        self.plans: dict[int, dict[str, Wish]] = {}
        self.shown: dict[str, str] = {}
        for r in got:
            if r.plan_id is None or r.c is None:
                continue
            w = Wish(float(r.target_share or 0), int(r.min_rows or 0), int(r.sample_size or 0))
            plan = self.plans.setdefault(r.plan_id, {})
            plan[r.c] = max(plan.get(r.c, w), w, key=lambda x: (x.wanted, x.share, x.least))
            self.shown.setdefault(r.c, r.shown)
        names = [(c,) for c in sorted(self.shown)]
        known = self.spark.createDataFrame(names, "c string") if names else self.spark.createDataFrame([], "c string")
        labelled = rows.select(F.col(f"`{id_col}`").alias("id"), same_name(F.col(f"`{category}`")).alias("c")).where("id is not null and c is not null")
        # Known categories are as few as the targets; the join drops all others before the shuffle.
        labelled = labelled.join(F.broadcast(known), "c", "left_semi")
        self.ids = labelled.groupBy("id").agg(F.min("c").alias("c"))
        h = F.xxhash64("id", F.lit(seed))
        self.hashed = self.ids.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned(F.col("h"), 64 - BUCKET_BITS))
        #: Ids in each bucket of each category, in order; at most 2 ** BUCKET_BITS numbers for each category named.
        self.buckets: dict[str, list[int]] = {c: [0] * (1 << BUCKET_BITS) for c in self.shown}
        for r in self.hashed.groupBy("c", "bucket").count().collect():
            self.buckets[r.c][r.bucket] = r["count"]
        self.there = {c: sum(b) for c, b in self.buckets.items()}
        self.take = {p: repair(w, self.there, random.Random(f"{seed}/{p}")) for p, w in sorted(self.plans.items())}

    def report(self) -> DataFrame:
        """(plan_id, category, wanted, available, taken, short) of each target; ``short`` if more is asked for than there is."""
        rows = [(p, self.shown[c], w.wanted, self.there[c], self.take[p][c], w.wanted > self.there[c]) for p, plan in sorted(self.plans.items()) for c, w in sorted(plan.items())]
        schema = f"plan_id int, `{self.category}` string, wanted bigint, available bigint, taken bigint, short boolean"
        return self.spark.createDataFrame(rows, schema)

    def sample(self) -> DataFrame:
        """(plan_id, category, id) of each plan's rows.

        A plan takes, of each category, the ids that follow a random point in the order of their hashes:
        whole buckets first, then whole parts of the last bucket, and of the last part the first ids.
        """
        rows, n = [], 1 << BUCKET_BITS
        for p, counts in self.take.items():
            rng = random.Random(f"{self.seed}/{p}/start")
            for c, k in sorted(counts.items()):
                start, left, at = rng.randrange(n), k, 0
                own = self.buckets[c]
                while left and left >= own[(start + at) % n]:
                    left -= own[(start + at) % n]
                    at += 1
                    if at == n:
                        break
                rows.append((p, c, start, at, left))
        cuts = self.spark.createDataFrame(rows, "plan_id int, c string, start int, whole int, rest bigint")
        place = F.pmod(F.col("bucket") - F.col("start"), F.lit(n))
        hit = self.hashed.join(F.broadcast(cuts), "c").withColumn("place", place).where("place < whole or (place = whole and rest > 0)")
        full = hit.where("place < whole").select("plan_id", "c", "id")
        # The last bucket is cut by further bits of the hash in the same way, so only a millionth of a category is put in order.
        last = hit.where("place = whole").withColumn("part", F.shiftrightunsigned(F.col("h"), 64 - 2 * BUCKET_BITS).bitwiseAND(n - 1))
        parts: dict[tuple[int, str], list[int]] = {(p, c): [0] * n for p, c, _, _, rest in rows if rest}
        for r in last.groupBy("plan_id", "c", "part").count().collect():
            parts[r.plan_id, r.c][r.part] = r["count"]
        fine = []
        for p, c, _, _, rest in rows:
            if rest:
                at = 0
                while at < n and rest >= parts[p, c][at]:
                    rest -= parts[p, c][at]
                    at += 1
                fine.append((p, c, at, rest))
        ends = self.spark.createDataFrame(fine, "plan_id int, c string, parts int, left bigint")
        order = Window.partitionBy("plan_id", "c").orderBy("h", "id")
        near = last.join(F.broadcast(ends), ["plan_id", "c"]).where("part < parts or (part = parts and left > 0)")
        taken = near.where("part < parts").select("plan_id", "c", "id")
        some = near.where("part = parts").withColumn("nth", F.row_number().over(order)).where("nth <= left").select("plan_id", "c", "id")
        return full.unionByName(taken).unionByName(some).select("plan_id", F.col("c").alias(self.category), F.col("id").alias(self.id_col))
