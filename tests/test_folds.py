"""Random parts from counts: the draws themselves, what they depend on, and rows made from them."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseloom import domain as D
from caseloom.operators import folds
from caseloom.operators.aggregate import tally
from caseloom.operators.features import feature_kinds
from caseloom.plans import reports as R
from caseloom.sources import Stages
from registry.fixture import cohort


def inverse(n, p, u):
    """The least k with P(X <= k) > u, from probabilities written out."""
    r = min(p, 1 - p)
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * r**k * (1 - r) ** (n - k)
        if u < below:
            return n - k if p > 0.5 else k
    return n if p <= 0.5 else 0


def drawn(spark, trials):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(trials)], "i int, n bigint, p double, u double")
    return [r[0] for r in df.select("i", folds.binomial_draw(F.col("n"), F.col("p"), F.col("u")).alias("k")).orderBy("i").select("k").collect()]


def test_draws_are_the_inverse_of_the_distribution(spark):
    rng = random.Random(5)
    sizes = [0, 1, 2, 3, 7, 20, 61, 150, 400, 900]
    trials = [(n, p, rng.random()) for n in sizes for p in (0.25, 1 / 3, 0.5, 0.9, 0.02, 1.0, 0.0) for _ in range(12)]
    trials += [(n, p, u) for n in (5, 300) for p in (0.25, 0.75) for u in (0.0, 1 - 2**-36)]
    assert drawn(spark, trials) == [inverse(*t) for t in trials]


@pytest.mark.parametrize("n", [10**5, 10**8, 10**11])
def test_large_numbers_follow_the_normal_law(spark, n):
    p = 0.25
    sd = math.sqrt(n * p * (1 - p))
    quantiles = {0.0013499: -3.0, 0.158655: -1.0, 0.5: 0.0, 0.841345: 1.0, 0.99865: 3.0}
    got = drawn(spark, [(n, p, u) for u in quantiles])
    for k, z in zip(got, quantiles.values(), strict=True):
        # The first correction of the normal law for skewness.
        want = z + (z * z - 1) * (1 - 2 * p) / (6 * sd)
        assert abs((k - n * p) / sd - want) < 0.51 / sd + 2e-3


def test_parts_of_many_kinds_have_the_right_mean_and_spread(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("v"), F.lit(40).cast("bigint").alias("rows"))
    rows = folds.drawn_parts(df, (1.0, 2.0, 1.0)).select("parts").collect()
    assert all(sum(r[0]) == 40 for r in rows)
    for i, p in enumerate((0.25, 0.5, 0.25)):
        values = [r[0][i] for r in rows]
        mean = sum(values) / len(values)
        spread = sum((v - mean) ** 2 for v in values) / len(values)
        assert abs(mean - 40 * p) < 4 * math.sqrt(40 * p * (1 - p) / 4000)
        assert abs(spread / (40 * p * (1 - p)) - 1) < 0.1
    both = sum((r[0][0] - 10) * (r[0][1] - 20) for r in rows) / len(rows)
    assert abs(both / (-40 * 0.25 * 0.5) - 1) < 0.15  # parts of one kind take from each other


def test_weights(spark):
    df = spark.createDataFrame([("a", 1000)], "v string, rows bigint")

    def parts(*weights):
        return folds.drawn_parts(df, weights).first()["parts"]

    assert parts(3.0) == [1000] and parts(0.0, 1.0) == [0, 1000] and parts(1.0, 0.0, 1.0)[1] == 0
    for weights in ((), (1.0, 0.0), (-1.0, 2.0)):
        with pytest.raises(ValueError):
            parts(*weights)


def test_seeds_and_kinds_draw_apart(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("v"), F.lit(9).cast("bigint").alias("rows"))
    one, two, again = ([tuple(r["parts"]) for r in folds.drawn_parts(df, (1.0, 1.0), s).orderBy("v").collect()] for s in (1, 2, 1))
    assert one == again != two
    assert len(set(one)) > 4


def test_nothing_is_written_and_parts_do_not_depend_on_partitioning(spark, data):
    people = cohort(spark, data)
    with Stages(spark) as stages:
        parts = folds.split_random(R.model_rows(people))
        again = folds.split_random(R.model_rows(people.repartition(7)))
        sizes = [[p.count() for p in s] for s in (parts, again)]
        assert stages.paths == []
    n = R.model_rows(people).count()
    assert sizes[0] == sizes[1] and sum(sizes[0]) == n
    assert all(abs(s - n / 4) <= 5 * math.sqrt(n * 3 / 16) for s in sizes[0])
    dealt = folds.random_folds(feature_kinds(people, D.DEATH_MODEL))
    assert [r[0] for r in dealt.groupBy("fold").agg(F.sum("rows")).orderBy("fold").select("sum(rows)").collect()] == sizes[0]


def test_a_kind_of_most_rows_is_drawn_without_its_rows(spark):
    df = spark.createDataFrame([("hot", 2 * 10**11), ("cold", 3)], "v string, rows bigint")
    got = {(r["v"], r["fold"]): r["rows"] for r in folds.random_folds(df).collect()}
    assert sum(n for (v, _), n in got.items() if v == "hot") == 2 * 10**11
    sd = math.sqrt(2 * 10**11 * 3 / 16)
    assert all(abs(got["hot", i] - 5 * 10**10) < 5 * sd for i in range(4))


def test_rows_of_a_heavy_kind_are_made_in_many_tasks(spark):
    df = spark.createDataFrame([("hot", 50_000), ("cold", 2)], "v string, rows bigint")
    rows = folds.unfold(df, heaviest=1000)
    assert dict(Counter(r["v"] for r in rows.collect())) == {"hot": 50_000, "cold": 2}
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 15_000


def test_parts_of_any_table(spark):
    odd = [(None, 1.5, "x")] * 5 + [("a", None, "y")] * 3 + [("a", float("nan"), None), ("", 0.0, "x")]
    df = spark.createDataFrame(odd, "rows string, parts double, v string")
    parts = folds.split_random(df, (1.0, 1.0, 2.0))
    assert all(p.columns == df.columns for p in parts)
    assert sorted(str(tuple(r)) for p in parts for r in p.collect()) == sorted(str(t) for t in odd)
    assert [p.count() for p in folds.split_random(df.limit(0))] == [0, 0, 0, 0]
    assert folds.random_folds(tally(df.limit(0), ["v"])).collect() == []
