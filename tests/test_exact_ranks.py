"""Exact rank tests against enumeration."""

from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from tidemark.operators.exact_ranks import rank_sum_p, signed_rank_p
from tidemark.operators.stats import mann_whitney, wilcoxon


@pytest.mark.parametrize("n", range(1, 13))
def test_signed_ranks(n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product((0, 1), repeat=n)]
    for w in range(n * (n + 1) // 2 + 1):
        high, low = sum(s >= w for s in sums) / len(sums), sum(s <= w for s in sums) / len(sums)
        assert signed_rank_p(n, w) == pytest.approx((min(1, 2 * min(low, high)), high))


@pytest.mark.parametrize("m, n", [(1, 1), (1, 7), (2, 5), (4, 4), (5, 7), (7, 5)])
def test_rank_sums(m, n):
    us = [sum(places) - m * (m + 1) // 2 for places in combinations(range(1, m + n + 1), m)]
    for u in range(m * n + 1):
        assert rank_sum_p(m, n, u) == pytest.approx(sum(x >= u for x in us) / len(us))


def test_groups_in_spark(spark):
    rows = [("small", i, float(i * i + 1), 3.3 * i) for i in range(9)] + [("ties", i, 2.0, 1.0) for i in range(9)]
    rows += [("zero", i, float(i), 0.0) for i in range(5)] + [("big", i, (i * 37 % 101) + i / 500, 50.0) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    exact = {r.g: r for r in wilcoxon(df, "x", "y", ["g"], exact_upto=50).collect()}
    plain = {r.g: r for r in wilcoxon(df, "x", "y", ["g"]).collect()}
    assert (exact["small"].p_two_sided, exact["small"].p_greater) == signed_rank_p(9, exact["small"].w_plus)
    assert all(exact[g] == plain[g] for g in ("ties", "zero", "big"))
    two = df.where("g != 'zero'").select("g", "id", F.col("x").alias("v"), (F.col("id") % 2 == 0).alias("s"))
    exact = {r.g: r for r in mann_whitney(two, "v", "s", True, ["g"], exact_upto=8).collect()}
    plain = {r.g: r for r in mann_whitney(two, "v", "s", True, ["g"]).collect()}
    assert exact["small"].p == rank_sum_p(5, 4, exact["small"].u) and exact["small"].p != plain["small"].p
    assert all(exact[g] == plain[g] for g in ("ties", "big"))
