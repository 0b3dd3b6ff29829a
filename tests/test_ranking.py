"""Exact ranks through many ranges equal a plain sort."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import ranking
from ledgerlark.operators import training


def ntile(values, buckets):
    """NTILE by definition over (value, key) pairs."""
    ordered = sorted(values)
    small, extra = divmod(len(ordered), buckets)
    result, at = {}, 0
    for bucket in range(1, buckets + 1):
        for value, key in ordered[at : at + small + (bucket <= extra)]:
            result[key] = bucket
        at += small + (bucket <= extra)
    return result


@pytest.mark.parametrize("n", [0, 1, 4, 7, 59, 3000])
def test_ntile_with_heavy_ties(spark, n):
    draw = random.Random(n)
    rows = [(key, 1 if draw.random() < 0.5 else draw.randint(1, 9), draw.random()) for key in range(n)]
    frame = spark.createDataFrame(rows, "id bigint, tied int, spread double")
    scored = ranking.add_ntile(
        frame, 5, "id", {"a": F.col("tied"), "b": -F.col("tied"), "c": F.col("spread")}
    ).collect()
    up = ntile([(row[1], row[0]) for row in rows], 5)
    down = ntile([(-row[1], row[0]) for row in rows], 5)
    spread = ntile([(row[2], row[0]) for row in rows], 5)
    assert len(scored) == n
    assert all((row.a, row.b, row.c) == (up[row.id], down[row.id], spread[row.id]) for row in scored)


def test_quantiles_match_linear_interpolation(spark):
    draw = random.Random(3)
    rows = [(draw.randint(0, 6), draw.gauss(0, 1) if draw.random() < 0.9 else None) for _ in range(700)]
    frame = spark.createDataFrame(rows, "x int, y double")
    found = ranking.quantiles(frame, ["x", "y"], [0.0, 0.25, 0.5, 0.9, 1.0])
    for name, at in (("x", 0), ("y", 1)):
        present = [row[at] for row in rows if row[at] is not None]
        assert found[name] == pytest.approx(list(np.quantile(present, [0.0, 0.25, 0.5, 0.9, 1.0])), abs=1e-12)


def test_quantiles_of_nothing(spark):
    frame = spark.createDataFrame([(None,)], "x int")
    assert ranking.quantiles(frame, ["x"], [0.5]) == {"x": [None]}


def test_median_of_decimals(spark):
    frame = spark.createDataFrame([("1.10",), ("2.25",), ("9.99",), ("3.00",)], "t string").select(
        F.col("t").cast("decimal(13,2)").alias("x")
    )
    assert ranking.quantiles(frame, ["x"], [0.5])["x"][0] == median([1.10, 2.25, 9.99, 3.00])


def test_small_decimals_keep_their_places(spark):
    frame = spark.createDataFrame([("0.00000012",), ("0.00000034",), ("0.00000041",)], "t string").select(
        F.col("t").cast("decimal(18,8)").alias("x")
    )
    assert ranking.quantiles(frame, ["x"], [0.5])["x"] == [pytest.approx(3.4e-7, rel=1e-12)]


@pytest.mark.parametrize("n", [10_000, 1_000_000])
def test_a_value_with_most_rows_leaves_ranges_even(spark, n):
    """60 % of the rows hold one value, the rest is distinct; the ranges stay even."""
    frame = spark.range(n).select("id", F.when(F.col("id") % 10 < 6, 0.5).otherwise(F.col("id") / n).alias("x"))
    values = [0.5 if k % 10 < 6 else k / n for k in range(n)]
    assert ranking.quantiles(frame, ["x"], [0.1, 0.5, 0.99])["x"] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.99])), abs=1e-12)
    counted = ranking._counted(frame, {"x": F.col("x")}, None, "double")
    sizes = [row["count"] for row in ranking.in_ranges(counted, "name", "value", "key").groupBy("range").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_auc_of_scores_in_one_tiny_range(spark):
    """Rare-event scores all lie below 1e-8."""
    draw = random.Random(5)
    rows = [(int(draw.random() < 0.3), draw.randint(1, 900) * 1e-11) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "churned int, churn_probability double").withColumn("prediction", F.lit(0))
    pairs = sum((a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z)
    total = sum(y for y, _ in rows) * sum(1 - y for y, _ in rows)
    assert training.binary_metrics(frame).first()["roc_auc"] == pytest.approx(pairs / total, abs=1e-12)


@pytest.mark.parametrize("step", [1, 4096, 1 << 32, -(1 << 33)])
def test_hash_spreads_regular_ids(spark, step):
    ids = spark.range(200_000).select((F.col("id") * step).alias("id"))
    sizes = ids.groupBy(F.floor(ranking.portable_hash(F.col("id"), 42) / (1 << 26))).count().collect()
    assert len(sizes) == 64 and max(row["count"] for row in sizes) <= 2 * 200_000 / 64


def test_hash_rank_is_a_rank_per_group(spark):
    frame = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"))
    ranked = ranking.add_hash_rank(frame, "g", "id", 42).collect()
    for group in (0, 1):
        rows = [row for row in ranked if row.g == group]
        expected = sorted(rows, key=lambda row: ((row.id * 2654435761 + 42) % 2**32, row.id))
        assert [row.hash_rank for row in expected] == list(range(1, len(rows) + 1))


def test_portable_hash_accepts_any_bigint(spark):
    assert spark.createDataFrame([(2**62,)], "id bigint").select(ranking.portable_hash(F.col("id"), 42)).first()[0] >= 0
