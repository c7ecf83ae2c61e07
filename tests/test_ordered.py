"""Ordered operators against plain windows and numpy, with a third of the rows on one key."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlens.operators import ordered
from wardlens.plans import features as f


@pytest.fixture(autouse=True, params=[40, 10**9], ids=["many slices", "one slice"])
def slices(request, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", request.param)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = 0 if rng.random() < 0.4 else rng.randint(1, 40)
        value = 5.0 if rng.random() < 0.33 else round(rng.lognormvariate(0, 3), 3)
        when = datetime(2020, 1, 1) + timedelta(days=rng.choice([0, 0, 0, rng.randint(0, 90)]), minutes=rng.randint(0, 1440))
        data.append((i, key if rng.random() > 0.02 else None, value if rng.random() > 0.05 else None, when if rng.random() > 0.03 else None))
    df = spark.createDataFrame(data, "id long, k long, v double, at timestamp_ntz")
    return df.repartition(7)


@pytest.mark.parametrize("block", [1, 3, 10**6])
def test_next_in_time_equals_plain_lead(skewed, block, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", block)
    w = Window.partitionBy("k").orderBy("at", "id")
    both = ordered.next_in_time(skewed, ["k"], "at", "id", "nxt").withColumn("want", F.lead("at").over(w))
    assert both.where(~F.col("nxt").eqNullSafe(F.col("want"))).count() == 0
    assert both.count() == 3000


@pytest.mark.parametrize("by", [[], ["k"]])
def test_percentiles_equal_numpy(skewed, by):
    fractions = {"p0": 0.0, "p01": 0.01, "p50": 0.5, "p77": 0.77, "p100": 1.0}
    got = {r["k"] if by else None: r for r in ordered.exact_percentiles(skewed, "v", fractions, by).collect()}
    groups = {}
    for r in skewed.where("v IS NOT NULL").collect():
        groups.setdefault(r["k"] if by else None, []).append(r["v"])
    assert set(got) == set(groups)
    for key, values in groups.items():
        for name, fraction in fractions.items():
            assert got[key][name] == pytest.approx(np.quantile(values, fraction), abs=1e-9)


def test_running_totals_equal_plain_window(skewed):
    counts = skewed.where("v IS NOT NULL").groupBy("k", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    out = ordered.running_totals(counts, "v", ["n"], ["k"]).withColumn("want", F.coalesce(F.sum("n").over(w), F.lit(0)))
    assert out.where("n_before <> want").count() == 0
    assert out.count() == counts.count()


@pytest.mark.parametrize("share", [0.0, 0.2, 0.999, 1.0])
def test_share_per_class(skewed, share):
    order = F.col("id") * 7 % 11  # many ties
    out = ordered.smallest_share(skewed, order, share, ["k"], tie="id")
    rank = F.row_number().over(Window.partitionBy("k").orderBy(order, "id"))
    size = F.count("*").over(Window.partitionBy("k"))
    want = out.withColumn("want", rank <= F.floor(size * share + 1e-9))
    assert want.where("want <> in_share").count() == 0 and want.count() == 3000


def test_partitioning_does_not_change_splits(skewed):
    sides = [
        {r["id"] for r in f.split_stratified(df, "id", "k").where("is_test").collect()}
        for df in (skewed, skewed.repartition(1), skewed.orderBy(F.desc("id")))
    ]
    assert sides[0] == sides[1] == sides[2]
    shares = [{r["id"] for r in f.split_positional(df, "id").where("is_train").collect()} for df in (skewed, skewed.repartition(3))]
    assert shares[0] == shares[1] == set(range(2400))


def test_next_row_crosses_slices(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") * 2).alias("x"))
    out = ordered.next_row(df, "id", ["x"], [10.0, 10.5, 50.0])
    assert out.where("NOT (next_x <=> IF(id < 99, x + 2, NULL))").count() == 0


def test_first_rows_is_cut_before_the_shuffle(skewed):
    plan = ordered.first_rows(skewed, ["k"], ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_slice_of_matches_sorted_position(spark):
    points = [1.0, 2.0, 4.0, 8.0, 8.5]
    values = [0.0, 1.0, 1.5, 2.0, 3.9, 4.0, 8.0, 8.4, 8.5, 99.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(ordered.slice_of(F.col("v"), points)).collect()]
    assert got == [int(np.searchsorted(points, v, side="right")) for v in values]


def test_next_in_time_spreads_one_instant_of_one_key(spark, monkeypatch):
    """A third of the rows on one key and one instant: no window partition has more rows than a block and its guard."""
    rows = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("timestamp").cast("timestamp_ntz").alias("at"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = ordered.placed_in_order(rows, ["k", "at", "id"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", 700)
    got = ordered.next_in_time(rows, ["k"], "at", "id", "nxt")
    want = F.lead("at").over(Window.partitionBy("k").orderBy("at", "id"))
    assert got.withColumn("want", want).where(~F.col("nxt").eqNullSafe(F.col("want"))).count() == 0
    assert got.count() == 30_000


def test_next_in_time_of_no_rows_and_one_row(spark):
    one = spark.createDataFrame([(1, None, 5)], "k int, at timestamp_ntz, id int")
    assert [tuple(r) for r in ordered.next_in_time(one, ["k"], "at", "id", "n").collect()] == [(1, None, 5, None)]
    assert ordered.next_in_time(one.limit(0), ["k"], "at", "id", "n").count() == 0
