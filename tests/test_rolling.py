"""Sliding windows and exact quantiles against plain Python."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.operators import kpi, rolling, rules, signals

DAY = datetime.date(2020, 1, 1)


def test_windows_over_days_of_a_hot_key(spark, monkeypatch):
    """One key with most of the rows, a null key, days before 1970, gaps wider than a stretch."""
    monkeypatch.setattr(rolling, "STRETCH", 2)
    r = random.Random(1)
    rows = [(r.choice(["a"] * 8 + ["b", None]), DAY + datetime.timedelta(r.choice([r.randint(-40, 300), -20_000, 3_000])), float(r.randint(1, 9))) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, issue_date date, amount double")
    for first, last in ((0, 30), (-90, 0), (-3, 4)):
        days = rolling.daily(df, ["k"], {"n": F.count("*"), "amount": F.sum("amount")})
        found = rolling.over_days(days, ["k"], first, last, {"count": F.sum("n"), "total": F.sum("amount"), "end": F.max("day")})
        got = {(x.k, x.day): (x["count"], x.total, x.end) for x in found.collect()}
        number = lambda d: (d - datetime.date(1970, 1, 1)).days
        want = {}
        for k, d, _ in rows:
            inside = [(a, number(x)) for j, x, a in rows if j == k and first <= (x - d).days <= last]
            want[k, number(d)] = (len(inside), sum(a for a, _ in inside), max(x for _, x in inside))
        assert got == want


def test_no_task_of_a_window_holds_more_than_a_stretch(spark):
    df = spark.range(3_000).select(F.lit("hot").alias("k"), F.date_add(F.lit(DAY), (F.col("id") % 3_000).cast("int")).alias("issue_date"), F.lit(1.0).alias("amount"))
    days = rolling.daily(df, ["k"], {"n": F.count("*")})
    found = rolling.over_days(days, ["k"], 0, 10, {"m": F.sum("n")})
    assert "__at" in found._jdf.queryExecution().optimizedPlan().toString() and found.filter("m = 11").count() == 2_990
    width = 10 * rolling.STRETCH
    assert days.count() == 3_000 and width + 10 < 200


def test_bursts_and_splits_with_many_awards_a_day(spark):
    rows = [(f"x{i}", "o", "s", DAY + datetime.timedelta(i // 3 * 5), 100.0, "Procurement assignment", "ανάθεση") for i in range(60)]
    d = spark.createDataFrame(rows, "ada string, org string, supplier_tax_id string, issue_date date, amount double, decision_type string, subject string").withColumn("decision_type_raw", F.lit("Δ.1"))
    got = rules.split_awards(d, 1_000.0, 20).collect()
    brute = {a: (sum(p for _, _, _, y, p, *_ in rows if 0 <= (x - y).days <= 20), sum(0 <= (x - y).days <= 20 for _, _, _, y, *_ in rows)) for a, _, _, x, *_ in rows}
    assert {x.ada: (x.window_total, x.window_awards) for x in got} == {a: v for a, v in brute.items() if v[0] > 1_000}
    b = signals.award_burst(d, awards=9, days=10).first()
    assert b is None or (b.window_start, b.awards_in_window) == (DAY, 9)


@pytest.mark.parametrize("small", [rolling.SMALL, 3])
def test_quantiles_are_those_of_percentile(spark, monkeypatch, small):
    """Ties, outliers, tiny and huge values, groups of one, of nulls and of a null key; by refining ranges and in one task."""
    monkeypatch.setattr(rolling, "SMALL", small)
    r = random.Random(2)
    rows = [("wide", r.choice([-1e300, 1e300, 0.0, 1e-300, r.random(), 10.0 ** r.randint(-200, 200)])) for _ in range(300)]
    rows += [("ties", float(r.randint(1, 4))) for _ in range(501)] + [("even", float(i)) for i in range(1_000)] + [("one", 7.0), ("none", None), (None, 3.0), (None, 4.5), ("near", 1.0), ("near", float(np.nextafter(1.0, 2)))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.9, "q10": 1.0}
    want = {x.g: tuple(x[n] for n in at) for x in df.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in at.items()]).collect()}
    got = {x.g: tuple(x[n] for n in at) for x in rolling.quantiles(df, ["g"], "v", at).collect()}
    assert got == want
    whole = rolling.quantiles(df, [], "v", {"m": 0.5}).collect()
    assert [x.m for x in whole] == [df.select(F.percentile("v", F.lit(0.5))).first()[0]]
    assert [x.m for x in rolling.quantiles(df.filter("false"), [], "v", {"m": 0.5}).collect()] == [None]


def test_indicators_of_groups_with_nulls(spark):
    df = spark.createDataFrame([(None, 1.0, "o"), (None, 2.0, None), (1, None, "o"), (2, 5.0, "o")], "year int, delay double, org string").withColumns({"publish_ts": F.col("delay"), "month": F.lit(1)})
    got = {x.year: (x.decisions, x.median_delay, x.pct_no_org) for x in kpi.indicators(df, "year").collect()}
    assert got == {None: (2, 1.5, 50.0), 1: (1, None, 0.0), 2: (1, 5.0, 0.0)}
    assert [(x.decisions, x.median_delay) for x in kpi.indicators(df).collect()] == [(4, 2.0)]
