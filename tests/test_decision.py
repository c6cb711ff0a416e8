"""The search over markets against a plain one that tries every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from harvestry.config import GRADE_FACTOR, RISK_LAMBDA, STORAGE_COST, STORAGE_FACTOR
from harvestry.operators import decision, evaluate


def net(price, qty, days, market, grade, storage):
    if qty <= 0:
        return 0.0
    left = qty * math.exp(-0.006 * STORAGE_FACTOR[storage] * 1.08 * days)
    gross = price * left * GRADE_FACTOR[grade]
    return gross * (1 - sum(market[3:]) / 100) - left * 23 - math.ceil(left / 90) * market[1] * 42 - STORAGE_COST[storage] * qty * days - gross * (0.14 / 365) * days


def test_grid_finds_the_best_pair_of_all_markets(spark):
    rng = random.Random(7)
    markets = [(i, float(rng.choice((5, 20, 60, 90))), rng.uniform(900, 1400), *rng.choice(((3.0, 1.05, 0.3), (2.5, 1.5, 0.5)))) for i in range(12)]
    fan = {(m[0], d): (p * rng.uniform(0.7, 1.02), p, p * rng.uniform(1.0, 1.3)) for m in markets for d in (3, 7, 15) for p in (m[2] * rng.uniform(0.95, 1.2),)}
    lots = [(n, qty, grade, storage, risk, n == 3) for n, (qty, grade, storage, risk) in enumerate([(10.0, "A", "shed", "cautious"), (95.0, "B", "ambient", "balanced"), (200.0, "C", "cold_store", "aggressive"), (50.0, "A", "ambient", "cautious")])]
    m = spark.createDataFrame(markets, "mandi_id long, distance_km double, price_now double, commission_pct double, cess_pct double, other_pct double")
    f = spark.createDataFrame([(i, d, *q) for (i, d), q in fan.items()], "mandi_id long, days int, p10 double, p50 double, p90 double")
    found = decision.grid(spark.createDataFrame(lots, "lot_id long, qty double, grade string, storage string, risk string, shock_now boolean"), m, f, exposed=True)
    got = {(r[0], r[1], r[2]): (r[3], r[4]) for r in found.select("lot_id", "fraction", "days", "score", F.col("candidates")).collect()}
    want = {}
    for n, qty, grade, storage, risk, shock in lots:
        near = [x for x in markets if qty >= 22.5 or x[1] <= 40]
        for part in (0.0, 0.25, 0.5, 0.75, 1.0):
            for d in (3, 7, 15):
                if (shock and part < 1) or 1 - math.exp(-0.006 * STORAGE_FACTOR[storage] * 1.08 * d) > 0.15:
                    continue
                scores = []
                for b in near:
                    low, mid, high = fan[b[0], d]
                    if part < 0.5 and (high - low) / mid > 0.35:
                        continue
                    p50, p10 = (net(p, qty * (1 - part), d, b, grade, storage) for p in (mid, low))
                    scores += [net(a[2], qty * part, 0, a, grade, storage) + p50 - RISK_LAMBDA[risk] * max(0.0, p50 - p10) * (1 - part) for a in near]
                if scores:
                    want[n, part, d] = (pytest.approx(max(scores), abs=1e-6), len(scores))
    assert got == want


def test_lots_of_one_kind_are_searched_once(spark, monkeypatch):
    """Each lot gets what its kind alone gets, with a null grade too; the search sees a row for each kind, whatever the number of lots."""
    rng = random.Random(11)
    markets = spark.createDataFrame([(i, float(rng.choice((5, 20, 60))), rng.uniform(900, 1400), 2.5, 1.5, 0.5) for i in range(30)], "mandi_id long, distance_km double, price_now double, commission_pct double, cess_pct double, other_pct double").localCheckpoint()
    fan = evaluate.forecast_fan(markets.select("mandi_id", "price_now")).localCheckpoint()
    kinds = [(10.0, "A", "shed", "cautious", False), (95.5, None, "ambient", "balanced", False), (200.0, "C", "cold_store", "aggressive", True)]
    schema = "lot_id long, qty double, grade string, storage string, risk string, shock_now boolean"
    lots = lambda n: spark.createDataFrame([(k, *kinds[k % 3]) for k in range(n)], schema).localCheckpoint()
    seen, options = [], decision.holding_options
    monkeypatch.setattr(decision, "holding_options", lambda rows, cfg: seen.append(rows.count()) or options(rows, cfg))
    for search in (decision.recommend, lambda *a: decision.grid(*a, columns=["fraction", "days", "score", "candidates"])):
        few, many = (search(lots(n), markets, fan) for n in (3, 60))
        rest = [c for c in few.columns if c != "lot_id"]
        want = {}
        for r in few.collect():
            want.setdefault(r["lot_id"], []).append(tuple(r[c] for c in rest))
        got = {}
        for r in many.collect():
            got.setdefault(r["lot_id"], []).append(tuple(r[c] for c in rest))
        assert set(got) == set(range(60)) and all(sorted(got[k], key=str) == sorted(want[k % 3], key=str) for k in got)
    assert rest == ["qty", "grade", "storage", "fraction", "days", "score", "candidates"]
    assert seen == [3, 3, 3, 3]
