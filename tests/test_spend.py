"""Running spend and breaches when one tenant spends in a single minute."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarryline.operators import costs


def events_of(spark, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(1500):
        tenant = "hot" if i % 3 == 0 else f"t{draw.randrange(9)}"
        second = 3_000_000 if tenant == "hot" else draw.randrange(6_000_000)
        rows.append((i, tenant, second, Decimal(draw.randrange(1000)) / 10000))
    table = spark.createDataFrame(rows, "id long, tenant string, second long, cost_total_usd decimal(18,4)")
    return rows, table.select("id", "tenant", F.timestamp_seconds("second").alias("ts"), "cost_total_usd")


def plain(rows):
    burn, sums = {}, {}
    for i, tenant, second, cost in sorted(rows, key=lambda r: (r[2], r[0])):
        key = (tenant, 1 + (second >= 31 * 86400) + (second >= 59 * 86400))
        sums[key] = sums.get(key, 0) + cost
        burn[i] = (key, sums[key])
    return burn, sums


@pytest.mark.parametrize("size", [40, 100_000])
def test_running_spend_of_a_hot_minute(spark, monkeypatch, size):
    monkeypatch.setattr(costs, "EVENTS_PER_RANGE", size)
    rows, events = events_of(spark, size)
    burn, _ = plain(rows)
    got = {r.id: r.burn for r in costs.running_spend(events).collect()}
    assert got == {i: total for i, (_, total) in burn.items()}
    ranged = costs._ranged(events, "tenant").groupBy("_range", "tenant").count()
    if size == 40:
        hot = [r["count"] for r in ranged.filter("tenant = 'hot'").collect()]
        assert sum(hot) == 500 and max(hot) <= 120


@pytest.mark.parametrize("size", [40, 100_000])
def test_breaches_in_a_hot_minute(spark, monkeypatch, size):
    monkeypatch.setattr(costs, "EVENTS_PER_RANGE", size)
    rows, events = events_of(spark, 7)
    burn, sums = plain(rows)
    caps = {f"t{i}": Decimal(i) for i in range(8)} | {"hot": Decimal(20)}
    table = spark.createDataFrame([(t, c) for t, c in caps.items()], "tenant string, cap decimal(18,4)")
    first = {}
    for i, tenant, second, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        key, total = burn[i]
        if tenant in caps and total > caps[tenant]:
            first.setdefault(key, i)
    got = {(r.tenant, r.month.month): (r.spent, r.breach_id, r.breached) for r in costs.budget_breaches(events, table).collect()}
    assert got == {k: (v, first.get(k), k in first) for k, v in sums.items() if k[0] in caps}
    assert any(v[2] for v in got.values()) and not all(v[2] for v in got.values())
