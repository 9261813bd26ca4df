"""Least-cost assignment by auction, with bids and prices as tables.

Each i bids for the j that is worth most to it at the going prices, and raises its
price by what the next best is worth less, and a little more (epsilon).  A round
deals the i without a j over blocks; a block holds their options alone and
auctions among its own until each has one; then blocks meet by j, where the
highest price wins and the others go on without.  A winner's choice stays right when
other prices rise, so the sum is within epsilon for each i of the least one; with whole
costs and epsilon under 1 / n it is the least.

Where there are as many j as i, epsilon starts large and falls phase by phase, on
the prices that are there.  With more j than i all prices start at nothing and there is one
phase, since a j that nobody takes must not have got dear before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adjacency import _kept

#: Options that a block holds, more only where a single i has more.
BLOCK_ROWS = 1 << 20
#: What epsilon falls by from phase to phase.
FALL = 5.0


def _block(rows: pd.DataFrame, epsilon: float, most: float, limit: float) -> list[tuple[int, float, int]]:
    """(j, price, owner) of an auction among the rows' own i, from the prices that they have."""
    rows = rows.sort_values(["i", "j"])
    who, first = np.unique(rows["i"].to_numpy(), return_index=True)
    goods, at = np.unique(rows["j"].to_numpy(), return_inverse=True)
    price = np.zeros(len(goods))
    price[at] = rows["price"].to_numpy(float)
    ends, worth = np.append(first[1:], len(rows)), -rows["cost"].to_numpy(float)
    owner, free = np.full(len(goods), -1), list(range(len(who)))
    while free:
        k = free.pop()
        options = at[first[k] : ends[k]]
        value = worth[first[k] : ends[k]] - price[options]
        best = int(value.argmax())
        top, j = value[best], options[best]
        value[best] = -np.inf
        # Somebody with one option left offers all that the costs can justify.
        next_ = value.max() if len(value) > 1 else top - most
        price[j] += top - next_ + epsilon
        if price[j] > limit:
            raise ValueError("no assignment gives every i a j of its own")
        if owner[j] >= 0:
            free.append(owner[j])
        owner[j] = k
    taken = np.flatnonzero(owner >= 0)
    return [(int(goods[j]), float(price[j]), int(who[owner[j]])) for j in taken]


def _bids(epsilon: float, most: float, limit: float):
    def run(key, rows):
        return pd.DataFrame([(key[0], *x) for x in _block(rows, epsilon, most, limit)], columns=["map_id", "j", "price", "owner"])

    return run


def auction(costs: DataFrame, epsilon: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(map_id, i, j, cost, price) of least total cost within ``epsilon`` for each i; of costs (map_id, i, j, cost), where a pair without a cost is not allowed.

    ``epsilon`` is a thousandth of the spread of costs if not given.
    """
    held = costs.select(F.col("map_id").cast("string") if "map_id" in costs.columns else F.lit("map").alias("map_id"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("cost").cast("double").alias("cost"))
    held = _kept(held.groupBy("map_id", "i", "j").agg(F.min("cost").alias("cost")))
    ids, goods = held.select("map_id", "i").distinct(), held.select("map_id", "j").distinct()
    counts = ids.groupBy("map_id").agg(F.count("*").alias("n")).join(goods.groupBy("map_id").agg(F.count("*").alias("m")), "map_id")
    worst = counts.agg(F.max(F.col("n") - F.col("m")), F.min(F.col("n") - F.col("m")), F.max("n")).first()
    if worst[0] is None:
        return held.withColumn("price", F.lit(0.0))
    if worst[0] > 0:
        raise ValueError("a map has fewer j than i")
    low, high = held.agg(F.min("cost"), F.max("cost")).first()
    most = max(high - low, 1e-12)
    last = epsilon or most / 1000
    steps = [last]
    while worst[0] == worst[1] == 0 and steps[-1] * FALL < most / 4:
        steps.append(steps[-1] * FALL)
    shape = "map_id string, j long, price double, owner long"
    prices = held.sparkSession.createDataFrame([], shape)
    # No price that leads to an assignment is above this.
    limit = len(steps) * (2 * worst[2] + 2) * (most + max(steps))
    for step in reversed(steps):
        # A phase begins with everybody free, at the prices of the one before.
        prices, turn = prices.withColumn("owner", F.lit(None).cast("long")), 0
        while True:
            owners = prices.where("owner is not null").select("map_id", F.col("owner").alias("i"))
            open_ = held.join(owners, ["map_id", "i"], "left_anti")
            n = open_.count()
            if not n:
                break
            asked = open_.join(prices.select("map_id", "j", "price"), ["map_id", "j"], "left").withColumn("price", F.coalesce("price", F.lit(0.0)))
            asked = asked.withColumn("block", F.pmod(F.xxhash64("i", F.lit(turn)), F.lit(max(1, -(-n // block_rows)))))
            bids = asked.groupBy("map_id", "block").applyInPandas(_bids(step, most, limit), shape)
            # Of equal prices what was there before stays, else the smaller i.
            ranked = prices.withColumn("new", F.lit(0)).unionByName(bids.withColumn("new", F.lit(1)))
            top = F.max_by(F.struct("price", "owner"), F.struct("price", -F.col("new"), -F.coalesce("owner", F.lit(0)))).alias("t")
            prices, turn = _kept(ranked.groupBy("map_id", "j").agg(top).select("map_id", "j", "t.price", "t.owner")), turn + 1
    found = prices.where("owner is not null").select("map_id", F.col("owner").alias("i"), "j", "price")
    return held.join(found, ["map_id", "i", "j"])

def gap(costs: DataFrame, assigned: DataFrame) -> DataFrame:
    """(map_id, cost, gap): the total, and how far at most it is above the least one, as the prices prove."""
    priced = costs.join(assigned.select("map_id", "j", "price"), ["map_id", "j"], "left")
    least = priced.groupBy("map_id", "i").agg(F.min(F.col("cost") + F.coalesce("price", F.lit(0.0))).alias("v")).groupBy("map_id").agg(F.sum("v").alias("v"))
    paid = assigned.groupBy("map_id").agg(F.sum("cost").alias("cost"), F.sum("price").alias("p"))
    return paid.join(least, "map_id").select("map_id", "cost", (F.col("cost") - (F.col("v") - F.col("p"))).alias("gap"))
