"""The auction against the kernel that compares all with all."""

import numpy as np
import pytest

from arealmap.kernels import assign
from arealmap.operators import auction


def table(spark, costs, map_id="a", holes=()):
    rows = [(map_id, i, j, float(c)) for (i, j), c in np.ndenumerate(costs) if (i, j) not in holes]
    return spark.createDataFrame(rows, "map_id string, i long, j long, cost double")


@pytest.mark.parametrize("n,m,block_rows", [(12, 12, 1 << 20), (12, 12, 40), (9, 30, 60), (1, 4, 10)])
def test_least_cost(spark, n, m, block_rows):
    """Whole costs with ties; in one block, and in several that meet by price."""
    costs = np.random.default_rng(n + m).integers(0, 40, (n, m))
    found = auction.auction(table(spark, costs), epsilon=0.9 / n, block_rows=block_rows).collect()
    assert sorted(r.i for r in found) == list(range(n)) and len({r.j for r in found}) == n
    assert sum(r.cost for r in found) == costs[np.arange(n), assign.least_cost(costs.astype(float))].sum()


def test_two_maps_and_proof(spark):
    """Maps apart in one table, pairs that are not allowed, repeated rows; the prices prove the totals."""
    rng = np.random.default_rng(8)
    one, two = rng.uniform(0, 1, (8, 8)), rng.uniform(0, 5, (5, 9))
    holes = {(i, j) for i in range(8) for j in range(8) if (i + j) % 5 == 3}
    both = table(spark, one, "one", holes).unionByName(table(spark, two, "two")).unionByName(table(spark, two[:2] + 1, "two"))
    found = auction.auction(both, epsilon=1e-3)
    assert not {(r.i, r.j) for r in found.where("map_id = 'one'").collect()} & holes
    allowed = np.where([[(i, j) in holes for j in range(8)] for i in range(8)], 1e3, one)
    least = {"one": allowed[np.arange(8), assign.least_cost(allowed)].sum(), "two": two[np.arange(5), assign.least_cost(two)].sum()}
    for r in auction.gap(both, found).collect():
        assert least[r.map_id] - 1e-9 <= r.cost <= least[r.map_id] + 9e-3 and -1e-9 <= r.gap <= 9e-3


def test_refused(spark):
    with pytest.raises(ValueError):
        auction.auction(table(spark, np.ones((3, 2))))
    with pytest.raises(Exception, match="of its own"):
        auction.auction(table(spark, np.ones((3, 3)), holes={(i, j) for i in range(3) for j in (1, 2) if i < 2} | {(2, 0)})).collect()
    assert auction.auction(spark.createDataFrame([], "i long, j long, cost double")).collect() == []
