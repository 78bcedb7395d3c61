"""Positions folded along fills that stream in order, against plain loops, and what their queries hold."""

import math
import random

import pytest
from conftest import DATA

from tidemark.operators import portfolio
from tidemark.plans import catalog


def looped(rows, averaged):
    out, q, entry, realised = [], 0.0, 0.0, 0.0
    for _, _, price, qty, side in sorted(rows, key=lambda r: r[1]):
        new = q + side * qty
        if q == 0 or (q > 0) == (side > 0) or (averaged and new != 0 and (new > 0) == (q > 0)):
            entry = (abs(q) * entry + qty * price) / (abs(q) + qty)
        else:
            realised += min(abs(q), qty) * math.copysign(1, q) * (price - entry)
            if new != 0 and (new > 0) == (side > 0):
                entry = price
        q = new
        out.append((q, entry, realised))
    return out


@pytest.mark.parametrize("mode", ["correct", "reference"])
def test_positions_equal_a_loop(spark, mode):
    random.seed(5)
    rows = [(k, i, random.uniform(1, 9), float(random.randint(1, 4)), random.choice([1.0, -1.0])) for k, n in (("a", 3000), ("b", 1), (None, 40)) for i in range(n)]
    random.shuffle(rows)
    odd = [("a", 5, 1.0, 0.0, 1.0), ("a", 6, None, 1.0, 1.0), ("a", 7, 2.0, None, -1.0), ("b", 0, 2.0, 1.0, None), ("c", 1, 2.0, -1.0, 1.0)]
    fills = spark.createDataFrame(rows + odd, "symbol string, open_time long, price double, qty double, side double").repartition(7)
    states, last = portfolio.positions(fills, mode).collect(), {r.symbol: r for r in portfolio.last_positions(fills, mode).collect()}
    assert set(last) == {"a", "b", None}
    for k in last:
        want = looped([r for r in rows if r[0] == k], mode == "reference")
        got = [tuple(r.state) for r in sorted((r for r in states if r.symbol == k), key=lambda r: r.open_time)]
        assert len(got) == len(want) == last[k].fills
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
        assert tuple(last[k].state) == got[-1]


@pytest.mark.parametrize("name", ["position_fold", "position_fold_averaged"])
def test_no_history_is_gathered(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan
