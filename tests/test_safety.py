import datetime
import random

import pytest

from tidemark.operators.safety import Limits, safety_verdicts

AT = datetime.datetime(2024, 1, 1)


def plain(orders, limits):
    """The verdicts of one account's orders, one after another."""
    times, last, held, violations, out = [], {}, {}, 0, []
    for _, symbol, ts, _, price, qty, halted in orders:
        if violations >= limits.max_violations:
            verdict = "kill_switch"
        elif halted:
            verdict = "circuit_breaker"
        elif any(sum((ts - t).total_seconds() <= s for t in times) >= most for most, s in limits.rates):
            verdict = "rate_limit"
        elif symbol is None or (limits.symbols and symbol not in limits.symbols):
            verdict = "invalid_symbol"
        elif price is None or not limits.min_price <= price <= limits.max_price:
            verdict = "invalid_price"
        elif symbol in last and abs(price - last[symbol]) / last[symbol] > limits.max_change:
            verdict = "anomaly_detected"
        elif qty is None or not limits.min_qty <= qty <= limits.max_qty or price * qty > limits.max_notional:
            verdict = "invalid_quantity"
        elif held.get(symbol, 0) + price * qty > limits.max_position:
            verdict = "position_limit"
        else:
            verdict = "ok"
            times.append(ts)
            last[symbol] = price
            held[symbol] = held.get(symbol, 0) + price * qty
        violations += verdict not in ("ok", "kill_switch", "circuit_breaker", "rate_limit")
        out.append((verdict, violations))
    return out


@pytest.mark.parametrize("limits", [Limits(symbols=("a", "b"), max_violations=40), Limits(rates=((2, 1), (4, 10), (9, 60)), max_change=0.5, max_position=2e6)])
def test_verdicts_equal_a_plain_loop(spark, limits):
    rng = random.Random(5)
    rows = []
    for account in (1, 2, 3):
        ts = AT
        for i in range(300):
            ts += datetime.timedelta(seconds=rng.choice([0, 0, 1, 1, 3, 30, 4000]))
            price = rng.choice([100.0, 104.0, 96.0, 108.0, 150.0, 0.0, 2e6, None] if rng.random() < 0.3 else [100.0, 103.0])
            rows.append((account, rng.choice(["a", "b", "a", "b", "c", None]), ts, account * 1000 + i, price, rng.choice([1.0, 5.0, 99.0, 101.0, 0.0, None]), rng.random() < 0.03 or None))
    odd = [(None, "a", AT, 1, 1.0, 1.0, None), (1, "a", None, 2, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + odd, "account long, symbol string, ts timestamp, id long, price double, qty double, halted boolean").repartition(3)
    got = safety_verdicts(df, limits).orderBy("id").collect()
    want = [v for account in (1, 2, 3) for v in plain([r for r in rows if r[0] == account], limits)]
    assert [(r.verdict, r.violations) for r in got] == want
    assert len({v for v, _ in want}) >= 7
    assert safety_verdicts(df.drop("halted").limit(0)).count() == 0
