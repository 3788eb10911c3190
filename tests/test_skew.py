"""Correctness when one state holds most of the rows (hot key), against pandas."""

from decimal import Decimal

import pandas as pd
import pytest

from qtrlens.operators import txn


def test_hot_state_benchmark_and_declines(spark):
    rows = [("HOT", 2020, q, f"t{i % 5}", 1, Decimal("10.00") + i % 7) for q in (1, 2, 3, 4) for i in range(5000)]
    rows += [(f"S{s}", 2020, q, "t0", 2, Decimal(50 + s * q)) for s in range(9) for q in (1, 2, 3, 4)]
    pdf = pd.DataFrame(rows, columns=["state", "year", "quarter", "transaction_type", "transaction_count",
                                      "transaction_amount"])
    t1 = spark.createDataFrame(rows, "state string, year smallint, quarter int, transaction_type string, "
                                     "transaction_count bigint, transaction_amount decimal(20,2)").repartition(8)
    got = {r["state"]: r for r in txn.state_benchmark(t1).collect()}
    totals = pdf.groupby("state")["transaction_amount"].sum()
    mean = float(totals.sum()) / len(totals)
    for state, amount in totals.items():
        assert got[state]["state_amount"] == amount
        assert got[state]["vs_national_pct"] == pytest.approx(round((float(amount) - mean) / mean * 100, 2), abs=0.006)
        assert got[state]["performance_flag"] == ("Above Average" if float(amount) > mean else "Below Average")
    assert got["HOT"]["state_count"] == 20000
