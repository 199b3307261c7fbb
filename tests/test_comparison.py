"""The table of a backtest beside a simulation: alignment by the delay, worst days, scoreboard."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import metrics
from tallgrass.plans import strategy
from tallgrass.sources import panels


def frame(spark, many=40):
    rows = [("A", "f", datetime(2024, 1, 1) + timedelta(k), 100.0 + (k * 7) % 11, 100.0, float((k % 5) - 2) / 2) for k in range(many)]
    return spark.createDataFrame(rows, "instrument_id string, factor_name string, time timestamp, open double, close double, factor_value double")


@pytest.mark.parametrize("delay", [0, 1, 2])
def test_alignment(spark, delay):
    df, account = frame(spark), strategy.Account(signal_delay=delay, slippage=0.0, fee_per_lot=0.0)
    log = strategy.simulate(df, account)
    out = strategy.comparison(metrics.daily(panels.future_return(df), fees=0.0), log, account).orderBy("time").collect()
    assert len(out) == log.count() - delay
    for r in out:
        assert (r["traded"] - r["time"]).days == delay and r["factor_diff"] == pytest.approx(0.0)
        if delay == 1 and r["bt_future_ret"] is not None:
            assert r["future_ret_diff"] == pytest.approx(0.0)  # both trade from tomorrow's open to the next
            assert abs(r["exposure_diff"]) < 0.01 and "exposure_mismatch" not in r["reasons"]


def test_worst_days_and_reasons(spark):
    df = frame(spark)
    account = strategy.Account(capital=1500.0)  # a lot costs a hundred of margin: signals below it trade nothing
    out = strategy.comparison(metrics.daily(panels.future_return(df)), strategy.simulate(df, account), account)
    board = {r["reason"]: r for r in strategy.scoreboard(out).collect()}
    assert set(board) <= set(strategy.REASONS) and board["exposure_mismatch"]["days"] > 0
    assert all(r["share"] == pytest.approx(r["days"] / out.count()) for r in board.values())
    worst = strategy.bad_cases(out, "all", 3).collect()
    assert [r["abs_net_ret_diff"] for r in worst] == sorted((r["abs_net_ret_diff"] for r in out.collect() if r["abs_net_ret_diff"] is not None), reverse=True)[:3]
    assert strategy.bad_cases(out, "bt_win_st_lose").where("bt_net_ret <= 0 or st_net_ret >= 0").isEmpty()
    with pytest.raises(ValueError):
        strategy.bad_cases(out, "none")
    total = strategy.comparison_summary(out).first()
    assert total["days"] == out.count() and total["gap"] == pytest.approx(out.agg(F.sum("bt_net_ret") - F.sum("st_net_ret")).first()[0])
