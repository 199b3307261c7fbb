"""Backtest of formulas: panel to labelled long factors, daily series, summary and detail, in one plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators.compiler import evaluate_long
from ..sources.panels import PANEL, check_columns, check_keys, future_return, weighted_price


@dataclass(frozen=True)
class Options:
    fees: dict[str, float] | float = 0.0002
    interest: str = "simple"
    calmar: str = "reference"
    adjust: bool = False
    rollover_cost: bool = True
    baselines: bool = False
    method: str = "1D"


def labelled(panel: DataFrame, formulas: Mapping[str, str], options: Options = Options(), check: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """instrument_id, time, future_ret, optional is_rollover, factor_name, factor_value and more columns of the panel."""
    check_columns(panel, ("instrument_id", "time", *PANEL[:4]))
    if check:
        check_keys(panel)
    if options.adjust:
        panel = weighted_price(panel)
    panel = future_return(panel, options.method)
    keep = ["instrument_id", "time", "future_ret", *(["is_rollover"] if "is_rollover" in panel.columns else []), *more]
    return evaluate_long(panel, formulas, keep)


def backtest(panel: DataFrame, formulas: Mapping[str, str], options: Options = Options(), check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(summary, detail) of every formula on every instrument."""
    frame = labelled(panel, formulas, options, check)
    if options.baselines:
        frame = metrics.baselines(frame)
    series = metrics.daily(frame, options.fees, options.rollover_cost)
    return metrics.summary(series, options.interest, options.calmar, options.method), detail(series, options.interest)


def detail(series: DataFrame, interest: str = "simple") -> DataFrame:
    """Daily rows with net asset values and drawdowns."""
    keys = list(metrics.SERIES)
    method = "compound" if interest == "compound" else "simple"
    df = series.withColumns({f"{k}_nav": metrics.nav(series, f"{k}_ret", keys, method) for k in ("gross", "net")})
    run = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{k}_drawdown": 1 - F.try_divide(F.col(f"{k}_nav"), F.max(f"{k}_nav").over(run)) for k in ("gross", "net")})
