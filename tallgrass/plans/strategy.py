"""Trading simulation, next-day action and attribution of differences.

Equity depends on every day before, so each (instrument, factor) is one ordered group in Arrow batches; the
groups are what Spark spreads.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Account:
    capital: float = 1_000_000.0
    multiplier: int = 10
    margin_rate: float = 0.1
    fee_per_lot: float = 2.0
    slippage: float = 1.0
    min_open_ratio: float = 1.0
    signal_delay: int = 1


def target_lots(capital: float, factor: Column, price: Column, multiplier: int, min_open_ratio: float = 1.0) -> Column:
    """Lots for a position of factor times the capital: whole ones, and one more where the rest reaches the ratio."""
    raw = F.when(price > 0, F.try_divide(F.lit(capital) * factor, price * float(multiplier)))
    whole = F.when(raw >= 0, F.floor(raw)).otherwise(F.ceil(raw))
    rest = F.abs(raw - whole)
    extra = F.when((rest >= min_open_ratio) & (rest > 0), F.signum(raw)).otherwise(0.0)
    return F.coalesce((whole + extra).cast("long"), F.lit(0).cast("long"))


LOG = "instrument_id string, factor_name string, time timestamp, open double, next_open double, factor_value double, target_lots long, lots long, delta_lots long, fee double, slippage_cost double, open_to_open_pnl double, equity double, required_margin double, available_cash double, baseline_long_equity double, baseline_short_equity double, warning string"


def _simulate(options: dict):
    a = Account(**options)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("time")
        equity, lots = a.capital, 0
        base = [a.capital, a.capital]
        rows = []
        for r in group.itertuples(index=False):
            warning, price = [], r.open
            factor = 0.0 if r.factor_value is None or np.isnan(r.factor_value) else r.factor_value
            target, most = int(r.wanted), int(max(equity, 0.0) // (price * a.multiplier * a.margin_rate)) if price > 0 else 0
            if abs(target) > most:
                target = int(np.sign(target)) * most
                warning.append("margin")
            if target == 0 and factor:
                warning.append("below_one_lot")
            traded = abs(target - lots) if target * lots >= 0 else abs(target) + abs(lots)
            fee, slip, delta = traded * a.fee_per_lot, traded * a.slippage * a.multiplier, target - lots
            equity, lots = equity - fee - slip, target
            known = r.next_open is not None and r.next_open > 0
            move = (r.next_open - price) * a.multiplier if known else 0.0
            over = equity <= 0
            margin = 0.0 if over else abs(lots) * price * a.multiplier * a.margin_rate
            cash, pnl = equity - margin, 0.0 if over else lots * move
            if not over:
                equity += pnl
                base = [base[0] + r.long_lots * move, base[1] + r.short_lots * move]
                over = equity <= 0
                warning += ["equity_gone"] if over else []
            else:
                warning.append("equity_gone_by_costs")
            rows.append((r.instrument_id, r.factor_name, r.time, price, r.next_open, factor, int(r.wanted), lots, delta, fee, slip, pnl, equity, margin, cash, *base, ";".join(warning)))
            if over:
                break
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LOG.split(", ")])

    return run


def simulate(frame: DataFrame, account: Account = Account()) -> DataFrame:
    """Daily log of (instrument_id, factor_name, time, open, factor_value): lots at today's open from the delayed factor,
    capped by margin, costs per lot, profit from open to open; it ends where the equity is gone."""
    by = Window.partitionBy("instrument_id", "factor_name").orderBy("time")
    df = frame.select("instrument_id", "factor_name", "time", "open", (F.lag("factor_value", account.signal_delay).over(by) if account.signal_delay else F.col("factor_value")).alias("factor_value"), F.lead("open").over(by).alias("next_open"))
    lots = lambda f, p: target_lots(account.capital, f, p, account.multiplier, account.min_open_ratio)
    first = F.first("open").over(by)
    df = df.withColumns({"wanted": lots(F.col("factor_value"), F.col("open")), "long_lots": lots(F.lit(1.0), first), "short_lots": lots(F.lit(-1.0), first)})
    return df.groupBy("instrument_id", "factor_name").applyInPandas(_simulate(asdict(account)), LOG)


def action(now: Column, target: Column) -> Column:
    """HOLD, OPEN_, ADJUST_ or REVERSE_TO_ with the side."""
    side = lambda c: F.when(c > 0, "LONG").otherwise("SHORT")
    return (
        F.when(now == target, "HOLD")
        .when(now == 0, F.concat(F.lit("OPEN_"), side(target)))
        .when(((now > 0) & (target >= 0)) | ((now < 0) & (target <= 0)), F.concat(F.lit("ADJUST_"), side(now)))
        .otherwise(F.concat(F.lit("REVERSE_TO_"), side(target)))
    )


def freshness(panel: DataFrame, expected: date) -> DataFrame:
    """Per instrument the last day that is stored, and whether it is the expected one or later."""
    last = panel.groupBy("instrument_id").agg(F.to_date(F.max("time")).alias("latest_day"))
    return last.withColumn("expected_day", F.lit(expected)).withColumn("is_latest", F.coalesce(F.col("latest_day") >= F.col("expected_day"), F.lit(False)))


def monitor(frame: DataFrame, log: DataFrame, account: Account = Account()) -> DataFrame:
    """Per instrument and factor: the last day, its signal, lots held, lots wanted at the close, the action."""
    keys = ["instrument_id", "factor_name"]
    last = frame.groupBy(*keys).agg(F.max("time").alias("time"), F.max_by("factor_value", "time").alias("signal"), F.max_by("close", "time").alias("close"))
    held = log.groupBy(*keys).agg(F.max_by("lots", "time").alias("lots"))
    df = last.join(held, keys, "left").fillna(0, ["lots"])
    df = df.withColumn("target_lots", target_lots(account.capital, F.col("signal"), F.col("close"), account.multiplier, account.min_open_ratio))
    return df.withColumn("action", action(F.col("lots"), F.col("target_lots"))).withColumn("delta_lots", F.col("target_lots") - F.col("lots"))


def attribution(series: DataFrame, log: DataFrame, account: Account = Account(), tolerance: float = 1e-9) -> DataFrame:
    """Daily differences of a backtest's series and a simulation's log, aligned by the signal delay, with reasons."""
    keys = ["instrument_id", "factor_name"]
    by = Window.partitionBy(*keys).orderBy("time")
    a = series.withColumn("bt_position", F.lag("position", account.signal_delay).over(by) if account.signal_delay else F.col("position")).select(*keys, "time", "bt_position", "net_ret", "turnover")
    b = log.select(*keys, "time", "open", "lots", "target_lots", "fee", "slippage_cost", "open_to_open_pnl", "warning")
    exposure = F.col("lots") * F.col("open") * account.multiplier / account.capital
    df = a.join(b, [*keys, "time"]).withColumn("exposure", exposure).withColumn("exposure_diff", F.col("exposure") - F.col("bt_position"))
    df = df.withColumn("st_ret", (F.col("open_to_open_pnl") - F.col("fee") - F.col("slippage_cost")) / account.capital)
    reason = F.concat_ws("|", F.when(F.abs("exposure_diff") > tolerance, "rounding"), F.when(F.col("warning").contains("margin"), "margin"), F.when(F.col("warning").contains("below_one_lot"), "below_one_lot"), F.when((F.col("fee") + F.col("slippage_cost")) > 0, "costs"))
    return df.withColumn("reason", reason)


@dataclass(frozen=True)
class Tolerance:
    factor: float = 1e-6
    exposure: float = 0.05
    cost: float = 1e-4


# The reasons for a day's difference, in the order in which they are listed.
REASONS = ("factor_value_mismatch", "exposure_mismatch", "cost_model_gap", "ret_sign_mismatch", "position_direction_mismatch", "margin_constraint", "lot_size_floor", "strategy_terminated", "no_strong_signal")


def comparison(series: DataFrame, log: DataFrame, account: Account = Account(), tolerance: Tolerance = Tolerance()) -> DataFrame:
    """A backtest's daily series (bt_) beside a simulation's log (st_) of the same signal, with all differences and their reasons.

    The simulation trades a signal signal_delay days later: its columns are those of that row of the days that both have.
    Days whose trade lies beyond the last one are left out. Returns of the simulation are shares of the capital."""
    keys = ["instrument_id", "factor_name"]
    by = Window.partitionBy(*keys).orderBy("time")
    a = series.select(*keys, "time", *(F.col(c).alias(f"bt_{c}") for c in ("factor_value", "future_ret", "gross_ret", "net_ret", "turnover")))
    size, capital = float(account.multiplier), float(account.capital)
    c = F.col
    b = log.select(
        *keys, "time", c("factor_value").alias("st_factor_value"), (c("lots") * c("open") * size / capital).alias("st_exposure"), (F.try_divide(c("next_open"), c("open")) - 1).alias("st_future_ret"),
        (c("open_to_open_pnl") / capital).alias("st_gross_ret"), ((c("open_to_open_pnl") - c("fee") - c("slippage_cost")) / capital).alias("st_net_ret"), (F.abs("delta_lots") * c("open") * size / capital).alias("st_turnover"), "lots", "target_lots", "warning",
    )
    df = a.join(b, [*keys, "time"])
    aligned = ("st_factor_value", "st_exposure", "st_future_ret", "st_gross_ret", "st_net_ret", "st_turnover", "lots", "target_lots", "warning")
    if account.signal_delay:
        traded = F.lead(F.struct(c("time").alias("traded"), *aligned), account.signal_delay).over(by)
        df = df.withColumn("_later", traded).drop(*aligned).where("_later is not null").select("*", "_later.*").drop("_later")
    else:
        df = df.withColumn("traded", c("time"))
    sign = lambda x: F.signum(F.coalesce(c(x), F.lit(0.0)))
    df = df.withColumns({
        "future_ret_diff": c("bt_future_ret") - c("st_future_ret"), "gross_ret_diff": c("bt_gross_ret") - c("st_gross_ret"), "net_ret_diff": c("bt_net_ret") - c("st_net_ret"),
        "bt_cost": c("bt_gross_ret") - c("bt_net_ret"), "st_cost": c("st_gross_ret") - c("st_net_ret"), "factor_diff": c("bt_factor_value") - c("st_factor_value"), "exposure_diff": c("bt_factor_value") - c("st_exposure"),
        "sign_mismatch_future_ret": sign("bt_future_ret") != sign("st_future_ret"), "sign_mismatch_net_ret": sign("bt_net_ret") != sign("st_net_ret"),
        "sign_mismatch_factor": sign("bt_factor_value") != sign("st_factor_value"), "sign_mismatch_exposure": sign("bt_factor_value") != sign("st_exposure"),
        "bt_win_st_lose": F.coalesce((c("bt_net_ret") > 0) & (c("st_net_ret") < 0), F.lit(False)), "st_win_bt_lose": F.coalesce((c("st_net_ret") > 0) & (c("bt_net_ret") < 0), F.lit(False)),
    })
    df = df.withColumns({"abs_future_ret_diff": F.abs("future_ret_diff"), "abs_net_ret_diff": F.abs("net_ret_diff"), "cost_diff": c("bt_cost") - c("st_cost")})
    hits = (
        F.abs("factor_diff") > tolerance.factor, F.abs("exposure_diff") > tolerance.exposure, F.abs("cost_diff") > tolerance.cost, c("sign_mismatch_net_ret"), c("sign_mismatch_exposure"),
        c("warning").contains("margin"), c("warning").contains("below_one_lot"), c("warning").contains("equity_gone"),
    )
    found = F.concat_ws("|", *(F.when(hit, name) for hit, name in zip(hits, REASONS, strict=False)))
    return df.withColumn("reasons", F.when(found == "", REASONS[-1]).otherwise(found))


def scoreboard(compared: DataFrame) -> DataFrame:
    """Per reason its days, their share of all, and the mean and sum of the net returns' absolute differences on them."""
    total = compared.agg(F.count(F.lit(1)).alias("_all"))
    one = compared.select(F.explode(F.split("reasons", "[|]")).alias("reason"), "abs_net_ret_diff")
    df = one.groupBy("reason").agg(F.count(F.lit(1)).alias("days"), F.avg("abs_net_ret_diff").alias("mean_abs_diff"), F.sum("abs_net_ret_diff").alias("sum_abs_diff"))
    return df.crossJoin(F.broadcast(total)).select("reason", "days", (F.col("days") / F.col("_all")).alias("share"), "mean_abs_diff", "sum_abs_diff")  # one row


def bad_cases(compared: DataFrame, kind: str, n: int = 20) -> DataFrame:
    """The n days on which one wins and the other loses (bt_win_st_lose, st_win_bt_lose), or any, by the largest difference."""
    if kind not in ("bt_win_st_lose", "st_win_bt_lose", "all"):
        raise ValueError(f"unknown kind {kind}")
    rows = compared if kind == "all" else compared.where(kind)
    return rows.orderBy(F.desc_nulls_last("abs_net_ret_diff"), "instrument_id", "factor_name", "time").limit(n)


def comparison_summary(compared: DataFrame) -> DataFrame:
    """Per instrument and factor: summed net returns and their gap, correlation, shares of differing signs, days won by one and lost by the other."""
    share = lambda x: F.avg(F.col(x).cast("double"))
    return compared.groupBy("instrument_id", "factor_name").agg(
        F.count(F.lit(1)).alias("days"), F.sum("bt_net_ret").alias("bt_total"), F.sum("st_net_ret").alias("st_total"), (F.sum("bt_net_ret") - F.sum("st_net_ret")).alias("gap"), F.corr("bt_net_ret", "st_net_ret").alias("corr"),
        share("sign_mismatch_net_ret").alias("sign_mismatch_ratio"), F.count_if("bt_win_st_lose").alias("bt_win_st_lose_days"), F.count_if("st_win_bt_lose").alias("st_win_bt_lose_days"), F.avg("abs_net_ret_diff").alias("mean_abs_diff"),
    )
