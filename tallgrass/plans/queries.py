"""Registered queries over the star-schema tables, each with the SQL that gives the same rows.

Outputs are rounded, since sums of doubles differ in their last bits between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators.compiler import evaluate
from ..sources import panels
from .backtest import Options, backtest, detail, labelled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; -0.0 is 0.0."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


PANEL_SQL = """panel AS (SELECT l_returnflag || l_linestatus AS instrument_id, l_shipdate AS time,
 first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, p) AS open, max(p) AS high, min(p) AS low,
 last(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, p) AS close, sum(l_quantity) AS volume, CAST(count(*) AS DOUBLE) AS position
 FROM (SELECT *, l_extendedprice % 1000 / 50 + 100 AS p FROM lineitem) GROUP BY 1, 2)"""
_W = "PARTITION BY instrument_id ORDER BY time"


def _f(n: int) -> str:
    return f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _g(x: str, n: int, value: str) -> str:
    """value where the last n rows all have x."""
    return f"CASE WHEN count({x}) {_f(n)} = {n} THEN {value} END"


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER ({_W})"


def _pair(x: str, y: str, n: int, value: str) -> str:
    return f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) {_f(n)} = {n} THEN {value} END"


def _corr(x: str, y: str, n: int) -> str:
    moves = " AND ".join(f"min({s}) {_f(n)} <> max({s}) {_f(n)}" for s in (x, y))
    return _pair(x, y, n, f"CASE WHEN {moves} THEN covar_samp({x}, {y}) {_f(n)} / (stddev_samp({x}) {_f(n)} * stddev_samp({y}) {_f(n)}) END")


def _ema(x: str, n: int) -> str:
    a = 2 / (n + 1)
    return f"list_reduce(list({x}) OVER ({_W} ROWS UNBOUNDED PRECEDING), lambda s, v: {a!r} * v + (1 - {a!r}) * s)"


N = 5
_shock = lambda x, n: f"{x} / nullif({_g(x, n, f'avg({x}) {_f(n)}')}, 0) - 1"
_ext = lambda f, o: _g("close", N, f"CAST(rn - (CASE " + " ".join(f"WHEN {_lag('close', k)} = {f}(close) {_f(N)} THEN rn - {k}" for k in range(1, N)) + " END) AS DOUBLE)").replace("(CASE WHEN", f"(CASE WHEN close = {f}(close) {_f(N)} THEN rn WHEN", 1)
_spread = "(high - low + 1e-8)"
_pct = lambda x, n: f"{x} / nullif({_lag(x, n)}, 0) - 1"

_L20 = f"list(close) {_f(20)}"
_WIDTH = f"((max(close) {_f(20)} - min(close) {_f(20)}) / 10)"
_BINS = f"list_transform({_L20}, lambda v: least(floor((v - min(close) {_f(20)}) / {_WIDTH}), 9))"
_RANKS = lambda x: f"list_transform(list({x}) {_f(N)}, lambda v: len(list_filter(list({x}) {_f(N)}, lambda u: u < v)) + (len(list_filter(list({x}) {_f(N)}, lambda u: u = v)) + 1) / 2 - {(N + 1) / 2})"
_DOT = lambda x, y: f"list_sum(list_transform(list_zip({_RANKS(x)}, {_RANKS(y)}), lambda z: z[1] * z[2]))"
_RANK_CORR = f"{_DOT('close', 'open')} / nullif(sqrt({_DOT('close', 'close')} * {_DOT('open', 'open')}), 0)"

# formula, its SQL over p (the panel with rn, the row's number, and day-to-day differences dc, dv, dp and ret)
FORMULAS: dict[str, tuple[str, str]] = {
    "field": ("close", "close"),
    "const": ("Add(Div(close, close), 3.5)", "close / close + 3.5"),
    "add": ("Add(open, close)", "open + close"),
    "nan_mean": ("NanMean(TsDelay(close, 2), TsDelay(open, 4), high)", f"list_avg(list_filter([{_lag('close', 2)}, {_lag('open', 4)}, high], lambda x: x IS NOT NULL))"),
    "sub": ("Sub(high, low)", "high - low"),
    "mul": ("Mul(close, Div(open, close))", "close * (open / close)"),
    "div": ("Div(close, Sub(high, open))", "close / nullif(high - open, 0)"),
    "max": ("Max(close, TsDelay(close, 1))", f"CASE WHEN {_lag('close', 1)} IS NOT NULL THEN greatest(close, {_lag('close', 1)}) END"),
    "min": ("Min(close, TsDelay(close, 1))", f"CASE WHEN {_lag('close', 1)} IS NOT NULL THEN least(close, {_lag('close', 1)}) END"),
    "neg": ("Neg(close)", "-close"),
    "sqrt_abs": ("SqrtAbs(Delta(close))", "sqrt(abs(dc))"),
    "abs": ("Abs(Delta(close))", "abs(dc)"),
    "inv": ("Inv(Delta(volume))", "1 / nullif(dv, 0)"),
    "sig": ("Sig(Delta(close))", "CASE WHEN dc IS NOT NULL THEN 1 / (1 + exp(-greatest(-50.0, least(50.0, dc)))) END"),
    "sign": ("Sign(Delta(close))", "CAST(sign(dc) AS DOUBLE)"),
    "lt": ("Lt(close, TsDelay(close, 1))", f"coalesce(CAST(close > {_lag('close', 1)} AS DOUBLE), 0)"),
    "gt": ("Gt(close, TsDelay(close, 1))", f"coalesce(CAST(close < {_lag('close', 1)} AS DOUBLE), 0)"),
    "if_else": ("IfElse(Gt(close, open), high, low)", "CASE WHEN close < open THEN high ELSE low END"),
    "body_ratio": ("BodyRatio(close)", f"(close - open) / {_spread}"),
    "upper_shadow_ratio": ("UpperShadowRatio(close)", f"(high - greatest(open, close)) / {_spread}"),
    "lower_shadow_ratio": ("LowerShadowRatio(close)", f"(least(open, close) - low) / {_spread}"),
    "stochastic_k": ("StochasticK(close)", f"(close - low) / {_spread}"),
    "typical_price": ("TypicalPrice(close)", "(high + low + close) / 3"),
    "delta": ("Delta(close)", "dc"),
    "ts_mean": ("TsMean(close, 5)", _g("close", N, f"avg(close) {_f(N)}")),
    "ts_std": ("TsStd(close, 5)", _g("close", N, f"stddev_samp(close) {_f(N)}")),
    "ts_delta": ("TsDelta(close, 5)", f"close - {_lag('close', 5)}"),
    "ts_pct_delta": ("TsPctDelta(volume, 5)", _pct("volume", 5)),
    "bias": ("Bias(close, 5)", _shock("close", N)),
    "range_position": ("RangePosition(close, 5)", f"(close - {_g('low', N, f'min(low) {_f(N)}')}) / ({_g('high', N, f'max(high) {_f(N)}')} - {_g('low', N, f'min(low) {_f(N)}')} + 1e-8)"),
    "price_acceleration": ("PriceAcceleration(close, 3)", f"(close - {_lag('close', 3)}) - ({_lag('close', 3)} - {_lag('close', 6)})"),
    "true_amplitude": ("TrueAmplitude(close, 1)", f"(high - low) / nullif({_lag('close', 1)}, 0)"),
    "return": ("Return(close, 3)", _pct("close", 3)),
    "log_return": ("LogReturn(close, 3)", f"ln(close) - ln({_lag('close', 3)})"),
    "volatility": ("Volatility(close, 5)", _g("ret", N, f"stddev_samp(ret) {_f(N)}")),
    "volume_std": ("VolumeStd(volume, 5)", _g("volume", N, f"stddev_samp(volume) {_f(N)}")),
    "volume_zscore": ("VolumeZScore(volume, 5)", f"(volume - {_g('volume', N, f'avg(volume) {_f(N)}')}) / nullif(stddev_samp(volume) {_f(N)}, 0)"),
    "turnover_shock": ("TurnoverShock(volume, 5)", _shock("volume", N)),
    "ts_delay": ("TsDelay(close, 5)", _lag("close", 5)),
    "ts_sum": ("TsSum(volume, 5)", _g("volume", N, f"sum(volume) {_f(N)}")),
    "ts_max": ("TsMax(close, 5)", _g("close", N, f"max(close) {_f(N)}")),
    "ts_min": ("TsMin(close, 5)", _g("close", N, f"min(close) {_f(N)}")),
    "ts_argmax": ("TsArgmax(close, 5)", _ext("max", 1)),
    "ts_argmin": ("TsArgmin(close, 5)", _ext("min", 1)),
    "ts_time_weighted_mean": ("TsTimeWeightedMean(close, 3)", f"(3 * close + 2 * {_lag('close', 1)} + {_lag('close', 2)}) / 6"),
    "ts_rank": ("TsRank(position, 5)", _g("position", N, f"(len(list_filter(list(position) {_f(N)}, lambda x: x < position)) + (len(list_filter(list(position) {_f(N)}, lambda x: x = position)) + 1) / 2) / {N}")),
    "ema": ("Ema(close, 5)", _ema("close", 5)),
    "ts_decay_exp": ("TsDecayExp(volume, 3)", _ema("volume", 3)),
    "roll_norm": ("RollNorm(close, 20, 10, 1e-6, 2)", f"CASE WHEN count(close) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 10 THEN greatest(-2.0, least(2.0, (close - avg(close) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) / (stddev_samp(close) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) + 1e-6))) END"),
    "ts_skew": ("TsSkew(close, 5)", _g("close", N, f"CASE WHEN min(close) {_f(N)} = max(close) {_f(N)} THEN 0 ELSE skewness(close) {_f(N)} END")),
    "ts_kurt": ("TsKurt(close, 5)", _g("close", N, f"CASE WHEN min(close) {_f(N)} = max(close) {_f(N)} THEN -3 ELSE kurtosis(close) {_f(N)} END")),
    "ma_ribbon": ("MaRibbon(close, 3, 5, 10)", "(greatest(m3, m5, m10) - least(m3, m5, m10)) / nullif(abs(list_avg(list_filter([m3, m5, m10], lambda x: x IS NOT NULL))), 0)"),
    "ts_corr": ("TsCorr(close, open, 5)", _corr("close", "open", N)),
    "ts_cov": ("TsCov(close, open, 5)", _pair("close", "open", N, f"covar_samp(close, open) {_f(N)}")),
    "ts_beta": ("TsBeta(close, open, 5)", _pair("close", "open", N, f"covar_samp(close, open) {_f(N)} / nullif(var_samp(open) {_f(N)}, 0)")),
    "vp_divergence": ("VpDivergence(close, volume, 5)", _corr("dc", "dv", N)),
    "amihud": ("Amihud(close, volume, 5)", _g("am", N, f"avg(am) {_f(N)} * 1e3")),
    "oi_trend_conviction": ("OiTrendConviction(close, position)", "sign(dc) * dp"),
    "ts_residual": ("TsResidual(close, open, 5)", _pair("close", "open", N, f"close - (regr_intercept(close, open) {_f(N)} + regr_slope(close, open) {_f(N)} * open)")),
    "ts_rank_corr": ("TsRankCorr(close, open, 5)", f"CASE WHEN rn >= {N} THEN {_RANK_CORR} END"),
    "ts_entropy": ("TsEntropy(close, 20)", f"CASE WHEN rn >= 20 THEN -list_sum(list_transform(list_distinct({_BINS}), lambda b: len(list_filter({_BINS}, lambda c: c = b)) / (20 * {_WIDTH}) * ln(len(list_filter({_BINS}, lambda c: c = b)) / (20 * {_WIDTH}) + 1e-10))) END"),
}
_STEPS = f"""q AS (SELECT *, row_number() OVER ({_W}) AS rn, close - {_lag('close', 1)} AS dc, volume - {_lag('volume', 1)} AS dv, position - {_lag('position', 1)} AS dp,
 {_pct('close', 1)} AS ret, abs(close - {_lag('close', 1)}) / nullif(close, 0) / nullif(volume, 0) AS am,
 {_g('close', 3, f'avg(close) {_f(3)}')} AS m3, {_g('close', 5, f'avg(close) {_f(5)}')} AS m5, {_g('close', 10, f'avg(close) {_f(10)}')} AS m10 FROM panel)"""
#: Scaled before rounding, so that small values keep their digits.
SCALE = {"amihud": 1e3}


def _formula_query(name: str, formula: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = evaluate(panels.lineitem_panel(spark, sf_dir), {"value": formula})
        return rounded(df.withColumn("value", F.col("value") * SCALE.get(name, 1.0)))

    return run


for _name, (_formula, _sql) in FORMULAS.items():
    query(f"f_{_name}", f"WITH {PANEL_SQL}, {_STEPS} SELECT instrument_id, time, round(CAST({_sql} AS DOUBLE), 6) + 0.0 AS value FROM q" if _sql else None)(_formula_query(_name, _formula))

# --- labels, daily series, metrics

SIGNAL = "RollNorm(TsDelta(close, 5), 20, 10, 1e-6, 2)"
TESTED = {"momentum": SIGNAL, "reversal": "Neg(StochasticK(close))"}
_LABEL = f"lab AS (SELECT *, lead(open, 2) OVER ({_W}) / nullif(lead(open, 1) OVER ({_W}), 0) - 1 AS future_ret FROM panel)"
_V = f"""{PANEL_SQL}, {_LABEL}, d5 AS (SELECT *, close - {_lag('close', 5)} AS d FROM lab),
 vals AS (SELECT instrument_id, time, future_ret, 'momentum' AS factor_name, CASE WHEN count(d) OVER w >= 10 THEN greatest(-2.0, least(2.0, (d - avg(d) OVER w) / (stddev_samp(d) OVER w + 1e-6))) END AS factor_value FROM d5
  WINDOW w AS ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT instrument_id, time, future_ret, 'reversal', -((close - low) / {_spread}) FROM lab),
 held AS (SELECT *, coalesce(last_value(factor_value IGNORE NULLS) OVER (PARTITION BY instrument_id, factor_name ORDER BY time ROWS UNBOUNDED PRECEDING), 0) AS position FROM vals),
 turn AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY instrument_id, factor_name ORDER BY time), 0)) AS turnover, position * coalesce(future_ret, 0) AS gross_ret FROM held),
 series AS (SELECT *, gross_ret - turnover * 0.0002 AS net_ret FROM turn)"""


@query("label", f"WITH {PANEL_SQL}, {_LABEL} SELECT instrument_id, time, round(future_ret, 6) + 0.0 AS future_ret FROM lab")
def label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panels.future_return(panels.lineitem_panel(spark, sf_dir)).select("instrument_id", "time", "future_ret"))


@query("weighted_price", f"WITH {PANEL_SQL} SELECT instrument_id, time, round(open * f, 6) AS open, round(close * f, 6) AS close FROM (SELECT *, CASE WHEN position = 3 THEN 1 ELSE position - 3 END AS f FROM panel)")
def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.lineitem_panel(spark, sf_dir).withColumn("weighted_factor", F.col("position") - 3)
    return rounded(panels.weighted_price(panel).select("instrument_id", "time", "open", "close"))


@query("daily_series", f"WITH {_V} SELECT instrument_id, factor_name, time, round(position, 6) + 0.0 AS position, round(turnover, 6) + 0.0 AS turnover, round(gross_ret, 6) + 0.0 AS gross_ret, round(net_ret, 6) + 0.0 AS net_ret FROM series")
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = labelled(panels.lineitem_panel(spark, sf_dir), TESTED, check=False)
    return rounded(metrics.daily(frame).select("instrument_id", "factor_name", "time", "position", "turnover", "gross_ret", "net_ret"))


@query("nav", f"""WITH {_V}, n AS (SELECT *, 1 + sum(gross_ret) OVER w AS gross_nav, 1 + sum(net_ret) OVER w AS net_nav FROM series WINDOW w AS (PARTITION BY instrument_id, factor_name ORDER BY time ROWS UNBOUNDED PRECEDING))
 SELECT instrument_id, factor_name, time, round(gross_nav, 6) + 0.0 AS gross_nav, round(net_nav, 6) + 0.0 AS net_nav, round(1 - net_nav / nullif(max(net_nav) OVER (PARTITION BY instrument_id, factor_name ORDER BY time ROWS UNBOUNDED PRECEDING), 0), 6) + 0.0 AS net_drawdown FROM n""")
def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = labelled(panels.lineitem_panel(spark, sf_dir), TESTED, check=False)
    return rounded(detail(metrics.daily(frame)).select("instrument_id", "factor_name", "time", "gross_nav", "net_nav", "net_drawdown"))


_KEY = "instrument_id, factor_name, year"
_SCOPED = f"""{_V}, whole AS (SELECT *, product(1 + gross_ret) OVER w AS vg, product(1 + net_ret) OVER w AS vn FROM series WINDOW w AS (PARTITION BY instrument_id, factor_name ORDER BY time ROWS UNBOUNDED PRECEDING)),
 sc AS (SELECT *, unnest([CAST(year(time) AS VARCHAR), 'all']) AS year, factor_value IS NOT NULL AND future_ret IS NOT NULL AS known FROM whole),
 own AS (SELECT *, product(1 + gross_ret) OVER w AS og, product(1 + net_ret) OVER w AS onet FROM sc WINDOW w AS (PARTITION BY {_KEY} ORDER BY time ROWS UNBOUNDED PRECEDING)),
 dd AS (SELECT *, 1 - og / nullif(max(og) OVER w, 0) AS dg, 1 - onet / nullif(max(onet) OVER w, 0) AS dn FROM own WINDOW w AS (PARTITION BY {_KEY} ORDER BY time ROWS UNBOUNDED PRECEDING)),
 rk AS (SELECT *, CASE WHEN known THEN rank() OVER (PARTITION BY {_KEY}, known ORDER BY factor_value NULLS FIRST) + (count(*) OVER (PARTITION BY {_KEY}, known, factor_value) - 1) / 2 END AS ra, CASE WHEN known THEN rank() OVER (PARTITION BY {_KEY}, known ORDER BY future_ret NULLS FIRST) + (count(*) OVER (PARTITION BY {_KEY}, known, future_ret) - 1) / 2 END AS rb FROM dd)"""
_C = lambda a, b: f"CASE WHEN min(CASE WHEN known THEN {a} END) <> max(CASE WHEN known THEN {a} END) AND min(CASE WHEN known THEN {b} END) <> max(CASE WHEN known THEN {b} END) THEN covar_samp({a}, {b}) FILTER (known) / (stddev_samp({a}) FILTER (known) * stddev_samp({b}) FILTER (known)) END"
_SUM = f"""{_SCOPED}, agg AS (SELECT {_KEY}, count(*) AS n, avg(turnover) AS t, {_C('factor_value', 'future_ret')} AS ic, {_C('ra', 'rb')} AS ric,
  avg(gross_ret) * 252 AS gr, avg(net_ret) * 252 AS nr, stddev_samp(gross_ret) * sqrt(252) AS gv, stddev_samp(net_ret) * sqrt(252) AS nv,
  stddev_samp(CASE WHEN gross_ret < 0 THEN gross_ret END) * sqrt(252) AS gd, stddev_samp(CASE WHEN net_ret < 0 THEN net_ret END) * sqrt(252) AS nd,
  max(dg) AS gm, max(dn) AS nm, avg(CAST(gross_ret > 0 AS INT)) AS gw, avg(CAST(net_ret > 0 AS INT)) AS nw,
  pow(max_by(vg, time) / CASE WHEN year = 'all' THEN 1 ELSE min_by(vg, time) END, 252.0 / count(*)) - 1 AS gcr, pow(max_by(vn, time) / CASE WHEN year = 'all' THEN 1 ELSE min_by(vn, time) END, 252.0 / count(*)) - 1 AS ncr FROM rk GROUP BY {_KEY}),
 ir AS (SELECT *, CASE WHEN year = 'all' THEN (avg(CASE WHEN year <> 'all' THEN ic END) OVER p) / (stddev_samp(CASE WHEN year <> 'all' THEN ic END) OVER p + 1e-6) END AS icir, CASE WHEN year = 'all' THEN (avg(CASE WHEN year <> 'all' THEN ric END) OVER p) / (stddev_samp(CASE WHEN year <> 'all' THEN ric END) OVER p + 1e-6) END AS ricir FROM agg WINDOW p AS (PARTITION BY instrument_id, factor_name))"""
_METRIC_SQL = {"Gross Return": "gr", "Net Return": "nr", "Gross Volatility": "gv", "Net Volatility": "nv", "Gross Sharpe": "gr / nullif(gv, 0)", "Net Sharpe": "nr / nullif(nv, 0)", "Gross Sortino": "CASE WHEN gd > 1e-12 THEN gr / gd END", "Net Sortino": "CASE WHEN nd > 1e-12 THEN nr / nd END", "Gross MaxDD": "gm", "Net MaxDD": "nm", "Gross Calmar": "gr / nullif(gv, 0)", "Net Calmar": "nr / nullif(nv, 0)", "Gross Win Rate": "gw", "Net Win Rate": "nw", "Turnover": "t", "TS IC": "ic", "TS RankIC": "ric", "TS ICIR": "icir", "TS RankICIR": "ricir", "T-corr": "CASE WHEN year = 'all' THEN n ELSE sqrt(n) END"}


def _slug(metric: str) -> str:
    return metric.lower().replace(" ", "_").replace("-", "_")


@query("flagship", f"WITH {_SUM} SELECT {_KEY}, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) + 0.0 AS {_slug(k)}" for k, v in _METRIC_SQL.items()) + ", 1 AS count FROM ir")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole metric table of two formulas on every instrument."""
    df = backtest(panels.lineitem_panel(spark, sf_dir), TESTED, check=False)[0]
    return rounded(df.select("instrument_id", "factor_name", "year", *(F.col(f"`{m}`").alias(_slug(m)) for m in metrics.DIRECTIONS), F.col("count").cast("int").alias("count")))


def _metric_query(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = backtest(panels.lineitem_panel(spark, sf_dir), TESTED, check=False)[0]
        return rounded(df.select("instrument_id", "factor_name", "year", F.col(f"`{metric}`").alias("value")))

    return run


for _metric, _sql in _METRIC_SQL.items():
    query(f"m_{_slug(_metric)}", f"WITH {_SUM} SELECT {_KEY}, round(CAST({_sql} AS DOUBLE), 6) + 0.0 AS value FROM ir")(_metric_query(_metric))


@query("m_compound_return", f"WITH {_SUM} SELECT {_KEY}, round(gcr, 6) + 0.0 AS gross_return, round(ncr, 6) + 0.0 AS net_return FROM ir")
def compound_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = backtest(panels.lineitem_panel(spark, sf_dir), TESTED, Options(interest="compound"), check=False)[0]
    return rounded(df.select("instrument_id", "factor_name", "year", F.col("`Gross Return`").alias("gross_return"), F.col("`Net Return`").alias("net_return")))


@query("m_true_calmar", f"WITH {_SUM} SELECT {_KEY}, round(CASE WHEN gm > 1e-12 THEN gr / gm END, 6) + 0.0 AS gross_calmar, round(CASE WHEN nm > 1e-12 THEN nr / nm END, 6) + 0.0 AS net_calmar FROM ir")
def true_calmar(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = backtest(panels.lineitem_panel(spark, sf_dir), TESTED, Options(calmar="true"), check=False)[0]
    return rounded(df.select("instrument_id", "factor_name", "year", F.col("`Gross Calmar`").alias("gross_calmar"), F.col("`Net Calmar`").alias("net_calmar")))
