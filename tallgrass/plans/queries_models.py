"""Registered queries of refinement and models: gradients against finite differences, fits against closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import parse
from ..functions import metrics
from ..operators.compiler import evaluate
from ..sources import panels
from . import fusion, learning, mining, refine, select, strategy
from .backtest import Options, backtest
from .boosting import HistogramBoosting
from .queries import _LABEL, _V, PANEL_SQL, TESTED, query, rounded
from .queries_more import _LOG, _simulated

_I = "PARTITION BY instrument_id ORDER BY time"
_REFINED = "Sub(TsPctDelta(close, 5), TsPctDelta(open, 10))"
_SEARCH = mining.Search(fitness={"TS IC": 1.0, "Gross Return": 0.1})


def _scored(points: list[tuple]) -> str:
    """SQL of the score at points (key, weight and window of either operand): the formula's soft mixes of three windows,
    normalised by the 60 rows before."""
    mix = lambda x, u, n: f"({' + '.join(f'exp(-pow({c} - {u}, 2)) * {x}{c}' for c in (n - 1, n, n + 1))}) / ({' + '.join(f'exp(-pow({c} - {u}, 2))' for c in (n - 1, n, n + 1))})"
    values = ", ".join(f"({', '.join(map(repr, p))})" for p in points)
    moves = ", ".join(f"{c} / lag({c}, {n}) OVER ({_I}) - 1 AS {a}{n}" for c, a, near in (("close", "a", (4, 5, 6)), ("open", "b", (9, 10, 11))) for n in near)
    return f"""{PANEL_SQL}, {_LABEL}, moves AS (SELECT instrument_id, time, CASE WHEN future_ret IS NOT NULL THEN greatest(-1, least(1, future_ret)) END AS y, {moves} FROM lab),
 points(k, wa, ua, wb, ub) AS (VALUES {values}),
 raw AS (SELECT k, instrument_id, time, y, wa * {mix('a', 'ua', 5)} - wb * {mix('b', 'ub', 10)} AS x FROM moves, points),
 normed AS (SELECT k, instrument_id, time, y, CASE WHEN x IS NOT NULL AND count(x) OVER w >= 20 THEN greatest(-3.0, least(3.0, (x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-6))) END AS f FROM raw WINDOW w AS (PARTITION BY k, instrument_id ORDER BY time ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
 used AS (SELECT *, count(*) OVER (PARTITION BY k, instrument_id) AS n FROM normed WHERE f IS NOT NULL AND y IS NOT NULL),
 years AS (SELECT k, instrument_id, year(time) AS year, coalesce(CASE WHEN stddev_samp(f) > 1e-12 AND stddev_samp(y) > 1e-12 THEN corr(f, y) END, 0) + 0.1 * avg(f * y) * 252 AS s FROM used WHERE n >= 50 GROUP BY 1, 2, 3),
 scores AS (SELECT k, avg(s) AS s FROM years GROUP BY 1)"""


_H = 1e-5
# the parameters in the order of the tree: window and weight of the first operand, then of the second
_MOVES = [(f"{k}{sign}", *(v + (step if j == k else 0.0) for j, v in ((1, 1.0), (0, 5.0), (3, 1.0), (2, 10.0)))) for k in range(4) for sign, step in (("+", _H), ("-", -_H))]


@query("refinement_gradients", f"""WITH {_scored([('base', 1.0, 5.0, 1.0, 10.0), *_MOVES])},
 slopes AS (SELECT CAST(up.k[1] AS INT) AS place, (up.s - down.s) / {2 * _H!r} AS slope FROM scores up JOIN scores down ON up.k[1] = down.k[1] AND up.k[2] = '+' AND down.k[2] = '-')
 SELECT place, round(slope, 3) + 0.0 AS slope, round((SELECT s FROM scores WHERE k = 'base'), 5) AS score FROM slopes""")
def refinement_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of a formula with soft windows, and its derivative by each weight and window."""
    how = refine.Refine(radius=1)
    found = refine.gradients(panels.lineitem_panel(spark, sf_dir), {"f": refine.Parametric(parse(_REFINED), how)}, _SEARCH, how)
    return found.where("place >= 0").select("place", (F.round("slope", 3) + 0.0).alias("slope"), F.round("score", 5).alias("score"))


def _hard() -> str:
    """The search's fitness of two formulas before refinement: either sign, less the penalty for depth."""
    f = {"TsPctDelta(close, 3)": ("close / lag(close, 3) OVER w - 1", 2), _REFINED: ("close / lag(close, 5) OVER w - 1 - (open / lag(open, 10) OVER w - 1)", 3)}
    raw = " UNION ALL ".join(f"SELECT '{k}' AS k, {d} AS depth, instrument_id, time, CASE WHEN future_ret IS NOT NULL THEN greatest(-1, least(1, future_ret)) END AS y, {x} AS x FROM lab WINDOW w AS ({_I})" for k, (x, d) in f.items())
    return f"""{PANEL_SQL}, {_LABEL}, raw AS ({raw}),
 normed AS (SELECT k, depth, instrument_id, time, y, CASE WHEN x IS NOT NULL AND count(x) OVER w >= 20 THEN greatest(-3.0, least(3.0, (x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-6))) END AS f FROM raw WINDOW w AS (PARTITION BY k, instrument_id ORDER BY time ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
 used AS (SELECT *, count(*) OVER (PARTITION BY k, instrument_id) AS n FROM normed WHERE f IS NOT NULL AND y IS NOT NULL),
 years AS (SELECT k, depth, instrument_id, year(time) AS year, coalesce(CASE WHEN stddev_samp(f) > 1e-12 AND stddev_samp(y) > 1e-12 THEN corr(f, y) END, 0) + 0.1 * avg(f * y) * 252 AS s FROM used WHERE n >= 50 GROUP BY 1, 2, 3, 4)
 SELECT k AS formula, round(abs(avg(s)) - 0.001 * any_value(depth), 5) AS fitness_before, true AS not_below FROM years GROUP BY k"""


@query("refined_factors", f"WITH {_hard()}")
def refined_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two formulas refined: their fitness before, and that it is not below after."""
    panel = panels.lineitem_panel(spark, sf_dir).persist()
    before = mining.fitness(panel, [parse(_REFINED), parse("TsPctDelta(close, 3)")], _SEARCH)
    after = refine.refined(panel, before, _SEARCH, refine.Refine(steps=8))
    panel.unpersist()
    return spark.createDataFrame([(f, round(v, 5), after[f][1] >= v) for f, (v, _) in before.items()], "formula string, fitness_before double, not_below boolean")


# --- rolling linear models: all splits and penalties from monthly sums

_FIT = """(SELECT {by}, n, my - w1 * m1 - w2 * m2 AS b, w1, w2 FROM (SELECT *, (c1 * a22 - c2 * a12) / (a11 * a22 - a12 * a12) AS w1, (c2 * a11 - c1 * a12) / (a11 * a22 - a12 * a12) AS w2 FROM
 (SELECT {by}, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) * (1 + any_value(ridge)) AS a11, var_pop(x2) * (1 + any_value(ridge)) AS a22, covar_pop(x1, x2) AS a12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM rows JOIN tried ON m >= a AND m < {end} GROUP BY ALL)))"""


@query("rolling_model", f"""WITH {_V}, rows AS (SELECT instrument_id, time, max(factor_value) FILTER (factor_name = 'momentum') AS x1, max(factor_value) FILTER (factor_name = 'reversal') AS x2, any_value(future_ret) AS y, year(time) * 12 + month(time) AS m FROM vals GROUP BY instrument_id, time HAVING x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL),
 spans AS (SELECT a, a + 18 AS b, a + 24 AS c, least(a + 30, last + 1) AS d FROM (SELECT unnest(generate_series(min(m), max(m) - 24, 6)) AS a, max(m) AS last FROM rows)),
 choices(choice, ridge) AS (VALUES (0, 0.0), (1, 0.1), (2, 5.0)), tried AS (SELECT * FROM spans, choices),
 scored AS (SELECT f.a, f.choice, time, f.b + w1 * x1 + w2 * x2 AS p, y FROM {_FIT.format(by='a, choice', end='b')} f JOIN spans ON spans.a = f.a JOIN rows ON m >= spans.b AND m < spans.c),
 ranked AS (SELECT *, rank() OVER (PARTITION BY a, choice, time ORDER BY p) + (count(*) OVER (PARTITION BY a, choice, time, p) - 1) / 2 AS r1, rank() OVER (PARTITION BY a, choice, time ORDER BY y) + (count(*) OVER (PARTITION BY a, choice, time, y) - 1) / 2 AS r2 FROM scored),
 ics AS (SELECT a, choice, time, CASE WHEN min(p) <> max(p) AND min(y) <> max(y) THEN corr(r1, r2) END AS ic FROM ranked GROUP BY 1, 2, 3),
 best AS (SELECT a, first(choice ORDER BY ic DESC, choice) AS choice FROM (SELECT a, choice, round(avg(ic), 12) AS ic FROM ics GROUP BY 1, 2) GROUP BY a),
 final AS (SELECT f.*, spans.c AS lo, spans.d AS hi FROM {_FIT.format(by='a, choice', end='c')} f JOIN best ON best.a = f.a AND best.choice = f.choice JOIN spans ON spans.a = f.a)
 SELECT instrument_id, time, round(b + w1 * x1 + w2 * x2, 6) + 0.0 AS prediction FROM rows JOIN final ON m >= lo AND m < hi""")
def rolling_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.future_return(panels.lineitem_panel(spark, sf_dir))
    df = evaluate(panel, {"x1": TESTED["momentum"], "x2": TESTED["reversal"]}, ["instrument_id", "time", "future_ret"])
    made = learning.rolling_linear(df, ["x1", "x2"], [0.0, 0.1, 5.0], train=18, validate=6, test=6)
    return rounded(made.select("instrument_id", "time", "prediction"))


# --- two boosted stumps on whole numbers, whose quantiles are values that repeat

_EDGES = "[1/6, 2/6, 3/6, 4/6, 5/6]"


def _stump(k: int, before: str) -> str:
    """One round: of all edges the split with the best gain (first feature, lowest edge), and the new predictions."""
    return f"""t{k} AS (SELECT e.f, e.e, sum(pred - y) FILTER (x <= e) AS lg, count(*) FILTER (x <= e) AS ln, sum(pred - y) AS g, count(*) AS n FROM (SELECT 0 AS f, x0 AS x, y, pred FROM {before} UNION ALL SELECT 1, x1, y, pred FROM {before}) r JOIN edges e ON e.f = r.f GROUP BY 1, 2),
 s{k} AS (SELECT *, pow(lg, 2) / (ln + 1) + pow(g - lg, 2) / (n - ln + 1) - pow(g, 2) / (n + 1) AS gain FROM t{k} WHERE ln >= 20 AND n - ln >= 20 ORDER BY round(gain, 9) DESC, f, e LIMIT 1),
 p{k} AS (SELECT instrument_id, time, x0, x1, y, pred - 0.5 * CASE WHEN CASE WHEN s.f = 0 THEN x0 ELSE x1 END <= s.e THEN lg / (ln + 1) ELSE (g - lg) / (n - ln + 1) END AS pred FROM {before}, s{k} s)"""


@query("boosted_stumps", f"""WITH {PANEL_SQL}, p0 AS (SELECT instrument_id, time, position AS x0, floor(volume / 40) AS x1, high - low AS y, avg(high - low) OVER () AS pred FROM panel),
 edges AS (SELECT DISTINCT f, e FROM (SELECT 0 AS f, unnest(quantile_disc(x0, {_EDGES})) AS e FROM p0 UNION ALL SELECT 1, unnest(quantile_disc(x1, {_EDGES})) FROM p0)),
 {_stump(1, 'p0')}, {_stump(2, 'p1')} SELECT instrument_id, time, round(pred, 5) AS prediction FROM p2""")
def boosted_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of boosting with trees of one split: the day's range of prices by its number of bars and volume."""
    df = panels.lineitem_panel(spark, sf_dir).select("instrument_id", "time", F.array("position", F.floor(F.col("volume") / 40).cast("double")).alias("_x"), (F.col("high") - F.col("low")).alias("future_ret"))
    model = HistogramBoosting(trees=2, depth=1, leaves=2, bins=6, rate=0.5).fit(df)
    return model.transform(df).select("instrument_id", "time", F.round("prediction", 5).alias("prediction"))


_MANY = {"d3": "TsDelta(close, 3)", "d5": "TsDelta(close, 5)", "rev": TESTED["reversal"]}
_STORED = {"d5o": "TsDelta(open, 5)", "d3o": "TsDelta(open, 3)", "v": "volume"}


@query("rank_matrix", f"""WITH {PANEL_SQL}, x AS (SELECT close - lag(close, 3) OVER w AS d3, close - lag(close, 5) OVER w AS d5, -((close - low) / (high - low + 1e-8)) AS rev, open - lag(open, 5) OVER w AS d5o, open - lag(open, 3) OVER w AS d3o, volume AS v FROM panel WINDOW w AS ({_I})),
 p AS ({' UNION ALL '.join(f"SELECT '{a}' AS factor_name, '{b}' AS other, {a} AS x, {b} AS y FROM x WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in _MANY for b in _STORED)}),
 k AS (SELECT *, rank() OVER (PARTITION BY factor_name, other ORDER BY x) + (count(*) OVER (PARTITION BY factor_name, other, x) - 1) / 2 AS a, rank() OVER (PARTITION BY factor_name, other ORDER BY y) + (count(*) OVER (PARTITION BY factor_name, other, y) - 1) / 2 AS b FROM p)
 SELECT factor_name, other, round(abs(corr(a, b)), 6) AS spearman FROM k GROUP BY 1, 2""")
def rank_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of all pairs of new and stored factors, with three patterns of missing values among them."""
    return rounded(select.spearman(panels.lineitem_panel(spark, sf_dir), _MANY, _STORED))


# --- labels of longer periods

_MONTHLY = f"""{PANEL_SQL}, ends AS (SELECT *, first_value(open) OVER (PARTITION BY instrument_id ORDER BY time RANGE BETWEEN INTERVAL 1 MONTH FOLLOWING AND INTERVAL 2 MONTH FOLLOWING) AS later FROM panel),
 lab AS (SELECT *, lead(later) OVER ({_I}) / nullif(lead(open) OVER ({_I}), 0) - 1 AS future_ret FROM ends)"""


@query("monthly_label", f"WITH {_MONTHLY} SELECT instrument_id, time, round(future_ret, 6) + 0.0 AS future_ret FROM lab")
def monthly_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panels.future_return(panels.lineitem_panel(spark, sf_dir), "1M").select("instrument_id", "time", "future_ret"))


@query("monthly_t_corr", f"""WITH {_MONTHLY}, r AS (SELECT instrument_id, CAST(year(time) AS VARCHAR) AS year, -((close - low) / (high - low + 1e-8)) AS f, future_ret FROM lab),
 s AS (SELECT * FROM r UNION ALL SELECT instrument_id, 'all', f, future_ret FROM r)
 SELECT instrument_id, year, round(CASE WHEN year = 'all' THEN count(*) / 30.0 ELSE sqrt(count(*) / 30.0) END, 6) AS t_corr, round(corr(f, future_ret), 6) + 0.0 AS ts_ic FROM s GROUP BY 1, 2""")
def monthly_t_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = backtest(panels.lineitem_panel(spark, sf_dir), {"reversal": TESTED["reversal"]}, Options(method="1M"), check=False)[0]
    return rounded(df.select("instrument_id", "year", F.col("T-corr").alias("t_corr"), F.col("TS IC").alias("ts_ic")))


# --- fusion: the greedy path over the scores of all sets of four candidates

_CANDIDATES = {"a": TESTED["momentum"], "b": TESTED["reversal"], "c": "Neg(TsRank(close, 5))", "d": "Neg(Bias(close, 5))"}
_SETS = [m for m in range(1, 16)]


def _fusion(share: float, cut: str) -> str:
    """Scores of every set of candidates, by their mean, before a day and from it on; then the best addition round by round."""
    mean = lambda m: f"({' + '.join(f'coalesce({c}, 0)' for k, c in enumerate('abcd') if m >> k & 1)}) / nullif({' + '.join(f'CAST({c} IS NOT NULL AS INT)' for k, c in enumerate('abcd') if m >> k & 1)}, 0)"
    sets = " UNION ALL ".join(f"SELECT {m} AS mask, instrument_id, time, future_ret, {mean(m)} AS f FROM wide" for m in _SETS)
    one = lambda r, before: f"""r{r} AS (SELECT {r} AS round, n.name, n.bit, s.mask, s.s FROM {before} p JOIN names n ON (p.mask & n.bit) = 0 JOIN total s ON s.mask = p.mask + n.bit WHERE s.s > p.s ORDER BY s.s DESC, n.name LIMIT 1)"""
    return f"""{_V}, lows AS (SELECT *, lag(close, 1) OVER w AS l1, lag(close, 2) OVER w AS l2, lag(close, 3) OVER w AS l3, lag(close, 4) OVER w AS l4 FROM lab WINDOW w AS ({_I})),
 wide AS (SELECT l.instrument_id, l.time, l.future_ret, m.factor_value AS a, v.factor_value AS b,
  CASE WHEN l4 IS NOT NULL THEN -((CAST(l1 < close AS INT) + CAST(l2 < close AS INT) + CAST(l3 < close AS INT) + CAST(l4 < close AS INT)) + 0.5 * (1 + CAST(l1 = close AS INT) + CAST(l2 = close AS INT) + CAST(l3 = close AS INT) + CAST(l4 = close AS INT)) + 0.5) / 5 END AS c,
  CASE WHEN l4 IS NOT NULL THEN -(close / ((close + l1 + l2 + l3 + l4) / 5) - 1) END AS d
  FROM lows l JOIN vals m ON m.factor_name = 'momentum' AND m.instrument_id = l.instrument_id AND m.time = l.time JOIN vals v ON v.factor_name = 'reversal' AND v.instrument_id = l.instrument_id AND v.time = l.time),
 sets AS ({sets}), spans AS (SELECT *, time < TIMESTAMP '{cut}' AS inside FROM sets),
 ics AS (SELECT mask, inside, instrument_id, year(time) AS year, corr(f, future_ret) AS ic FROM spans WHERE f IS NOT NULL AND future_ret IS NOT NULL GROUP BY 1, 2, 3, 4),
 wholes AS (SELECT mask, inside, instrument_id, corr(f, future_ret) AS ic FROM spans WHERE f IS NOT NULL AND future_ret IS NOT NULL GROUP BY 1, 2, 3),
 ratios AS (SELECT mask, inside, instrument_id, avg(ic) / (stddev_samp(ic) + 1e-6) AS ir FROM ics GROUP BY 1, 2, 3 HAVING count(ic) >= 2),
 parts AS (SELECT mask, inside, avg(0.3 * ic + 0.7 * ir) AS s FROM wholes JOIN ratios USING (mask, inside, instrument_id) GROUP BY 1, 2),
 total AS (SELECT mask, sum(s * CASE WHEN inside THEN {1 - share} ELSE {share} END) AS s FROM parts GROUP BY 1),
 names(name, bit, formula) AS (VALUES {', '.join(f"('{k}', {1 << j}, '{f}')" for j, (k, f) in enumerate(_CANDIDATES.items()))}),
 none AS (SELECT 0 AS mask, CAST('-infinity' AS DOUBLE) AS s), {one(1, 'none')}, {one(2, 'r1')}, {one(3, 'r2')}, {one(4, 'r3')}, path AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)
 SELECT CAST(round AS INT) AS round, path.name AS factor_name, round(s, 6) AS score, (SELECT CASE WHEN count(*) > 1 THEN 'NanMean(' || string_agg(n.formula, ', ' ORDER BY p.round) || ')' ELSE any_value(n.formula) END FROM path p JOIN names n ON n.name = p.name) AS formula FROM path"""


@query("fusion", f"WITH {_fusion(0.25, '1999-01-01')}")
def fusion_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    outside = fusion.Outside(0.25, ("1999-01-01", None), (None, "1998-12-31"))
    names, formula, path = fusion.fuse(panels.lineitem_panel(spark, sf_dir), _CANDIDATES, outside=outside)
    return spark.createDataFrame([(k + 1, n, round(s, 6), formula) for k, (n, s) in enumerate(zip(names, path, strict=True))], "round int, factor_name string, score double, formula string")


# --- a backtest beside a simulation, day by day

_SIGN = "sign(coalesce({}, 0)) <> sign(coalesce({}, 0))".format
_TAGS = {
    "factor_value_mismatch": "abs(factor_diff) > 1e-6", "exposure_mismatch": "abs(exposure_diff) > 0.05", "cost_model_gap": "abs(bt_cost - st_cost) > 1e-4", "ret_sign_mismatch": _SIGN("bt_net", "st_net"), "position_direction_mismatch": _SIGN("bt_factor", "st_exposure"),
    "margin_constraint": "contains(warning, 'margin')", "lot_size_floor": "contains(warning, 'below_one_lot')", "strategy_terminated": "contains(warning, 'equity_gone')",
}
_BESIDE = f"""{_LOG}, bt AS (SELECT instrument_id, time, factor_value AS bt_factor, future_ret AS bt_future, gross_ret AS bt_gross, net_ret AS bt_net, turnover AS bt_turnover FROM series WHERE factor_name = 'momentum'),
 st AS (SELECT instrument_id, time, factor_value AS st_factor, lots * open * 10 / 1000000.0 AS st_exposure, next_open / nullif(open, 0) - 1 AS st_future, open_to_open_pnl / 1000000.0 AS st_gross, (open_to_open_pnl - fee - slippage_cost) / 1000000.0 AS st_net, abs(delta_lots) * open * 10 / 1000000.0 AS st_turnover, warning FROM log),
 paired AS (SELECT bt.*, lead(st.time) OVER w AS traded, lead(st_factor) OVER w AS st_factor, lead(st_exposure) OVER w AS st_exposure, lead(st_future) OVER w AS st_future, lead(st_gross) OVER w AS st_gross, lead(st_net) OVER w AS st_net, lead(st_turnover) OVER w AS st_turnover, lead(warning) OVER w AS warning FROM bt JOIN st ON bt.instrument_id = st.instrument_id AND bt.time = st.time WINDOW w AS (PARTITION BY bt.instrument_id ORDER BY bt.time)),
 differed AS (SELECT *, bt_gross - bt_net AS bt_cost, st_gross - st_net AS st_cost, bt_factor - st_factor AS factor_diff, bt_factor - st_exposure AS exposure_diff, abs(bt_net - st_net) AS off FROM paired WHERE traded IS NOT NULL),
 marked AS (SELECT *, concat_ws('|', {', '.join(f"CASE WHEN {x} THEN '{k}' END" for k, x in _TAGS.items())}) AS r FROM differed), tagged AS (SELECT *, CASE WHEN r = '' THEN 'no_strong_signal' ELSE r END AS reasons FROM marked)"""


def _beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, log = _simulated(spark, sf_dir)
    return strategy.comparison(metrics.daily(panels.future_return(frame)), log)


@query("daily_comparison", f"""{_BESIDE} SELECT instrument_id, time, traded, round(bt_net, 6) + 0.0 AS bt_net_ret, round(st_net, 6) + 0.0 AS st_net_ret, round(bt_future - st_future, 6) + 0.0 AS future_ret_diff, round(bt_gross - st_gross, 6) + 0.0 AS gross_ret_diff, round(bt_cost - st_cost, 6) + 0.0 AS cost_diff, round(exposure_diff, 6) + 0.0 AS exposure_diff, round(st_turnover, 6) + 0.0 AS st_turnover,
 coalesce(bt_net > 0 AND st_net < 0, false) AS bt_win_st_lose, {_SIGN('bt_future', 'st_future')} AS sign_mismatch_future_ret, reasons FROM tagged""")
def daily_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _beside(spark, sf_dir)
    return rounded(df.select("instrument_id", "time", "traded", "bt_net_ret", "st_net_ret", "future_ret_diff", "gross_ret_diff", "cost_diff", "exposure_diff", "st_turnover", "bt_win_st_lose", "sign_mismatch_future_ret", "reasons"))


@query("reason_scoreboard", f"""{_BESIDE}, one AS (SELECT unnest(string_split(reasons, '|')) AS reason, off FROM tagged) SELECT reason, count(*) AS days, round(count(*) / (SELECT count(*) FROM tagged), 6) AS share, round(avg(off), 6) AS mean_abs_diff, round(sum(off), 4) AS sum_abs_diff FROM one GROUP BY 1""")
def reason_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = strategy.scoreboard(_beside(spark, sf_dir))
    return rounded(df.withColumn("sum_abs_diff", F.round("sum_abs_diff", 4)))


@query("comparison_summary", f"""{_BESIDE} SELECT instrument_id, 'momentum' AS factor_name, count(*) AS days, round(sum(bt_net), 5) AS bt_total, round(sum(st_net), 5) AS st_total, round(corr(bt_net, st_net), 6) AS corr, round(avg(CAST({_SIGN('bt_net', 'st_net')} AS INT)), 6) AS sign_mismatch_ratio, count(*) FILTER (bt_net > 0 AND st_net < 0) AS bt_win_st_lose_days, count(*) FILTER (st_net > 0 AND bt_net < 0) AS st_win_bt_lose_days FROM tagged GROUP BY 1""")
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = strategy.comparison_summary(_beside(spark, sf_dir)).drop("gap", "mean_abs_diff")
    return rounded(df.withColumns({c: F.round(c, 5) for c in ("bt_total", "st_total")}))
