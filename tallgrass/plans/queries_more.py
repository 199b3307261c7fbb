"""Further registered queries: stitching, filters, cross-sections, simulation, search, storage, reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.formula import Kind
from ..operators import extend
from ..operators.compiler import evaluate
from ..sources import panels, store
from ..streaming.bars import bars
from . import mining, pipeline, reports, rollover, select, strategy, xsection
from .backtest import Options, backtest, labelled
from .queries import _LABEL, _METRIC_SQL, _SUM, _V, PANEL_SQL, TESTED, query, rounded

_DAY = "CAST(time AS TIMESTAMP)"


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel of listed contracts: the flag is the root, the line status and the supplier's last digit the contract."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_returnflag").alias("instrument_id"), F.col("l_shipdate").alias("time"), F.concat("l_linestatus", (F.col("l_suppkey") % 3).cast("string")).alias("symbol"), (F.col("l_extendedprice") % 1000 / 50 + 100).alias("p"), F.col("l_quantity").alias("q")
    )
    return rows.groupBy("instrument_id", "time", "symbol").agg(F.min("p").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.avg("p").alias("close"), F.avg("p").alias("settle"), F.sum("q").alias("volume"), F.count(F.lit(1)).cast("double").alias("position"))


_CONTRACTS = "c AS (SELECT l_returnflag AS instrument_id, l_shipdate AS time, l_linestatus || CAST(l_suppkey % 3 AS VARCHAR) AS symbol, min(p) AS open, max(p) AS high, min(p) AS low, avg(p) AS close, sum(l_quantity) AS volume, CAST(count(*) AS DOUBLE) AS position FROM (SELECT *, l_extendedprice % 1000 / 50 + 100 AS p FROM lineitem) GROUP BY 1, 2, 3)"
_DOM = "dom AS (SELECT instrument_id, time, first(symbol ORDER BY volume DESC, symbol) AS today FROM c GROUP BY 1, 2)"
_I = "PARTITION BY instrument_id ORDER BY time"


@query("rollover", f"""WITH {_CONTRACTS}, {_DOM}, used AS (SELECT *, coalesce(lag(today) OVER ({_I}), today) AS used FROM dom),
 picked AS (SELECT u.instrument_id, u.time, CASE WHEN a.symbol IS NOT NULL THEN u.used ELSE u.today END AS symbol FROM used u LEFT JOIN c a ON a.instrument_id = u.instrument_id AND a.time = u.time AND a.symbol = u.used),
 steps AS (SELECT p.*, lag(p.symbol) OVER ({_I.replace('instrument_id', 'p.instrument_id').replace('time', 'p.time')}) AS old FROM picked p),
 rolled AS (SELECT s.*, coalesce(s.time >= TIMESTAMP '1996-01-01' AND s.symbol <> s.old, false) AS is_rollover FROM steps s),
 ratio AS (SELECT r.*, n.open, n.close, n.volume, CASE WHEN r.is_rollover THEN coalesce(o.open / n.open, 1) END AS q FROM rolled r JOIN c n ON n.instrument_id = r.instrument_id AND n.time = r.time AND n.symbol = r.symbol LEFT JOIN c o ON o.instrument_id = r.instrument_id AND o.time = r.time AND o.symbol = r.old)
 SELECT instrument_id, time, symbol, round(open, 6) AS open, round(close, 6) AS close, volume, is_rollover, round(ln(CASE WHEN time >= TIMESTAMP '1996-01-01' THEN product(coalesce(q, 1)) OVER w ELSE 1 END), 6) + 0.0 AS log_factor, round(coalesce(last_value(q IGNORE NULLS) OVER w, 1), 6) AS cur_weighted_factor FROM ratio WINDOW w AS ({_I} ROWS UNBOUNDED PRECEDING)""")
def rollover_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rollover.stitched(contracts(spark, sf_dir), anchor="1996-01-01")
    return rounded(df.select("instrument_id", "time", "symbol", "open", "close", "volume", "is_rollover", F.log("weighted_factor").alias("log_factor"), "cur_weighted_factor"))


@query("dominant_mismatch", f"WITH {_CONTRACTS}, d AS (SELECT instrument_id, time, first(symbol ORDER BY volume DESC, symbol) AS by_volume, first(symbol ORDER BY position DESC, symbol) AS by_position FROM c GROUP BY 1, 2) SELECT * FROM d WHERE by_volume <> by_position")
def dominant_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollover.mismatches(contracts(spark, sf_dir))


@query("relative_spearman", f"""WITH {PANEL_SQL}, x AS (SELECT instrument_id, time, -((close - low) / (high - low + 1e-8)) AS rev, close - lag(close, 3) OVER w AS d3, close - lag(close, 5) OVER w AS d5, volume - lag(volume, 1) OVER w AS v1 FROM panel WINDOW w AS ({_I})),
 p AS (SELECT 'reversal' AS factor_name, 'd5' AS other, rev AS x, d5 AS y FROM x UNION ALL SELECT 'reversal', 'v1', rev, v1 FROM x UNION ALL SELECT 'd3', 'd5', d3, d5 FROM x UNION ALL SELECT 'd3', 'v1', d3, v1 FROM x),
 k AS (SELECT *, rank() OVER (PARTITION BY factor_name, other ORDER BY x) + (count(*) OVER (PARTITION BY factor_name, other, x) - 1) / 2 AS a, rank() OVER (PARTITION BY factor_name, other ORDER BY y) + (count(*) OVER (PARTITION BY factor_name, other, y) - 1) / 2 AS b FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
 SELECT factor_name, other, round(abs(corr(a, b)), 6) AS spearman FROM k GROUP BY 1, 2""")
def relative_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, stored = {"reversal": TESTED["reversal"], "d3": "TsDelta(close, 3)"}, {"d5": "TsDelta(close, 5)", "v1": "Delta(volume)"}
    return rounded(select.spearman(panels.lineitem_panel(spark, sf_dir), new, stored))


_LIMITS = {"Gross Volatility": (50.0, 60.0, -1), "TS IC": (-0.5, -0.9, 1)}


@query("threshold_filter", f"""WITH {_SUM}, y AS (SELECT * FROM ir WHERE year <> 'all') SELECT factor_name, instrument_id,
 coalesce(bool_and(gv <= 60), false) AND coalesce(bool_and(coalesce(ic >= -0.9, false)), false) AND avg(gv) <= 50 AND coalesce(avg(ic) >= -0.5, false) AS passed, round(avg(gv), 6) AS mean_volatility, round(avg(ic), 6) + 0.0 AS mean_ic FROM y GROUP BY 1, 2""")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = backtest(panels.lineitem_panel(spark, sf_dir), TESTED, check=False)[0]
    df = select.verdicts(summary, _LIMITS)
    return rounded(df.select("factor_name", "instrument_id", "passed", F.col("`Gross Volatility`").alias("mean_volatility"), F.col("`TS IC`").alias("mean_ic")))


@query("yearly_worst", f"WITH {_SUM} SELECT factor_name, instrument_id, 'Net MaxDD' AS metric, round(avg(nm), 6) AS mean, round(max(nm), 6) AS worst FROM ir WHERE year <> 'all' GROUP BY 1, 2")
def yearly_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = backtest(panels.lineitem_panel(spark, sf_dir), TESTED, check=False)[0]
    return rounded(select.yearly_summary(summary, {"Net MaxDD": (None, None, -1)}))


@query("best_failed", f"""WITH {_SUM}, y AS (SELECT factor_name, instrument_id, avg(nr) AS mean FROM ir WHERE year <> 'all' GROUP BY 1, 2)
 SELECT 'Net Return' AS metric, factor_name, instrument_id, round(mean, 6) AS mean, round(mean - 999, 6) AS gap FROM y ORDER BY y.mean DESC, factor_name, instrument_id LIMIT 1""")
def best_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = backtest(panels.lineitem_panel(spark, sf_dir), TESTED, check=False)[0]
    return rounded(select.best_failed(summary, {"Net Return": (999.0, 999.0, 1)}))


@query("look_ahead", f"""WITH {PANEL_SQL}, t AS (SELECT time, ntile(20) OVER (ORDER BY time) AS p FROM (SELECT DISTINCT time FROM panel)), c AS (SELECT max(time) AS cut FROM t GROUP BY p),
 peek AS (SELECT instrument_id, time, lead(close) OVER ({_I}) AS v FROM panel), n AS (SELECT count(*) AS compared, count(v) AS seen FROM peek WHERE time IN (SELECT cut FROM c))
 SELECT unnest(['momentum', 'reversal', 'peeking']) AS factor_name, unnest([0, 0, seen]) AS changed, compared, unnest([true, true, seen = 0]) AS passed FROM n""")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factors that look back only, and one of a column that knows the next day."""
    knowing = lambda df: df.withColumn("next_close", F.lead("close").over(panels.by_time()))
    return select.look_ahead(panels.lineitem_panel(spark, sf_dir), TESTED | {"peeking": "Neg(next_close)"}, prepare=knowing)


# --- cross-sections over the suppliers' nations: many instruments a day

_WIDE = """w AS (SELECT CAST(l_suppkey % 25 AS VARCHAR) AS instrument_id, date_trunc('month', l_shipdate) AS time, avg(l_extendedprice % 1000 / 50 + 100) AS factor, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
 x AS (SELECT instrument_id, time, round(factor, 9) AS factor, round(lead(v) OVER (PARTITION BY instrument_id ORDER BY time) / v - 1, 9) AS future_ret FROM w)"""


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    df = rows.groupBy((F.col("l_suppkey") % 25).cast("string").alias("instrument_id"), F.date_trunc("month", "l_shipdate").alias("time")).agg(F.avg(F.col("l_extendedprice") % 1000 / 50 + 100).alias("factor"), F.sum("l_quantity").alias("v"))
    return df.select("instrument_id", "time", F.round("factor", 9).alias("factor"), F.round(F.lead("v").over(panels.by_time()) / F.col("v") - 1, 9).alias("future_ret"))


@query("cross_z_score", f"WITH {_WIDE} SELECT instrument_id, time, round((factor - avg(factor) OVER t) / nullif(stddev_samp(factor) OVER t, 0), 6) + 0.0 AS factor_z FROM x WINDOW t AS (PARTITION BY time)")
def cross_z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xsection.z_score(_monthly(spark, sf_dir), "factor").select("instrument_id", "time", "factor_z"))


_IC = f"""{_WIDE}, k AS (SELECT *, rank() OVER (PARTITION BY time ORDER BY factor) + (count(*) OVER (PARTITION BY time, factor) - 1) / 2 AS a, rank() OVER (PARTITION BY time ORDER BY future_ret) + (count(*) OVER (PARTITION BY time, future_ret) - 1) / 2 AS b FROM x WHERE factor IS NOT NULL AND future_ret IS NOT NULL),
 ic AS (SELECT time, CASE WHEN min(factor) <> max(factor) AND min(future_ret) <> max(future_ret) THEN corr(factor, future_ret) END AS ic, CASE WHEN min(factor) <> max(factor) AND min(future_ret) <> max(future_ret) THEN corr(a, b) END AS rank_ic FROM k GROUP BY time)"""


@query("cross_ic", f"WITH {_IC} SELECT time, round(ic, 6) + 0.0 AS ic, round(rank_ic, 6) + 0.0 AS rank_ic FROM ic")
def cross_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xsection.information(_monthly(spark, sf_dir), "factor"))


@query("cross_icir", f"WITH {_IC} SELECT CAST(year(time) AS INT) AS year, round(avg(ic), 6) + 0.0 AS ic, round(CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) END, 6) + 0.0 AS icir, round(avg(rank_ic), 6) + 0.0 AS rank_ic FROM ic GROUP BY 1")
def cross_icir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xsection.yearly_information(xsection.information(_monthly(spark, sf_dir), "factor")))


@query("quantile_portfolios", f"""WITH {_WIDE}, e AS (SELECT time, quantile_cont(factor, [0.2, 0.4, 0.6, 0.8]) AS e FROM x GROUP BY 1),
 b AS (SELECT x.time, future_ret, CASE WHEN factor < e[1] THEN 1 WHEN factor > e[1] AND factor < e[2] THEN 2 WHEN factor > e[2] AND factor < e[3] THEN 3 WHEN factor > e[3] AND factor < e[4] THEN 4 WHEN factor > e[4] THEN 5 END AS bucket FROM x JOIN e ON x.time = e.time)
 SELECT time, bucket, floor(avg(CAST(round(future_ret * 1e9) AS BIGINT))) / 1e9 AS ret, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2""")
def quantile_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns are whole billionths, whose mean does not depend on their order."""
    whole = _monthly(spark, sf_dir).withColumn("future_ret", F.round(F.col("future_ret") * 1e9).cast("long"))
    return xsection.quantile_portfolios(whole, "factor").select("time", "bucket", (F.floor("ret") / 1e9).alias("ret"), "n")


_LEG = f"{_WIDE}, leg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY time ORDER BY factor DESC NULLS LAST, instrument_id) AS r, floor(count(factor) OVER (PARTITION BY time) * 0.2) AS n FROM x) WHERE r <= n)"


@query("long_leg", f"WITH {_LEG} SELECT instrument_id, time, round(factor, 6) AS factor FROM leg")
def long_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xsection.long_leg(_monthly(spark, sf_dir), "factor").select("instrument_id", "time", "factor"))


@query("portfolio_turnover", f"""WITH {_LEG}, q AS (SELECT time, instrument_id, 1.0 / count(*) OVER (PARTITION BY time) AS w FROM leg), t AS (SELECT time, lead(time) OVER (ORDER BY time) AS next FROM (SELECT DISTINCT time FROM q)),
 m AS (SELECT time, instrument_id, w FROM q UNION ALL SELECT next, instrument_id, -w FROM q JOIN t ON q.time = t.time WHERE next IS NOT NULL), d AS (SELECT time, instrument_id, sum(w) AS d FROM m GROUP BY 1, 2) SELECT time, round(sum(abs(d)) / 2, 6) AS turnover FROM d GROUP BY 1""")
def portfolio_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xsection.portfolio_turnover(xsection.long_leg(_monthly(spark, sf_dir), "factor")))


# --- labels against rates, baselines

_RATES = "rates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(extract(day FROM o_orderdate) AS DOUBLE) / 1000 / 252 AS rate FROM orders WHERE o_orderpriority = '1-URGENT')"


@query("excess_return", f"""WITH {PANEL_SQL}, {_LABEL}, {_RATES}, j AS (SELECT lab.*, rate FROM lab LEFT JOIN rates ON CAST(time AS DATE) = d)
 SELECT instrument_id, time, round(future_ret - coalesce(first_value(rate IGNORE NULLS) OVER ({_I} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(rate IGNORE NULLS) OVER ({_I} ROWS UNBOUNDED PRECEDING), 0), 6) + 0.0 AS future_ret FROM j""")
def excess_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").alias("date"), (F.dayofmonth("o_orderdate") / 1000).alias("rate")).distinct()
    df = panels.excess_return(panels.future_return(panels.lineitem_panel(spark, sf_dir)), rates)
    return rounded(df.select("instrument_id", "time", "future_ret"))


@query("baselines", f"WITH {PANEL_SQL}, {_LABEL} SELECT instrument_id, unnest(['long', 'short']) AS factor_name, round(avg(coalesce(future_ret, 0)) * 252 * unnest([1, -1]), 6) + 0.0 AS gross_return FROM lab GROUP BY instrument_id")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = backtest(panels.lineitem_panel(spark, sf_dir), {"reversal": TESTED["reversal"]}, Options(baselines=True), check=False)[0]
    return rounded(df.where("year = 'all' and factor_name in ('long', 'short')").select("instrument_id", "factor_name", F.col("`Gross Return`").alias("gross_return")))


# --- storage

@query("upsert", "WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders), n AS (SELECT o_orderkey + 5 AS o_orderkey, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 10 = 0) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o_totalprice FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderkey % 10 = 0").select((F.col("o_orderkey") + 5).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"))
    return store.merged(old, new, ("o_orderkey",))


@query("update_many", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return store.update_many(df, F.col("o_totalprice") > 300000, {"o_orderstatus": F.lit("X")})[0].select("o_orderkey", "o_orderstatus")


@query("delete", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderstatus") == "F").select("o_orderkey")


@query("keep_first", "SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_first(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber"), ("l_orderkey",), ["l_linenumber"])


@query("symbols", "WITH r AS (SELECT DISTINCT l_returnflag AS instrument_id, month(l_shipdate) AS m FROM lineitem WHERE month(l_shipdate) IN (1, 5, 9)), y AS (SELECT unnest(range(min(year(l_shipdate)) - 1, max(year(l_shipdate)) + 2)) AS y FROM lineitem) SELECT instrument_id || lpad(CAST(y % 100 AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0') AS symbol, instrument_id FROM r, y")
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots are the flags, listed in those of three months in which they are shipped."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("root"), F.month("l_shipdate").alias("m"), F.year("l_shipdate").alias("y"))
    roots = {r["root"]: sorted(r["months"]) for r in rows.where(F.col("m").isin(1, 5, 9)).groupBy("root").agg(F.collect_set("m").alias("months")).collect()}
    low, high = rows.agg(F.min("y"), F.max("y")).first()
    return store.symbols(spark, roots, low, high)


@query("calendar", "SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) BETWEEN 1 AND 5 AND CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 7 = 0)")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 7 = 0").select(F.col("o_orderdate").alias("day"))
    return store.calendar(spark, date(1996, 1, 1), date(1996, 12, 31), off)


@query("missing_ranges", f"WITH {PANEL_SQL}, h AS (SELECT instrument_id, CAST(min(time) AS DATE) AS low, CAST(max(time) AS DATE) AS high FROM panel WHERE instrument_id <> 'AF' GROUP BY 1), a AS (SELECT DISTINCT instrument_id FROM panel), f AS (SELECT a.instrument_id, low, high FROM a LEFT JOIN h ON a.instrument_id = h.instrument_id), p AS (SELECT instrument_id, coalesce(DATE '1995-01-01') AS first, coalesce(low - 1, DATE '2002-01-01') AS last FROM f UNION ALL SELECT instrument_id, high + 1, DATE '2002-01-01' FROM f WHERE high IS NOT NULL) SELECT instrument_id, CAST(first AS DATE) AS first, CAST(last AS DATE) AS last FROM p WHERE first <= last")
def missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.lineitem_panel(spark, sf_dir)
    names = [a + b for a in "ANR" for b in "FO"]
    return store.missing_ranges(panel.where("instrument_id <> 'AF'"), date(1995, 1, 1), date(2002, 1, 1), names)


@query("compared", f"WITH {PANEL_SQL}, b AS (SELECT instrument_id, time, CASE WHEN position = 4 THEN open + 1 ELSE open END AS open FROM panel) SELECT instrument_id, time, round(panel.open, 6) AS open_a, round(b.open, 6) AS open_b FROM panel JOIN b USING (instrument_id, time) WHERE abs(panel.open - b.open) > 1e-6")
def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = panels.lineitem_panel(spark, sf_dir)
    b = a.withColumn("open", F.when(F.col("position") == 4, F.col("open") + 1).otherwise(F.col("open")))
    return rounded(store.compared(a, b, ("open",), ("instrument_id", "time")))


# --- reports

@query("overview", f"WITH {PANEL_SQL}, o AS (SELECT instrument_id, min(time) AS first, max(time) AS last, count(*) AS rows FROM panel GROUP BY 1), d AS (SELECT DISTINCT CAST(time AS DATE) AS day FROM panel), m AS (SELECT o.instrument_id, count(*) AS missing_days FROM o JOIN d ON day BETWEEN CAST(first AS DATE) AND CAST(last AS DATE) WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.instrument_id = o.instrument_id AND CAST(p.time AS DATE) = d.day) GROUP BY 1) SELECT o.*, CAST(0 AS BIGINT) AS incomplete, coalesce(missing_days, 0) AS missing_days FROM o LEFT JOIN m USING (instrument_id)")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.lineitem_panel(spark, sf_dir)
    return reports.overview(panel, ["open", "close"], panel.select(F.to_date("time").alias("day")).distinct())


@query("duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS rows, concat_ws(',', CASE WHEN count(DISTINCT l_partkey) > 1 THEN 'l_partkey' END, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'l_returnflag' END) AS differing FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duplicates(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), ["l_orderkey", "l_linenumber"])


@query("null_ratios", f"WITH {_V} SELECT unnest(['factor_value', 'future_ret']) AS \"column\", round(unnest([avg(CAST(factor_value IS NULL AS INT)), avg(CAST(future_ret IS NULL AS INT))]), 6) AS ratio FROM vals")
def null_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.null_ratios(labelled(panels.lineitem_panel(spark, sf_dir), TESTED, check=False).select("factor_value", "future_ret")))


@query("difference_summary", f"WITH {PANEL_SQL} SELECT count(*) AS rows, round(corr(open, close), 6) AS corr, round(avg(abs(open - close)), 6) AS mean_abs, round(quantile_cont(abs(open - close), 0.95), 6) AS p95_abs, round(avg(CAST(abs(open - close) > 1e-6 AS INT)), 6) AS share_off FROM panel")
def difference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.difference_summary(panels.lineitem_panel(spark, sf_dir), "open", "close"))


@query("top_factors", f"WITH {_SUM} SELECT 'fac_gp_' || lpad(CAST(row_number() OVER (ORDER BY {_METRIC_SQL['Turnover']} DESC, instrument_id, year) AS VARCHAR), 4, '0') AS factor_name, instrument_id, year, round(t, 6) AS turnover FROM ir WHERE factor_name = 'momentum' QUALIFY row_number() OVER (ORDER BY t DESC, instrument_id, year) <= 20")
def top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = backtest(panels.lineitem_panel(spark, sf_dir), TESTED, check=False)[0].where("factor_name = 'momentum'").select("instrument_id", "year", F.col("Turnover").alias("turnover"))
    return rounded(reports.named_by_rank(df, "turnover", 20, "instrument_id", "year").select("factor_name", "instrument_id", "year", "turnover"))


@query("event_bars", "SELECT event_type AS instrument_id, date_trunc('hour', ts) AS time, min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, count(*) AS ticks FROM events GROUP BY 1, 2")
def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("instrument_id"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size")))


# --- path dependent or searched: no SQL

def _simulated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = panels.lineitem_panel(spark, sf_dir)
    frame = evaluate(panel, {"factor_value": TESTED["momentum"]}, ["instrument_id", "time", "open", "close"]).withColumn("factor_name", F.lit("momentum"))
    return frame, strategy.simulate(frame)


# The equity's path as a recursion over each instrument's days.
_TRUNC = "CAST(coalesce(trunc({}), 0) AS BIGINT)".format
_LOG = f"""WITH RECURSIVE {_V}, m AS (SELECT v.instrument_id, v.time, v.factor_value, p.open, p.close FROM vals v JOIN panel p ON v.instrument_id = p.instrument_id AND v.time = p.time WHERE v.factor_name = 'momentum'),
 s AS (SELECT instrument_id, time, open, lag(factor_value) OVER w AS f, lead(open) OVER w AS next_open, first_value(open) OVER w AS fo, row_number() OVER w AS rn FROM m WINDOW w AS ({_I})),
 t AS MATERIALIZED (SELECT *, {_TRUNC('1000000.0 * f / (open * 10.0)')} AS wanted, {_TRUNC('1000000.0 / (fo * 10.0)')} AS ll, {_TRUNC('-1000000.0 / (fo * 10.0)')} AS sl, CASE WHEN next_open > 0 THEN (next_open - open) * 10 ELSE 0 END AS move FROM s),
 sim AS (SELECT instrument_id, CAST(0 AS BIGINT) AS rn, 1000000.0::DOUBLE AS equity, CAST(0 AS BIGINT) AS lots, CAST(0 AS BIGINT) AS traded, 0.0::DOUBLE AS pnl, 0.0::DOUBLE AS margin, 1000000.0::DOUBLE AS bl, 1000000.0::DOUBLE AS bs, 0.0::DOUBLE AS after_costs, false AS capped, false AS gone FROM (SELECT DISTINCT instrument_id FROM t)
  UNION ALL SELECT instrument_id, rn, CASE WHEN e <= 0 THEN e ELSE e + target * move END, target, traded, CASE WHEN e <= 0 THEN 0 ELSE target * move END, CASE WHEN e <= 0 THEN 0 ELSE abs(target) * open * 10 * 0.1 END, CASE WHEN e <= 0 THEN bl ELSE bl + ll * move END, CASE WHEN e <= 0 THEN bs ELSE bs + sl * move END, e, capped, CASE WHEN e <= 0 THEN true ELSE e + target * move <= 0 END
   FROM (SELECT *, equity - traded * 2.0 - traded * 10.0 AS e FROM (SELECT *, abs(target - lots) AS traded FROM (SELECT t.instrument_id, t.rn, t.open, t.ll, t.sl, t.move, x.equity, x.lots, x.bl, x.bs, abs(t.wanted) > CAST(floor(greatest(x.equity, 0) / (t.open * 10 * 0.1)) AS BIGINT) AS capped, CASE WHEN abs(t.wanted) > CAST(floor(greatest(x.equity, 0) / (t.open * 10 * 0.1)) AS BIGINT) THEN CAST(sign(t.wanted) AS BIGINT) * CAST(floor(greatest(x.equity, 0) / (t.open * 10 * 0.1)) AS BIGINT) ELSE t.wanted END AS target FROM sim x JOIN t ON t.instrument_id = x.instrument_id AND t.rn = x.rn + 1 WHERE NOT x.gone)))),
 log AS (SELECT t.instrument_id, 'momentum' AS factor_name, t.time, t.open, t.next_open, coalesce(t.f, 0) AS factor_value, t.wanted AS target_lots, x.lots, x.lots - coalesce(lag(x.lots) OVER (PARTITION BY t.instrument_id ORDER BY t.rn), 0) AS delta_lots, CAST(x.traded AS DOUBLE) * 2 AS fee, CAST(x.traded AS DOUBLE) * 10 AS slippage_cost, x.pnl AS open_to_open_pnl, x.equity, x.margin AS required_margin, CASE WHEN x.after_costs <= 0 THEN x.after_costs ELSE x.after_costs - x.margin END AS available_cash, x.bl AS baseline_long_equity, x.bs AS baseline_short_equity,
  concat_ws(';', CASE WHEN x.capped THEN 'margin' END, CASE WHEN x.lots = 0 AND coalesce(t.f, 0) <> 0 THEN 'below_one_lot' END, CASE WHEN x.after_costs <= 0 THEN 'equity_gone_by_costs' WHEN x.gone THEN 'equity_gone' END) AS warning FROM sim x JOIN t ON t.instrument_id = x.instrument_id AND t.rn = x.rn)"""
_R6 = "round({0}, 6) + 0.0 AS {0}".format


@query("strategy", f"{_LOG} SELECT instrument_id, factor_name, time, {_R6('open')}, {_R6('next_open')}, {_R6('factor_value')}, target_lots, lots, delta_lots, {', '.join(map(_R6, ('fee', 'slippage_cost', 'open_to_open_pnl', 'equity', 'required_margin', 'available_cash', 'baseline_long_equity', 'baseline_short_equity')))}, warning FROM log")
def strategy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_simulated(spark, sf_dir)[1])


@query("monitor", f"""{_LOG}, last AS (SELECT instrument_id, 'momentum' AS factor_name, max(time) AS time, max_by(factor_value, time) AS signal, max_by(close, time) AS close FROM m GROUP BY 1), kept AS (SELECT instrument_id, max_by(lots, time) AS lots FROM log GROUP BY 1),
 b AS (SELECT last.*, coalesce(kept.lots, 0) AS lots, {_TRUNC('1000000.0 * signal / (close * 10.0)')} AS target_lots FROM last LEFT JOIN kept ON last.instrument_id = kept.instrument_id)
 SELECT instrument_id, factor_name, time, {_R6('signal')}, {_R6('close')}, lots, target_lots, CASE WHEN lots = target_lots THEN 'HOLD' WHEN lots = 0 THEN 'OPEN_' || CASE WHEN target_lots > 0 THEN 'LONG' ELSE 'SHORT' END WHEN lots > 0 AND target_lots >= 0 OR lots < 0 AND target_lots <= 0 THEN 'ADJUST_' || CASE WHEN lots > 0 THEN 'LONG' ELSE 'SHORT' END ELSE 'REVERSE_TO_' || CASE WHEN target_lots > 0 THEN 'LONG' ELSE 'SHORT' END END AS action, target_lots - lots AS delta_lots FROM b""")
def monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, log = _simulated(spark, sf_dir)
    return rounded(strategy.monitor(frame, log))


@query("attribution", f"""{_LOG}, a AS (SELECT instrument_id, factor_name, time, lag(position) OVER (PARTITION BY instrument_id ORDER BY time) AS bt_position, net_ret, turnover FROM series WHERE factor_name = 'momentum'),
 j AS (SELECT a.*, l.open, l.lots, l.target_lots, l.fee, l.slippage_cost, l.open_to_open_pnl, l.warning, l.lots * l.open * 10 / 1000000.0 AS exposure FROM a JOIN log l ON a.instrument_id = l.instrument_id AND a.time = l.time)
 SELECT instrument_id, factor_name, time, {', '.join(map(_R6, ('bt_position', 'net_ret', 'turnover', 'open')))}, lots, target_lots, {', '.join(map(_R6, ('fee', 'slippage_cost', 'open_to_open_pnl')))}, warning, {_R6('exposure')}, round(exposure - bt_position, 6) + 0.0 AS exposure_diff, round((open_to_open_pnl - fee - slippage_cost) / 1000000.0, 6) + 0.0 AS st_ret,
 concat_ws('|', CASE WHEN abs(exposure - bt_position) > 1e-9 THEN 'rounding' END, CASE WHEN contains(warning, 'margin') THEN 'margin' END, CASE WHEN contains(warning, 'below_one_lot') THEN 'below_one_lot' END, CASE WHEN fee + slippage_cost > 0 THEN 'costs' END) AS reason FROM j""")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, log = _simulated(spark, sf_dir)
    series = metrics.daily(panels.future_return(frame))
    return rounded(strategy.attribution(series, log))


@query("mining")
def mining_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.mine(panels.orders_panel(spark, sf_dir), mining.Search(population=20, generations=3))
    return spark.createDataFrame([(k + 1, f, round(s, 6)) for k, (f, s) in enumerate(found)], "rank int, formula string, fitness double")


@query("freshness", f"WITH {PANEL_SQL} SELECT instrument_id, CAST(max(time) AS DATE) AS latest_day, DATE '2001-10-01' AS expected_day, max(time) >= TIMESTAMP '2001-10-01' AS is_latest FROM panel GROUP BY 1")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy.freshness(panels.lineitem_panel(spark, sf_dir), date(2001, 10, 1))


@query("registered_operator", f"WITH {PANEL_SQL} SELECT instrument_id, time, round(CASE WHEN count(close) OVER w >= 4 THEN max(close) OVER w - min(close) OVER w END / nullif(high, 0), 6) + 0.0 AS spread FROM panel WINDOW w AS ({_I} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def registered_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula of operators that the language does not have."""

    def spread(x, by, n):
        rows = by.rowsBetween(1 - n, 0)
        return F.when(F.count(x).over(rows) >= n, F.max(x).over(rows) - F.min(x).over(rows))

    with extend.registered("Spread", spread, windows=1), extend.registered("Ratio", F.try_divide, operands=2, kind=Kind.RATIO):
        df = evaluate(panels.lineitem_panel(spark, sf_dir), {"spread": "Ratio(Spread(close, 4), high)"})
    return rounded(df)


@query("outside_sample", f"WITH {_SUM}, y AS (SELECT *, year < '1999' AS inside FROM ir WHERE year <> 'all'), m AS (SELECT factor_name, instrument_id, avg(t) FILTER (inside) * 0.75 + avg(t) FILTER (NOT inside) * 0.25 AS mean_turnover, bool_and(t <= 5) FILTER (inside) AS low FROM y GROUP BY 1, 2) SELECT factor_name, instrument_id, low AND mean_turnover <= 1.15 AS passed, round(mean_turnover, 6) AS mean_turnover FROM m")
def outside_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits on a mean that is blended with years that the search has not seen."""
    summary = backtest(panels.lineitem_panel(spark, sf_dir), TESTED, check=False)[0]
    inside, outside = summary.where("year < '1999' or year = 'all'"), summary.where("year >= '1999' and year <> 'all'")
    df = select.verdicts(inside, {"Turnover": (1.15, 5.0, -1)}, outside=outside, outside_share=0.25)
    return rounded(df.select("factor_name", "instrument_id", "passed", F.col("Turnover").alias("mean_turnover")))


_WEIGHTS = {"TS IC": 1.0, "Net Return": 0.5}


@query("fitness_scores", f"""WITH {_V}, g AS (SELECT *, count(*) OVER (PARTITION BY instrument_id, factor_name) AS n FROM vals WHERE factor_value IS NOT NULL AND future_ret IS NOT NULL),
 c AS (SELECT instrument_id, time, factor_name, greatest(-20.0, least(20.0, factor_value)) AS f, greatest(-1.0, least(1.0, future_ret)) AS r FROM g WHERE n >= 50),
 d AS (SELECT *, f * r - abs(f - coalesce(lag(f) OVER (PARTITION BY instrument_id, factor_name ORDER BY time), 0)) * 0.0002 AS net FROM c),
 y AS (SELECT factor_name, instrument_id, year(time) AS year, coalesce(CASE WHEN min(f) <> max(f) AND min(r) <> max(r) THEN corr(f, r) END, 0) AS ic, avg(net) * 252 AS nr FROM d GROUP BY 1, 2, 3)
 SELECT factor_name, round((avg(ic) + avg(nr) * 0.5) * greatest(0, 1 - 0.2 * stddev_samp(ic + nr * 0.5) / (abs(avg(ic + nr * 0.5)) + 1e-8)), 6) + 0.0 AS score, round(t, 6) AS tradable
 FROM y JOIN (SELECT factor_name, avg(CAST(abs(g.factor_value) >= p.open * 100 / 10000.0 AS INT)) AS t FROM g JOIN panel p ON g.instrument_id = p.instrument_id AND g.time = p.time WHERE g.instrument_id IN ('AF', 'RF') GROUP BY 1) USING (factor_name) GROUP BY factor_name, t""")
def fitness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    search = mining.Search(fitness=_WEIGHTS, consistency=0.2, capital=10_000.0, multipliers={"AF": 100.0, "RF": 100.0})
    return rounded(mining.scores(panels.lineitem_panel(spark, sf_dir), TESTED, search))


_CHOSEN = {"momentum": TESTED["momentum"], "d3": "TsDelta(close, 3)", "d5": "TsDelta(close, 5)"}


@query("chosen_factors", f"""WITH {PANEL_SQL}, x AS (SELECT instrument_id, time, close - lag(close, 3) OVER w AS d3, close - lag(close, 5) OVER w AS d5, close - lag(close, 4) OVER w AS d4 FROM panel WINDOW w AS ({_I})),
 p AS (SELECT 'd3' AS factor_name, d3 AS x, d4 AS y FROM x UNION ALL SELECT 'd5', d5, d4 FROM x),
 k AS (SELECT *, rank() OVER (PARTITION BY factor_name ORDER BY x) + (count(*) OVER (PARTITION BY factor_name, x) - 1) / 2 AS a, rank() OVER (PARTITION BY factor_name ORDER BY y) + (count(*) OVER (PARTITION BY factor_name, y) - 1) / 2 AS b FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
 s AS (SELECT factor_name, abs(corr(a, b)) AS m FROM k GROUP BY 1)
 SELECT unnest(['d3', 'd5', 'momentum']) AS factor_name, unnest([true, true, false]) AS passed_limits, unnest([true, true, false]) AS passed_look_ahead, round(unnest([(SELECT m FROM s WHERE factor_name = 'd3'), (SELECT m FROM s WHERE factor_name = 'd5'), NULL]), 6) AS max_abs_spearman, unnest([(SELECT m FROM s WHERE factor_name = 'd3') < 0.5, (SELECT m FROM s WHERE factor_name = 'd5') < 0.5, false]) AS kept""")
def chosen_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of mining from given candidates: limits (factors in prices vary more than normalised ones), look-ahead, relation."""
    rules = pipeline.Rules({"Gross Volatility": (5.0, 0.0, 1)}, related=0.5)
    run = pipeline.chosen(panels.lineitem_panel(spark, sf_dir), _CHOSEN, {"stored": "TsDelta(close, 4)"}, rules)
    return rounded(run.table().drop("formula"))
