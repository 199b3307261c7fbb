"""Registered queries of scans, records and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, scalars
from ..sources import panels, store
from . import catalog, learning
from .backtest import Options, backtest
from .queries import _LABEL, _SUM, _V, PANEL_SQL, TESTED, query, rounded


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


_RET = "round((o_totalprice % 100 - 50) / 1000, 6)"


@query("return_conversions", f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 0 WHEN o_orderkey % 51 <> 0 THEN {_RET} END AS ret FROM orders)
 SELECT o_orderkey, round(pow(1 + ret, 1.0 / 252) - 1, 9) + 0.0 AS daily, round(pow(1 + ret / 100, 252) - 1, 6) + 0.0 AS annual, round(CASE WHEN ret = 0 THEN ret ELSE pow(1 + (pow(1 + ret, 1.0 / 5) - 1), 21) - 1 END, 6) + 0.0 AS monthly FROM r""")
def return_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ret = F.when(F.col("o_orderkey") % 50 == 0, 0.0).when(F.col("o_orderkey") % 51 != 0, F.round((F.col("o_totalprice") % 100 - 50) / 1000, 6))
    df = _orders(spark, sf_dir).select("o_orderkey", ret.alias("ret"))
    return df.select("o_orderkey", (F.round(scalars.annual_to_daily(F.col("ret")), 9) + 0.0).alias("daily"), (F.round(scalars.daily_to_annual(F.col("ret") / 100), 6) + 0.0).alias("annual"), (F.round(scalars.adjusted_frequency(F.col("ret"), 5, 21), 6) + 0.0).alias("monthly"))


for _unit, _n, _at, _round in (("month", 5, "(year(time) * 12 + month(time))", "ceil"), ("year", 2, "year(time)", "ceil"), ("day", 90, "date_diff('day', DATE '1970-01-01', CAST(time AS DATE))", "floor")):

    def _chunked(spark: SparkSession, sf_dir: str, unit=_unit, n=_n) -> DataFrame:
        df = scalars.chunks(panels.lineitem_panel(spark, sf_dir), n, unit)
        return df.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.min("time").alias("first"), F.max("time").alias("last"))

    query(f"chunks_by_{_unit}", f"WITH {PANEL_SQL}, c AS (SELECT time, CAST({_round}(({_at} - (SELECT min({_at}) FROM panel)) / {_n}.0) AS INT) AS chunk FROM panel) SELECT chunk, count(*) AS rows, min(time) AS first, max(time) AS last FROM c WHERE chunk >= 1 GROUP BY 1")(_chunked)


@query("parameter_grid", "SELECT line, flag FROM (SELECT DISTINCT l_linenumber AS line FROM lineitem), (SELECT DISTINCT l_returnflag AS flag FROM lineitem)")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices are the values that two columns of few values have."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    values = lambda c: sorted(r[0] for r in rows.select(c).distinct().collect())
    return scalars.grid(spark, {"line": values("l_linenumber"), "flag": values("l_returnflag")})


@query("sanitised", f"WITH {_V} SELECT instrument_id, time, factor_name, round(greatest(-20.0, least(20.0, coalesce(factor_value * 15, 0))), 6) + 0.0 AS factor_value, round(greatest(-1.0, least(1.0, coalesce(future_ret * 60, 0))), 6) + 0.0 AS future_ret FROM vals")
def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .backtest import labelled

    frame = labelled(panels.lineitem_panel(spark, sf_dir), TESTED, check=False).withColumns({"factor_value": F.col("factor_value") * 15, "future_ret": F.col("future_ret") * 60})
    return rounded(scalars.sanitised(frame).select("instrument_id", "time", "factor_name", "factor_value", "future_ret"))


@query("root_symbols", "SELECT n_nationkey, regexp_replace(upper(trim(' ' || n_name || '0 ')), '0$', '') AS root, regexp_replace(upper(trim(n_name)), '0$', '') || '0' AS main FROM nation")
def root_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return df.select("n_nationkey", scalars.root_symbol(F.concat(F.lit(" "), "n_name", F.lit("0 "))).alias("root"), scalars.main_symbol(F.col("n_name")).alias("main"))


@query("references", """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'factors.' || o_orderstatus || '.x@v' || o_custkey WHEN 1 THEN 'factors.' || o_orderstatus ELSE 'nothing' END AS t FROM orders)
 SELECT o_orderkey, CASE WHEN t <> 'nothing' THEN 'factors' END AS database, CASE WHEN t <> 'nothing' THEN split_part(substr(t, 9), '@', 1) END AS collection, nullif(split_part(t, '@', 2), '') AS version FROM r""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("factors."), "o_orderstatus", F.lit(".x@v"), F.col("o_custkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("factors."), "o_orderstatus")).otherwise("nothing")
    return _orders(spark, sf_dir).select("o_orderkey", scalars.reference(text).alias("r")).select("o_orderkey", "r.*")


@query("json_answers", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("event_id") % 10 == 0, "no object").otherwise(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n``` done")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object(scalars.json_part(answer), "$.k").alias("k"))


@query("json_safe", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS placed FROM orders")
def json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 == 0, float("nan")).when(F.col("o_orderkey") % 11 == 0, float("-inf")).otherwise(F.col("o_totalprice"))
    return scalars.json_safe(_orders(spark, sf_dir).select("o_orderkey", price.alias("price"), F.col("o_orderdate").alias("placed")))


@query("cleaned_fitness", "SELECT o_orderkey, 'TS IC' AS metric, o_totalprice AS value FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'Turnover', CAST(o_custkey AS DOUBLE) FROM orders")
def cleaned_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    made = F.create_map(F.lit("TS IC"), price, F.lit(" "), F.lit(1.0), F.lit("Turnover"), F.col("o_custkey").cast("double"), F.lit("Net Return"), F.lit(None).cast("double"))
    return _orders(spark, sf_dir).select("o_orderkey", F.explode(scalars.cleaned_fitness(made)).alias("metric", "value"))


@query("tag_shares", "SELECT unnest(['URGENT', 'LOW', 'I']) AS tag, unnest([sum(CAST(contains(o_orderpriority, 'URGENT') AS INT)), sum(CAST(contains(o_orderpriority, 'LOW') AS INT)), sum(CAST(contains(o_orderpriority, 'I') AS INT))]) AS rows, round(unnest([avg(CAST(contains(o_orderpriority, 'URGENT') AS INT)), avg(CAST(contains(o_orderpriority, 'LOW') AS INT)), avg(CAST(contains(o_orderpriority, 'I') AS INT))]), 6) AS share FROM orders")
def tag_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scalars.tag_shares(_orders(spark, sf_dir), "o_orderpriority", ["URGENT", "LOW", "I"]))


@query("group_head", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 3")
def group_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalars.head(_orders(spark, sf_dir), 3, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("worst_mismatches", f"WITH {PANEL_SQL} SELECT instrument_id, time, round(abs(open - close), 6) AS difference FROM panel WHERE abs(open - close) > 0.5 ORDER BY abs(open - close) DESC, instrument_id, time LIMIT 20")
def worst_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scalars.worst(panels.lineitem_panel(spark, sf_dir), F.abs(F.col("open") - F.col("close")), 0.5, 20, "instrument_id", "time")
    return rounded(df.select("instrument_id", "time", "difference"))


@query("recent_events", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 2000")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 2,000 log entries: a report of that length."""
    from .reports import top

    return top(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"), "ts", 2000, "event_id")


@query("not_stored_yet", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def not_stored_yet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").join(_orders(spark, sf_dir).where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("common_keys", "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders")
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key")).intersect(_orders(spark, sf_dir).select("o_custkey"))


@query("except_keys", "SELECT s_suppkey AS key FROM supplier EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key")).subtract(spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0").select("c_custkey"))


@query("merged_tasks", "SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 4 = 0 THEN 'running' ELSE o_orderstatus END AS status FROM orders")
def merged_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"))
    return scalars.by_priority([stored.where("task_id % 4 = 0").withColumn("status", F.lit("running")), stored], "task_id")


# --- scans

_NAMES = {"instrument_id": "o_orderpriority", "symbol": "o_orderstatus", "time": "o_orderdate", "price": "o_totalprice"}


@query("price_scan", "SELECT o_orderpriority AS instrument_id, o_orderdate AS time, o_totalprice AS price FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
def price_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.scan(spark, f"{sf_dir}/orders.parquet", ["1-URGENT", "5-LOW"], "1996-01-01", "1997-12-31", names=_NAMES).select("instrument_id", "time", "price")


@query("symbol_scan", "SELECT 'RB' || upper(o_orderstatus) || '05' AS symbol, 'RB' || upper(o_orderstatus) AS instrument_id, o_orderdate AS time, o_totalprice AS price FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate >= TIMESTAMP '1996-01-01'")
def symbol_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = {**_NAMES, "symbol": F.concat(F.lit("rb"), "o_orderstatus", F.lit("05"))}
    return panels.scan_symbols(spark, f"{sf_dir}/orders.parquet", ["RBO05", "RBP05"], "1996-01-01", names=listed).select("symbol", "instrument_id", "time", "price")


@query("contract_info", "SELECT DISTINCT o_orderpriority AS instrument_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', 'none')")
def contract_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.contract_info(_orders(spark, sf_dir).select(F.col("o_orderpriority").alias("instrument_id")), ["1-URGENT", "2-HIGH", "none"])


@query("risk_free", "SELECT o_orderpriority AS instrument_id, o_custkey / 100.0 AS rate, o_orderdate AS date FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1997 AND o_custkey % 5 <> 0")
def risk_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _orders(spark, sf_dir).select(F.col("o_orderpriority").alias("instrument_id"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey").cast("double")).alias("rate"), F.col("o_orderdate").alias("date"))
    return store.risk_free(rates, 1996, 1997)


@query("vendor_rows", """SELECT CAST(o_orderdate AS TIMESTAMP) AS time, 'RB2405' AS symbol, 'RB' AS instrument_id, o_totalprice AS open, o_totalprice AS close, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 2 END, o_totalprice) AS settle, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey AS DOUBLE) END, 0) AS volume FROM orders WHERE o_orderkey % 3 <> 0""")
def vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda bad, good: F.when(bad, "n/a").otherwise(good.cast("string"))
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    raw = _orders(spark, sf_dir).select(F.col("o_orderdate").alias("date"), text(key % 3 == 0, price).alias("open"), price.alias("high"), price.alias("low"), price.cast("string").alias("close"), text(key % 5 == 0, price / 2).alias("settle"), text(key % 4 == 0, F.col("o_custkey")).alias("volume"), F.lit(None).cast("string").alias("hold"))
    return store.normalised(raw, "RB2405").select("time", "symbol", "instrument_id", "open", "close", "settle", "volume")


# --- the registry

def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry out of orders: several records a factor and version."""
    o = _orders(spark, sf_dir)
    text = lambda c, n: (F.col(c) % n).cast("string")
    return o.select(
        F.lit("gp").alias("method"), F.concat(F.lit("v"), text("o_orderkey", 3)).alias("version"), F.concat(F.lit("fac"), text("o_custkey", 40)).alias("factor_name"), F.col("o_orderpriority").alias("instrument_id"), F.lit("19960101").alias("start_date"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("end_date"), F.concat(F.lit("Delta(close)"), F.lit("")).alias("formula"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("c"), text("o_orderkey", 2)).alias("collection"), "o_orderkey",
    )


_REC = "r AS (SELECT 'gp' AS method, 'v' || (o_orderkey % 3) AS version, 'fac' || (o_custkey % 40) AS factor_name, o_orderpriority AS instrument_id, '19960101' AS start_date, strftime(o_orderdate, '%Y%m%d') AS end_date, 'Delta(close)' AS formula, o_orderdate AS created_at, 'c' || (o_orderkey % 2) AS collection, o_orderkey FROM orders)"


@query("registry_versions", f"WITH {_REC} SELECT collection, array_to_string(list(DISTINCT version ORDER BY version DESC), ',') AS versions FROM r GROUP BY 1")
def registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.versions(_records(spark, sf_dir)).select("collection", F.array_join("versions", ",").alias("versions"))


@query("registry_latest", f"WITH {_REC} SELECT collection, version, factor_name, instrument_id, end_date FROM (SELECT *, row_number() OVER (PARTITION BY collection, version, factor_name ORDER BY created_at DESC, instrument_id, start_date, end_date) AS n FROM r) WHERE n = 1")
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(_records(spark, sf_dir)).select("collection", "version", "factor_name", "instrument_id", "end_date")


@query("registry_by_name", f"WITH {_REC} SELECT o_orderkey FROM r WHERE factor_name IN ('fac1', 'fac7') AND version = 'v2' AND collection = 'c0'")
def registry_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.wanted(_records(spark, sf_dir), ["fac1", "fac7"], ["v2"], ["c0"]).select("o_orderkey")


@query("registry_pairs", f"WITH {_REC} SELECT o_orderkey FROM r WHERE collection = 'c0' AND version = 'v1' OR collection = 'c1'")
def registry_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filtered(_records(spark, sf_dir), [("c0", "v1"), ("c1", None)]).select("o_orderkey")


@query("registry_other_runs", f"WITH {_REC} SELECT o_orderkey FROM r WHERE NOT (version = 'v1' AND collection = 'c0')")
def registry_other_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.other_runs(_records(spark, sf_dir), "v1", "c0").select("o_orderkey")


@query("registry_renamed", f"WITH {_REC} SELECT o_orderkey, CASE WHEN version = 'v1' THEN 'w' ELSE version END AS version FROM r")
def registry_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rename_version(_records(spark, sf_dir), "v1", "w").select("o_orderkey", "version")


@query("registry_pruned", f"WITH {_REC} SELECT o_orderkey FROM r WHERE NOT (version IN ('v0', 'v2') AND collection = 'c1')")
def registry_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.remove(_records(spark, sf_dir), ["v0", "v2"], "c1").select("o_orderkey")


@query("registry_upserted", f"""WITH {_REC}, k AS (SELECT version, factor_name, instrument_id, end_date, min(o_orderkey) AS o_orderkey FROM r GROUP BY 1, 2, 3, 4), n AS (SELECT version, factor_name, instrument_id, CASE WHEN o_orderkey % 2 = 0 THEN end_date ELSE '20300101' END AS end_date, min(-o_orderkey) AS o_orderkey FROM k WHERE o_orderkey % 5 = 0 GROUP BY 1, 2, 3, 4)
 SELECT coalesce(n.version, k.version) AS version, coalesce(n.factor_name, k.factor_name) AS factor_name, coalesce(n.instrument_id, k.instrument_id) AS instrument_id, coalesce(n.end_date, k.end_date) AS end_date, coalesce(n.o_orderkey, k.o_orderkey) AS o_orderkey FROM k FULL JOIN n ON k.version = n.version AND k.factor_name = n.factor_name AND k.instrument_id = n.instrument_id AND k.end_date = n.end_date""")
def registry_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("version", "factor_name", "instrument_id", "end_date")
    old = _records(spark, sf_dir).groupBy(*keys).agg(F.min("o_orderkey").alias("o_orderkey"))
    new = old.where("o_orderkey % 5 = 0").withColumn("end_date", F.when(F.col("o_orderkey") % 2 == 0, F.col("end_date")).otherwise("20300101")).groupBy(*keys).agg(F.min(-F.col("o_orderkey")).alias("o_orderkey"))
    return store.merged(old, new, keys)


@query("formula_map", "SELECT DISTINCT 'd' || (o_orderkey % 7 + 1) AS factor_name, 'TsDelta(close, ' || (o_orderkey % 7 + 1) || ')' AS formula FROM orders")
def formula_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of orders: a name has one formula in all versions."""
    n = (F.col("o_orderkey") % 7 + 1).cast("string")
    made = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("d"), n).alias("factor_name"), F.concat(F.lit("TsDelta(close, "), n, F.lit(")")).alias("formula"), F.col("o_orderpriority").alias("version"), F.col("o_orderstatus").alias("collection"))
    return spark.createDataFrame(sorted(catalog.formulas(made).items()), "factor_name string, formula string")


def _tested(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, f, "v1", c) for n, f in TESTED.items() for c in ("a", "b")], "factor_name string, formula string, version string, collection string")


@query("factor_values", f"WITH {_V} SELECT m.instrument_id, m.time, round(m.factor_value, 6) + 0.0 AS momentum, round(r.factor_value, 6) + 0.0 AS reversal FROM vals m JOIN vals r ON m.instrument_id = r.instrument_id AND m.time = r.time AND m.factor_name = 'momentum' AND r.factor_name = 'reversal'")
def factor_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = catalog.values(panels.lineitem_panel(spark, sf_dir), _tested(spark), ["momentum", "reversal"], "v1", ["a", "b"])
    return rounded(df.select("instrument_id", "time", "momentum", "reversal"))


@query("fitness_map", f"WITH {_SUM} SELECT factor_name, 'TS IC' AS metric, round(avg(ic), 6) + 0.0 AS value FROM ir WHERE year <> 'all' GROUP BY 1 UNION ALL SELECT factor_name, 'Turnover', round(avg(t), 6) FROM ir WHERE year <> 'all' GROUP BY 1")
def fitness_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = backtest(panels.lineitem_panel(spark, sf_dir), TESTED, check=False)[0]
    return rounded(catalog.fitness(summary, ["TS IC", "Turnover"]).select("factor_name", F.explode("fitness").alias("metric", "v")).select("factor_name", "metric", F.col("v.value").alias("value")))


@query("triplets", f"""WITH {PANEL_SQL}, {_LABEL}, b AS (SELECT instrument_id, avg(coalesce(future_ret, 0)) * 252 AS long FROM lab GROUP BY 1)
 SELECT instrument_id, printf('%.3f', long) || '(' || printf('%.3f', long) || ',' || printf('%.3f', -long) || ')' AS shown FROM b""")
def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = backtest(panels.lineitem_panel(spark, sf_dir), {"reversal": TESTED["reversal"]}, Options(baselines=True), check=False)[0].where("year = 'all'")
    value = lambda n: F.max(F.when(F.col("factor_name") == n, F.col("`Gross Return`")))
    return df.groupBy("instrument_id").agg(value("long").alias("long"), value("short").alias("short")).select("instrument_id", metrics.triplet(F.col("long"), F.col("long"), F.col("short"), "%.3f").alias("shown"))


@query("top_return", f"WITH {_V}, k AS (SELECT time, future_ret, row_number() OVER (PARTITION BY time ORDER BY factor_value DESC, instrument_id) AS r FROM vals WHERE factor_name = 'reversal' AND factor_value IS NOT NULL) SELECT time, round(avg(future_ret), 6) + 0.0 AS ret FROM k WHERE r <= 3 GROUP BY 1")
def top_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .backtest import labelled

    frame = labelled(panels.lineitem_panel(spark, sf_dir), {"reversal": TESTED["reversal"]}, check=False).where("factor_value is not null")
    return rounded(learning.top_return(frame.withColumnRenamed("factor_value", "prediction"), 3))


@query("prediction_backtest", f"WITH {_SUM} SELECT instrument_id, year, round(gr, 6) + 0.0 AS gross_return, round(ic, 6) + 0.0 AS ts_ic FROM ir WHERE factor_name = 'reversal'")
def prediction_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that are a known factor's values, so that SQL can say what their backtest gives."""
    from .backtest import labelled

    made = labelled(panels.lineitem_panel(spark, sf_dir), {"reversal": TESTED["reversal"]}, check=False).withColumnRenamed("factor_value", "prediction").drop("factor_name")
    return rounded(learning.backtested(made, "signal").select("instrument_id", "year", F.col("`Gross Return`").alias("gross_return"), F.col("`TS IC`").alias("ts_ic")))


@query("monitor_return", f"WITH {_V} SELECT instrument_id, factor_name, round(sum(net_ret), 6) + 0.0 AS cumulative_return, round(avg(net_ret) * 252, 6) + 0.0 AS annualized_return FROM series WHERE time >= TIMESTAMP '1998-01-01' GROUP BY 1, 2")
def monitor_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .backtest import labelled

    return rounded(metrics.since(metrics.daily(labelled(panels.lineitem_panel(spark, sf_dir), TESTED, check=False)), "1998-01-01"))
