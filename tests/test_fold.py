"""Kernels over tables and streams: against pandas, across batches, and the stream against the table."""

import numpy as np
import pandas as pd
import pytest

from tallgrass.functions.formula import Kind
from tallgrass.operators import extend, fold
from tallgrass.operators.compiler import evaluate
from tallgrass.streaming import state


def series(spark, many=500):
    rng = np.random.default_rng(4)
    rows = [(f"i{k}", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=t), None if rng.random() < 0.03 else float(np.round(rng.normal(100, 3), 1))) for k in range(3) for t in range(many)]
    frame = pd.DataFrame(rows, columns=["instrument_id", "time", "close"])
    rows = [(i, t.to_pydatetime(), v) for i, t, v in rows]
    return spark.createDataFrame(rows, "instrument_id string, time timestamp, close double").repartition(5), frame


def entropy(w):
    d, _ = np.histogram(w, bins=10, density=True)
    d = d[d > 0]
    return -(d * np.log(d + 1e-10)).sum()


def test_wide_windows_against_pandas(spark):
    df, frame = series(spark)
    got = evaluate(df, {"rank": "TsRank(close, 100)", "near": "TsRank(close, 20)", "entropy": "TsEntropy(close, 80)", "ema": "Ema(close, 9)"}).toPandas().sort_values(["instrument_id", "time"])
    by = frame.groupby("instrument_id").close
    want = {
        "rank": by.transform(lambda s: s.rolling(100).rank() / 100), "near": by.transform(lambda s: s.rolling(20).rank() / 20),
        "entropy": by.transform(lambda s: s.rolling(80).apply(entropy)), "ema": by.transform(lambda s: s.ewm(span=9, adjust=False).mean()),
    }
    both = evaluate(df.withColumn("open", df["close"] % 7), {"corr": "TsRankCorr(close, open, 70)"}).toPandas().sort_values(["instrument_id", "time"])
    pairs = frame.assign(open=frame.close % 7)
    for (_, g), (_, p) in zip(both.groupby("instrument_id"), pairs.groupby("instrument_id"), strict=True):
        for k in range(0, len(p), 37):
            w = p.iloc[max(0, k - 69) : k + 1].dropna()
            want_k = w.close.rank().corr(w.open.rank()) if k >= 69 else None
            got_k = g["corr"].iloc[k]
            assert (want_k is None) == (got_k is None or got_k != got_k) and (want_k is None or abs(got_k - want_k) < 1e-9)
    for name, values in want.items():
        assert np.allclose(got[name].astype(float), values, equal_nan=True), name


def test_small_batches_carry_the_state(spark):
    df, _ = series(spark, 120)
    kernels = {"a": (fold.SlidingRank(70), (df["close"],)), "b": (fold.ExponentialMean(5), (df["close"],)), "c": (fold.RunningProduct(), (df["close"] / 100,))}
    whole = fold.folded(df, kernels).orderBy("instrument_id", "time").collect()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert fold.folded(df, kernels).orderBy("instrument_id", "time").collect() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


class Streak(fold.Kernel):
    """How many values in a row have risen."""

    def start(self):
        return np.nan, 0

    def step(self, held, x):
        last, many = held
        out = np.empty(len(x))
        for k, v in enumerate(x):
            many = many + 1 if v > last else 0
            last = v if v == v else last
            out[k] = many
        return out, (last, many)


def test_kernels_become_operators(spark):
    df, frame = series(spark, 90)

    def plain(s):
        out, last, many = [], np.nan, 0
        for v in s:
            many = many + 1 if v > last else 0
            last = v if v == v else last
            out.append(many)
        return pd.Series(out, s.index, dtype=float)

    with extend.registered("Streak", kernel=Streak, kind=Kind.RATIO), extend.registered("Placed", kernel=fold.SlidingRank, windows=1, kind=Kind.RATIO):
        got = evaluate(df, {"s": "TsMean(Streak(close), 3)", "p": "Sub(Placed(close, 10), TsRank(close, 10))"}).toPandas().sort_values(["instrument_id", "time"])
        with pytest.raises(ValueError):
            extend.register("Streak", kernel=Streak)
    want = frame.groupby("instrument_id").close.transform(lambda s: plain(s).rolling(3).mean())
    assert np.allclose(got.s, want, equal_nan=True) and np.nanmax(np.abs(got.p.astype(float))) < 1e-12
    for bad in ({}, {"build": abs, "kernel": Streak}):
        with pytest.raises(ValueError):
            extend.register("Bad", **bad)
    with pytest.raises(TypeError):
        extend.register("Bad", kernel=lambda: 3)


def test_a_stream_is_its_table(spark, tmp_path):
    df, frame = series(spark, 150)
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    kernels = {"ema": (fold.ExponentialMean(6), ("close",)), "rank": (fold.SlidingRank(64), ("close",))}
    days = sorted(frame.time.dt.date.unique())
    for a, z in ((0, 2), (2, 3), (1, 3), (3, len(days))):  # the third part is a replay
        lo, hi = pd.Timestamp(days[a]), pd.Timestamp(days[z - 1]) + pd.Timedelta(days=1)
        df.where((df["time"] >= lo.to_pydatetime()) & (df["time"] < hi.to_pydatetime())).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        state.folded(stream, kernels).writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").outputMode("append").trigger(availableNow=True).start(out).awaitTermination(120)
    order = ["instrument_id", "time"]
    got = spark.read.parquet(out).orderBy(*order).collect()
    want = fold.folded(df, {name: (k, tuple(df[c] for c in cs)) for name, (k, cs) in kernels.items()}).select(*spark.read.parquet(out).columns).orderBy(*order).collect()
    same = lambda a, b: a == b or (a is None or a != a) and (b is None or b != b)
    assert len(got) == len(want) == len(frame)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
