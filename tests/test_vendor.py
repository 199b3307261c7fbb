"""The vendor source and the update of many instruments in one plan, against updates one by one."""

import os
from datetime import date

import pytest

from tallgrass.plans import rollover
from tallgrass.sources import store, vendor
from tests import fake_vendor


@pytest.fixture
def log(spark, tmp_path):
    where = str(tmp_path / "log")
    os.makedirs(where)
    spark.sparkContext.environment["FAKE_VENDOR_LOG"] = where
    yield lambda: sorted(open(os.path.join(where, f)).read() for f in os.listdir(where))
    spark.sparkContext.environment.pop("FAKE_VENDOR_LOG")


def test_update_of_many_is_that_of_each(spark, tmp_path, log):
    def fetch(instrument, first, last):
        made = [(instrument, *r) for r in fake_vendor.rows(instrument, first, last)]
        return spark.createDataFrame(made, "instrument_id string, time timestamp, symbol string, open double, high double, low double, close double, settle double, volume double, position double")

    stitch = lambda rows, factors: rollover.stitched(rows, "2020-01-01", next(iter(factors.values())))
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    asked = []
    for start, end, wanted in ((date(2024, 1, 5), date(2024, 1, 16), ["A", "C"]), (date(2024, 1, 3), date(2024, 2, 2), ["A", "BB", "C"])):
        ranges = vendor.update(spark, many, "tests.fake_vendor:fetch", start, end, wanted)
        assert ranges == store.update_prices(spark, one, fetch, stitch, start, end, wanted)
        asked += [f"{i} {a} {z}" for i, a, z in ranges]
    assert log() == sorted(asked)  # each range once
    a, b = (spark.read.parquet(p).select("instrument_id", "time", "symbol", "open", "weighted_factor", "is_rollover").orderBy("instrument_id", "time").collect() for p in (one, many))
    assert len(a) == len(b) == 3 * 31
    for x, y in zip(a, b, strict=True):
        assert x[:4] == y[:4] and x[5] == y[5] and x[4] == pytest.approx(y[4])
    assert any(r["is_rollover"] for r in b) and len({round(r["weighted_factor"], 9) for r in b}) > 2
    assert vendor.update(spark, many, "tests.fake_vendor:fetch", date(2024, 1, 3), date(2024, 2, 2), ["A", "BB", "C"]) == []
    assert len(vendor.update(spark, many, "tests.fake_vendor:fetch", date(2024, 1, 3), date(2024, 1, 4), ["A"], whole=True)) == 1


def test_reading_partitions_and_failures(spark, log):
    ranges = [(i, date(2024, 1, 1), date(2024, 1, 3)) for i in ("A", "B", "D")]
    df = vendor.read(spark, "tests.fake_vendor:fetch", ranges[:1] + ranges[2:])
    assert df.rdd.getNumPartitions() == 2 and df.count() == 12 and df.where("time < '2024-01-01'").isEmpty()
    assert vendor.read(spark, "tests.fake_vendor:fetch", ranges, rangesPerPartition="2").rdd.getNumPartitions() == 2
    assert vendor.read(spark, "tests.fake_vendor:fetch", []).count() == 0
    left = vendor.read(spark, "tests.fake_vendor:failing", ranges, onError="skip", pause="0", attempts="2")
    assert {r[0] for r in left.select("instrument_id").distinct().collect()} == {"A", "D"}
    assert log().count("try B") == 2
    with pytest.raises(Exception, match="no answer"):
        vendor.read(spark, "tests.fake_vendor:failing", ranges, pause="0", attempts="1").count()
    with pytest.raises(Exception, match="option client"):
        spark.read.format("vendor").load().count()
