"""A search that is stopped and taken up again, and labels of longer periods."""

from bisect import bisect_left

import pandas as pd
import pytest

from tallgrass.plans import mining, runs
from tallgrass.sources import panels


@pytest.fixture(scope="module")
def panel(spark):
    return panels.lineitem_panel(spark, "/root/testdata/sf0.001").persist()


class Stopping(runs.Run):
    """Asks for its own end after a generation, or while one runs."""

    at, within = 0, False

    def save(self, generation, state):
        super().save(generation, state)
        if generation == self.at and not self.within:
            self.stop()

    def stopping(self):
        if self.within and self.latest() and not super().stopping():
            super().stop()
            raise RuntimeError("cancelled")  # as a job does whose tag is cancelled
        return super().stopping()


def test_a_stopped_search_goes_on_to_the_same_result(spark, panel, tmp_path):
    search = mining.Search(population=4, generations=2, max_depth=2, seed=3, elite=3)
    want = mining.mine(panel, search)
    for name, within in (("between", False), ("within", True)):
        run = Stopping(spark, str(tmp_path), name)
        run.within = within
        early = mining.mine(panel, search, run=run)
        assert len(early) <= len(want) and run.status().collect()[-1]["state"] == "stopped"
        again = runs.Run(spark, str(tmp_path), name)
        assert mining.mine(panel, search, run=again) == early  # the mark still stands
        again.resume()
        assert mining.mine(panel, search, run=again) == want
        states = [(r["generation"], r["state"]) for r in again.status().collect()]
        assert [g for g, s in states if s == "running"] == [0, 1] and states[-1] == (2, "done")
    seen = {r["run"]: r["state"] for r in runs.overview(spark, str(tmp_path)).collect()}
    assert seen == {"between": "done", "within": "done"}
    with pytest.raises(ValueError):
        runs.Run(spark, str(tmp_path), "../x")
    assert runs.Run(spark, str(tmp_path), "none").status().count() == 0 and runs.Run(spark, str(tmp_path), "none").latest() is None


@pytest.mark.parametrize("method,step", [("1W", pd.DateOffset(days=7)), ("1M", pd.DateOffset(months=1)), ("1Q", pd.DateOffset(months=3))])
def test_labels_of_longer_periods(panel, method, step):
    got = panels.future_return(panel, method).toPandas().sort_values(["instrument_id", "time"]).reset_index(drop=True)
    assert list(got.columns) == [*panel.columns, "future_ret"]
    some = 0
    for _, g in got.groupby("instrument_id"):
        times, opens = list(g.time), list(g.open)
        for k, label in enumerate(g.future_ret):
            want = None
            if k + 1 < len(times):
                at = bisect_left(times, times[k + 1] + step)
                if at < len(times) and times[at] <= times[k + 1] + step + step:
                    want = opens[at] / opens[k + 1] - 1
            assert (want is None) == (label != label) and (want is None or label == pytest.approx(want))
            some += want is not None
    assert some > 100
    with pytest.raises(ValueError):
        panels.future_return(panel, "1H")
