"""Kernels over streams: their state is kept from micro-batch to micro-batch, by instrument."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fold import Kernel


def _stepped(kernels: Mapping[str, tuple[Kernel, tuple[str, ...]]], time: str, columns: list[str]):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, states = (state.get[0], pickle.loads(state.get[1])) if state.exists else (None, {name: kernel.start() for name, (kernel, _) in kernels.items()})
        rows = pd.concat(list(parts), ignore_index=True).drop_duplicates(time).sort_values(time)
        rows = rows[rows[time] > last] if last is not None else rows
        if rows.empty:
            return
        for name, (kernel, operands) in kernels.items():
            rows[name], states[name] = kernel.step(states[name], *(rows[c].to_numpy(dtype=float, na_value=np.nan) for c in operands))
        state.update((rows[time].iloc[-1].to_pydatetime(), pickle.dumps(states)))
        yield rows[columns]

    return run


def folded(stream: DataFrame, kernels: Mapping[str, tuple[Kernel, tuple[str, ...]]], by: str = "instrument_id", time: str = "time") -> DataFrame:
    """The stream with a column for each kernel (name -> kernel, operand columns) over each series in order of time.

    Rows at or before the last time that a series has been taken to do not count: a replay changes nothing, and what comes
    too late is left out. Within a micro-batch rows are put in order, so that the result is the table's (fold.folded) as long
    as later batches hold later times; a series' rows of one micro-batch are in memory together, and its state always."""
    columns = [*stream.columns, *kernels]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in stream.dtypes), *(f"`{k}` double" for k in kernels)])
    return stream.groupBy(by).applyInPandasWithState(_stepped(dict(kernels), time, columns), schema, f"{time} timestamp, held binary", "append", GroupStateTimeout.NoTimeout)
