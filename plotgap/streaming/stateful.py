"""Keyed state over streams: one small record per key, rows of a batch in arrival order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def keyed_fold(stream: DataFrame, keys: Sequence[str], order: Sequence[str], out_schema: str, state_schema: str,
               step: Callable[[tuple | None, tuple], tuple[tuple | None, tuple]], columns: Sequence[str], forget_s: float | None = None) -> DataFrame:
    """Fold every row of a key, in order, through ``step(state, row) -> (state, output row)``.

    ``columns`` are the row fields handed to ``step``. The state is one tuple per key, kept in
    the checkpointed state store. Keys silent for ``forget_s`` of processing time are dropped.
    """
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        rows = [row for batch in batches for row in zip(*[batch[c].tolist() for c in wanted])]
        rows.sort(key=lambda row: row[n:])
        out = []
        for row in rows:  # plain tuples: with many keys of few rows, data frames cost more than the work itself
            held, emitted = step(held, tuple([None if v != v else v for v in row[:n]]))
            out.append(emitted)
        if held is not None:
            state.update(tuple(held))
        if forget_s is not None:
            state.setTimeoutDuration(int(forget_s * 1000))
        values = [[None if v is None else int(v) for v in column] if whole else column for whole, column in zip(wholes, zip(*out))]
        yield pd.DataFrame(dict(zip(names, values)), dtype=object)
    names, types = zip(*[f.split() for f in out_schema.split(",")])
    wholes, n = [kind in ("bigint", "int") for kind in types], len(columns)
    wanted = [*columns, *order]
    timeout = GroupStateTimeout.NoTimeout if forget_s is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(*keys).applyInPandasWithState(fold, out_schema, state_schema, "append", timeout)
