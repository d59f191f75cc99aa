"""The detection cursor as a stream: each dataset's flows are judged window by window as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cursor_stream(flags: DataFrame, by: str, order: str, flag: str, size: int = 30, back: int = 5) -> DataFrame:
    """Windows (dataset, window, skip, start, duration) once all of a window's rows are there.

    Rows of a dataset must arrive in order. State holds the rows from the cursor on: fewer than a window's worth
    after each batch."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        skip, window, held = state.get if state.exists else (0, 0, [])
        held, out = [bool(x) for x in held], []
        for pdf in batches:
            held += [bool(x) for x in pdf.sort_values(order)[flag]]
            while len(held) >= size:
                part = held[:size]
                if True in part:
                    a = part.index(True)
                    b = next((k for k in range(a, size) if not part[k]), size) - 1
                    out.append((key[0], window, skip, a + 1, b - a + 1))
                    step_by = b + 1
                else:
                    out.append((key[0], window, skip, -1, -1))
                    step_by = size - back
                skip, window, held = skip + step_by, window + 1, held[step_by:]
        state.update((skip, window, held))
        yield pd.DataFrame(out, columns=[by, "window", "skip", "start", "duration"])

    kind = flags.schema[by].dataType.simpleString()
    return flags.select(by, order, flag).groupBy(by).applyInPandasWithState(
        step, f"`{by}` {kind}, window long, skip long, start long, duration long", "skip long, window long, held array<boolean>",
        "append", GroupStateTimeout.NoTimeout,
    )


def detection_stream(flows: DataFrame, by: str, order: str, judge: Callable[[pd.DataFrame], tuple[int, int] | None], size: int = 30, back: int = 5) -> DataFrame:
    """The same with any judge, as operators.queue.DetectionCursor has it: (dataset, window, skip, start, duration, next, status,
    error). A window whose judge raises is a failed row and the cursor passes over it.

    The stream's checkpoint is the cursor's control row: a stream that is stopped or dies goes on from its last committed
    batch, and a new checkpoint folder is a reset. State holds the rows from the cursor on, fewer than a window's."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        skip, window, data = state.get if state.exists else (0, 0, None)
        parts = [] if data is None else [pa.ipc.open_stream(data).read_pandas()]
        rows, out = pd.concat([*parts, *(p.sort_values(order) for p in batches)], ignore_index=True), []
        while len(rows) >= size:
            start, duration, on, status, error = -1, -1, size - back, "processed", None
            try:
                if (found := judge(rows.iloc[:size].reset_index(drop=True))) is not None:
                    start, duration = map(int, found)
                    on = min(size, max(1, start + duration - 1))
            except Exception as e:  # whatever a judge raises is that window's result
                status, error = "failed", f"{type(e).__name__}: {e}"[:500]
            out.append((key[0], window, skip, start, duration, skip + on, status, error))
            skip, window, rows = skip + on, window + 1, rows.iloc[on:]
        table = pa.Table.from_pandas(rows, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        state.update((skip, window, sink.getvalue().to_pybytes()))
        yield pd.DataFrame(out, columns=[by, "window", "skip", "start", "duration", "next", "status", "error"])

    kind = flows.schema[by].dataType.simpleString()
    return flows.groupBy(by).applyInPandasWithState(
        step, f"`{by}` {kind}, window long, skip long, start long, duration long, next long, status string, error string",
        "skip long, window long, held binary", "append", GroupStateTimeout.NoTimeout,
    )
