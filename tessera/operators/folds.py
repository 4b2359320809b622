"""Ordered folds: what depends on the rows before it in a key, one row at a time.

The rows are dealt by key, sorted within each partition and streamed, so that millions
of small keys cost no more than a few large ones and no key is ever held whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], object], name: str, kind: str) -> DataFrame:
    """df with one more column: for each row, in order, what step(state, row) returns;
    start() makes the state at the first row of a key. row holds the columns of df."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = [df.columns.index(k) for k in keys]
    arrow = to_arrow_type(DataType.fromDDL(kind))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for b in stream:
            out = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                key = tuple(row[i] for i in at)
                if state is None or key != last:
                    state, last = start(), key
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow)], names=[*b.schema.names, name])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{fields}, `{name}` {kind}")
