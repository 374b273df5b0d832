"""Ordered folds: what each row does depends on all rows before it, so rows stream through a state.

Rows are dealt by their key and sorted; a task meets a key's rows in order, over any number
of Arrow batches, and holds that key's state alone. No key's rows are gathered in memory.
A fold is sequential by its nature: one key's rows are one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows sent on at a time.
_OUT = 5000


def _values(column: pa.Array) -> list:
    """A column's values; vectors as NumPy rows, all else as plain Python values."""
    kind = column.type
    if not (pa.types.is_list(kind) and pa.types.is_floating(kind.value_type)) or column.values.null_count:
        return column.to_pylist()
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] if valid else None for a, b, valid in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]


def ordered_fold(rows: DataFrame, keys: list[str], order: list, schema: str, step: Callable[[Any, dict], tuple[Any, list[tuple]]], finish: Callable[[tuple, Any], list[tuple]] | None = None) -> DataFrame:
    """Fold each key's rows in order and return what the steps and the end of a key give.

    step(state, row) returns the state after the row and the output rows (tuples of schema)
    it gives; a key's first state is None. finish(key, state) gives the rows after a key's
    last one. Ties in order are the caller's to break; a null key is a key of its own.
    """
    shape = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, state, seen = None, None, False
        for batch in batches:
            names = batch.schema.names
            for values in zip(*map(_values, batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                this = tuple(row[k] for k in keys)
                if not seen or this != key:
                    if seen and finish:
                        out += finish(key, state)
                    key, state, seen = this, None, True
                state, given = step(state, row)
                out += given
                if len(out) >= _OUT:
                    yield batch_of(out)
                    out = []
        if seen and finish:
            out += finish(key, state)
        if out:
            yield batch_of(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
