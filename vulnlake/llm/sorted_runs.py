"""Running values and predecessors over a table that Spark has sorted, without a window that holds a key whole.

The table is range-sorted and checkpointed; each sorted part is then read as a stream.  A first pass over the parts
yields one row for each (its last key and what has run up for it), which is all that is ever brought together; a second
pass adds what the parts before have left.  A key may fill any number of parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.session import cut_lineage

SLICE = "_slice"


def sorted_parts(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows in order, each with the number of its sorted part."""
    return cut_lineage(df.orderBy(*order).withColumn(SLICE, F.spark_partition_id()))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _run_up(key: np.ndarray, value: np.ndarray, op: np.ufunc, last: int | None, carry: int) -> np.ndarray:
    """Running value per key over one batch; ``carry`` is what key ``last`` has before it."""
    out = op.accumulate(value)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    before = np.concatenate([[0], out])[begins]  # what ran up in front of each key
    undo = np.repeat(before, np.diff(np.concatenate([begins, [len(key)]])))
    out = out ^ undo if op is np.bitwise_xor else out - undo
    if last is not None and key[0] == last:
        n = begins[1] if len(begins) > 1 else len(key)
        out[:n] = op(out[:n], np.int64(carry))
    return out


def running(parts: DataFrame, key: str, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Add running values within ``key``: {new column: (column, "sum" or "xor")}; all are 64-bit, keys not null."""
    ops = {n: (c, np.bitwise_xor if how == "xor" else np.add) for n, (c, how) in values.items()}

    def stream(batches: Iterable[pa.RecordBatch], start: Callable[[int], tuple[int | None, list[int]]]):
        last, carry = None, [0] * len(ops)
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                last, carry = start(int(_column(batch, SLICE)[0]))
                begun = True
            keys = _column(batch, key)
            ran = [_run_up(keys, _column(batch, c), op, last, carry[i]) for i, (c, op) in enumerate(ops.values())]
            last, carry = int(keys[-1]), [int(r[-1]) for r in ran]
            yield batch, keys, ran

    def summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = at = None
        for batch, keys, ran in stream(batches, lambda _: (None, [0] * len(ops))):
            first = int(keys[0]) if first is None else first
            at = (int(_column(batch, SLICE)[0]), int(keys[-1]), [int(r[-1]) for r in ran])
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"slice": at[0], "first": first, "last": at[1], "left": at[2]}])

    ends = sorted(parts.mapInArrow(summary, "slice long, first long, last long, left array<long>").collect())
    carries: dict[int, tuple[int, list[int]]] = {}
    last, left = None, [0] * len(ops)
    for end in ends:
        carries[end["slice"]] = (last, left)
        if end["first"] == end["last"] == last:  # the part holds nothing but the key that is open
            left = [int(op(np.int64(a), np.int64(b))) for a, b, (_, op) in zip(left, end["left"], ops.values(), strict=True)]
        else:
            left = end["left"]
        last = end["last"]
    known = parts.sparkSession.sparkContext.broadcast(carries)

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, ran in stream(batches, lambda s: known.value[s]):
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(r) for r in ran)], [*batch.schema.names, *ops])

    fields = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes)
    return parts.mapInArrow(added, fields + "".join(f", `{n}` long" for n in ops))


def previous(parts: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Add ``value`` of the row before, null where that one has another key; all are 64-bit and not null."""

    def summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if batch.num_rows:
                at = {"slice": int(_column(batch, SLICE)[0]), "key": int(_column(batch, key)[-1]), "value": int(_column(batch, value)[-1])}
        if at is not None:
            yield pa.RecordBatch.from_pylist([at])

    before, carries = (None, 0), {}
    for end in sorted(parts.mapInArrow(summary, "slice long, key long, value long").collect()):
        carries[end["slice"]] = before
        before = (end["key"], end["value"])
    known = parts.sparkSession.sparkContext.broadcast(carries)

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            last = known.value[int(_column(batch, SLICE)[0])] if last is None else last
            keys, values = _column(batch, key), _column(batch, value)
            shifted = np.concatenate([[last[1]], values[:-1]])
            same = np.concatenate([[last[0] is not None and keys[0] == last[0]], keys[1:] == keys[:-1]])
            last = (int(keys[-1]), int(values[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shifted.astype(np.int64), mask=~same)], [*batch.schema.names, name])

    fields = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes)
    return parts.mapInArrow(added, f"{fields}, `{name}` long")
