"""Ordered folds per key, for what can't be said without a running state.

The rows are dealt by key and sorted, and a task reads them as a stream: it holds one Arrow batch and the
rows of one key (a track, a clip's pair), however many keys there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """step() gets the rows of one key, in order, and gives the rows of the result."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in found], f.type) for f in arrow], schema=arrow)

    def of_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, out = [], None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if group and key != last:
                    out += step(group)
                    group = []
                group.append(row)
                last = key
            if out:
                yield batch_of(out)
                out = []
        out += step(group) if group else []
        if out:
            yield batch_of(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(of_stream, schema)


def picked(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[dict[str, np.ndarray]], np.ndarray], columns: list[str]) -> DataFrame:
    """The rows that step() picks: it gets `columns` of the rows of one key, in order, as arrays, and gives places in them. Rows with a null key go."""

    def of_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, key = [], None  # what came so far of the key that the stream is in

        def closed() -> Iterator[pa.RecordBatch]:
            if open_:
                table = pa.Table.from_batches(open_).combine_chunks()
                yield from table.take(pa.array(step({c: table.column(c).to_numpy() for c in columns}))).to_batches()
                open_.clear()

        for batch in batches:
            values = [batch.column(k).to_pylist() if pa.types.is_nested(batch.column(k).type) else batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(batch.num_rows, dtype=bool)
            for v in values:
                new[1:] |= np.asarray(v[1:] != v[:-1])
            bounds = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                if a < z:
                    now = tuple(v[a] for v in values)
                    if now != key:
                        yield from closed()
                        key = now
                    open_.append(batch.slice(a, z - a))
        yield from closed()

    return rows.dropna(subset=keys).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(of_stream, rows.schema)


def held_vehicle(at: np.ndarray, vehicle: np.ndarray, rank: np.ndarray, max_gap: float = 1.0, switch_margin: float = 0.05, hold: bool = False) -> np.ndarray:
    """One row a frame for one person: the best vehicle, unless the last one is nearly as good.

    Rows are in the order of at (a frame's time), rank, vehicle. Where the best one stays the same and no time is missing, nothing is
    decided: only frames with another best vehicle than the last one are looked into. With `hold`, a frame
    in which the last vehicle is missing is skipped while it is recent.
    """
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    ends, times, best = np.append(first[1:], len(at)), at[first], vehicle[first]
    # where the best vehicle changes, or time is missing
    turns = np.append(np.flatnonzero((best[1:] != best[:-1]) | (times[1:] - times[:-1] > max_gap + 1e-9)) + 1, len(first))
    taken, last, since, n = [], None, None, 0
    while n < len(first):
        if last is not None and best[n] != last and times[n] - since <= max_gap + 1e-9:
            same = np.flatnonzero(vehicle[first[n] : ends[n]] == last)
            if len(same) and rank[first[n] + same[0]] <= rank[first[n]] + switch_margin:
                taken.append(np.array([first[n] + same[0]]))
                since = times[n]
                n += 1
                continue
            if not len(same) and hold:
                n += 1
                continue
        stop = turns[np.searchsorted(turns, n, side="right")]
        taken.append(first[n:stop])
        last, since, n = best[n], times[stop - 1], stop
    return np.concatenate(taken) if taken else np.zeros(0, dtype=np.int64)
