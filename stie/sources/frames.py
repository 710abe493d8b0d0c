"""A data source for frames: one row a frame, from files of frame times.

Decoding pictures needs a decoder that isn't part of this library; `decode` in the options can
name a function "module:function" that turns a file's bytes into (index, seconds) pairs. By default
a file holds one number a line: the seconds of each frame.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def times_of_lines(content: bytes) -> Iterator[tuple[int, float]]:
    yield from enumerate(float(x) for x in content.decode().split())


def read_frames(spark: SparkSession, path: str, pattern: str = "*", decode: str = "stie.sources.frames:times_of_lines") -> DataFrame:
    """clip_id, frame_index, ts relative to the first frame; a time that doesn't grow is an error."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("clip_id"), "content")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, name = decode.split(":")
        read = getattr(importlib.import_module(module), name)
        for batch in batches:
            for clip, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(read(content.as_py()))
                first = rows[0][1] if rows else 0.0
                for (_, a), (i, b) in zip(rows, rows[1:], strict=False):
                    if b <= a:
                        raise ValueError(f"{clip}: frame {i} is at {b} s, not after {a} s")
                yield pa.RecordBatch.from_arrays([pa.array([clip] * len(rows)), pa.array([i for i, _ in rows], pa.int64()), pa.array([t - first for _, t in rows], pa.float64())], ["clip_id", "frame_index", "ts"])

    return files.mapInArrow(of_batches, "clip_id string, frame_index long, ts double")
