"""Running values along a key's rows: in one task a key, or, for keys too long for a task, bucket by bucket.

With a bucket, the rows of a key are cut by time, and each (key, bucket) is scanned apart. A bucket's total
(a maximum, a sum, or a last value) is one row; the totals of a key are scanned in turn, and what all earlier buckets
carry over is joined back. So a key spreads over as many tasks as it has buckets, and the result is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """A running `max`, `sum` or `last` (not null) of a value, with the row itself or up to the one before. `order` within the key begins with the time; backwards, it is read from the end."""

    kind: str
    value: Column
    order: tuple[Column | str, ...]
    own: bool = True
    backwards: bool = False

    def over(self, window: W) -> Column:
        frame = window.rowsBetween(W.unboundedPreceding, 0 if self.own else -1)
        return {"max": F.max, "sum": F.sum, "last": lambda v: F.last(v, ignorenulls=True)}[self.kind](self.value).over(frame)

    def total(self) -> Column:
        if self.kind != "last":
            return {"max": F.max, "sum": F.sum}[self.kind](self.value)
        # of rows at the same time, any may be the last one, here as in a window
        pick = F.min_by if self.backwards else F.max_by
        return pick(self.value, F.when(self.value.isNotNull(), F.col("_at")))

    def carry(self, total: Column, keys: list[str]) -> Column:
        window = W.partitionBy(*keys).orderBy(F.desc("_part") if self.backwards else F.col("_part"))
        return Running(self.kind, total, (), own=False).over(window)

    def joined(self, local: Column, carried: Column) -> Column:
        if self.kind == "max":
            return F.greatest(local, carried)
        if self.kind == "last":
            return F.coalesce(local, carried)
        return F.when(local.isNull(), carried).when(carried.isNull(), local).otherwise(local + carried)


def scanned(rows: DataFrame, keys: list[str], at: Column, bucket: float | None = None, **running: Running) -> DataFrame:
    """rows with a column for each of `running`. at: a row's time, by which buckets are cut; it must go up with every order."""
    if bucket is None:
        return rows.withColumns({n: r.over(W.partitionBy(*keys).orderBy(*r.order)) for n, r in running.items()})
    cut = rows.withColumns({"_at": at, "_part": F.floor(at / bucket)})
    local = cut.withColumns({f"_local_{n}": r.over(W.partitionBy(*keys, "_part").orderBy(*r.order)) for n, r in running.items()})
    totals = cut.groupBy(*keys, "_part").agg(*[r.total().alias(f"_total_{n}") for n, r in running.items()])
    carried = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_of"), *[r.carry(F.col(f"_total_{n}"), keys).alias(f"_carried_{n}") for n, r in running.items()])
    same = F.col("_part").eqNullSafe(F.col("_of"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    both = local.join(carried, same)
    return both.select(*rows.columns, *[r.joined(F.col(f"_local_{n}"), F.col(f"_carried_{n}")).alias(n) for n, r in running.items()])
