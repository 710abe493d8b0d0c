"""Operator 8, mixing sources to target weights.

Words are summed per source; the sources, in code-point order with null last, weigh 1, 2,
3, 1, 2, ... and share all words. A target stops at `most` times its source's words, and the
excess is shared by weight among the others until none is above. The rate of a source is
target / words, and each of its documents is emitted floor(rate) times, plus once more if a
uniform number made from its id falls below the fraction. No document comes more than `most`
times.

Long texts count with all their words. An empty table gives an empty result. Columns other than those
named are passed through by mixed_documents(), but for one named `copy`. Empty and null texts have size 0 and take nothing. A null source is a source of its own. The number of a row hangs on the seed,
its id, source and text, and its place among the rows that are equal in these: rows that share an id, or have none, or repeat, are
drawn apart, and reruns agree. Only repeated rows are sorted for that, spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.llm.common import placed, reliable, small, table

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, most: int = 3, weights: int = 3) -> DataFrame:
    """source, source_size, target. sizes: source, size. Only the sums per source are ordered."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = by_source.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % weights + 1)
    cap = (most * F.col("source_size")).cast("double")
    by_room = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, rest = by_room.rowsBetween(W.unboundedPreceding, -1), by_room.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    room = (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))).cast("double")
    full = named.withColumn("full", cap * F.sum("weight").over(rest) <= room * F.col("weight"))
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(everything), F.lit(0))
    share = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    return full.select("source", "source_size", F.when(F.col("full"), cap).otherwise(left.cast("double") * F.col("weight") / share).alias("target"))


def uniform(key: Column, nth: Column, seed: str) -> Column:
    """A number in [0, 1) for the nth row of a key: 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), nth.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def key_of(doc_id: Column, source: Column, text: Column) -> Column:
    told = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.md5(F.concat(told(doc_id), told(source), told(text)).cast("binary"))


def numbered(rows: DataFrame) -> DataFrame:
    """key, row, and nth: the place, from 0, among the rows of one key. rows: key, row."""
    again = reliable(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    if again.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    again = small(again)
    repeated = rows.join(again, "key", "left_semi").select(F.col("key").alias("tree"), "row", F.xxhash64("row").alias("print"))
    return rows.join(again, "key", "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(placed(repeated, ["print"]).select(F.col("tree").alias("key"), "row", F.col("at").alias("nth")))


def _copies(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """row, source_size, target, rate, copies. rows: key, row (with its source)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = F.when(uniform(F.col("key"), F.col("nth"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    targets = small(targets.withColumnRenamed("source", "of"))
    return numbered(rows).join(targets, F.col("row.source").eqNullSafe(F.col("of"))).withColumn("rate", rate).select("row", "source_size", "target", "rate", (F.floor("rate") + extra).cast("int").alias("copies"))


def mix(documents: DataFrame, seed: str = "mix", most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies of every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = reliable(documents.select(key_of(F.col("doc_id"), F.col("source"), F.col("text")).alias("key"), F.struct("doc_id", "source", size.alias("size")).alias("row")))
    targets = reliable(source_targets(sizes.select("row.source", "row.size"), most))
    return _copies(sizes, targets, seed).select("row.*", "source_size", "target", "rate", "copies")


def mixed_documents(documents: DataFrame, seed: str = "mix", most: int = 3) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with `copy` from 0 in place of any column of that name."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    targets = reliable(source_targets(documents.select("source", size.alias("size")), most))
    packed = documents.select(key_of(F.col("doc_id"), F.col("source"), F.col("text")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "copy"]).alias("row"))
    return _copies(packed, targets, seed).where("copies > 0").select("row.*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  md5(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(text) || ':' || text, '-')) AS key, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS nth FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
f AS (SELECT *, (3 * source_size)::DOUBLE * sum(weight) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        <= ((sum(source_size) OVER ()) - 3 * coalesce(sum(source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE * weight AS is_full
      FROM w),
t AS (SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE
        ELSE (sum(source_size) OVER () - 3 * coalesce(sum(CASE WHEN is_full THEN source_size END) OVER (), 0))::DOUBLE * weight / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target FROM f),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || key || ':' || nth), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies FROM r)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM c
"""
