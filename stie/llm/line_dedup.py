"""Operator 7, line dedup by site-relative frequency.

Per host, the pages that hold a line are divided by all pages of the host; lines above
`ratio` that at least `least` pages hold are boilerplate there and go. So every host with more
than one page is judged, and a line of a single page always stays.

The counts are partial sums on (host, line hash) before they are shuffled, so a host or a
line with a third of all rows costs one row a task. A host has at most
(lines per page / ratio) boilerplate lines, so the answer is one short array a host. It is
broadcast if it has at most `broadcast_lines` lines in all; otherwise pages meet it in a join on
(host, salt).

Pages without a host, and null or empty texts, lose nothing; empty lines are not counted. Rows
that repeat are pages of their own. Very long texts are lines like any other, and a line that a page holds
more than once counts once there. An empty table gives an empty result. Other columns are passed through,
whatever their names, but those of the four that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stie.llm.common import reliable, table, written

BROADCAST_LINES = 200_000
SALTS = 64

HIDDEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
BLOCK = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|nav|article|section|header|footer|table|tr|title|html|head|body|pre|blockquote)(\s[^>]*)?/?>"
TAG = r"<[^>]*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]+)", 1)
    return F.when(host != "", host)


def html_text(html: Column) -> Column:
    """The text of a page, with a line for every block element."""
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(text, BLOCK, "\n")
    text = F.regexp_replace(text, TAG, "")
    plain = text
    for entity, character in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)


def trimmed_lines(text: Column) -> Column:
    """The lines without spaces around them, empty ones left out."""
    return F.coalesce(F.filter(F.split(F.trim(text), r" *\n[ \n]*"), lambda x: x != ""), F.array().cast("array<string>"))


def text_lines(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def boilerplate(lines: DataFrame, ratio: float, least: int) -> DataFrame:
    """host, hashes: the boilerplate lines of every host that has any. lines: host, lines."""
    lines = lines.where(F.col("host").isNotNull())
    pages = lines.groupBy("host").agg(F.count("*").alias("pages"))
    held = (
        lines.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .where(F.trim("line") != "")
        .groupBy("host", F.xxhash64("line").alias("hash"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
    )
    return held.join(pages, "host").where(F.col("n") / F.col("pages") > ratio).groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))


def line_dedup(pages: DataFrame, host: Column, lines: Column, ratio: float = 0.1, least: int = 2, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The columns of pages, and `site` (its host), `kept` (its lines that stay) and `n_lines`, `n_dropped`, which replace any of these names."""
    columns = [c for c in pages.columns if c not in ("site", "kept", "n_lines", "n_dropped")]
    known = boilerplate(pages.select(host.alias("host"), lines.alias("lines")), ratio, least)
    known = reliable(known)
    many = known.agg(F.sum(F.size("hashes"))).first()[0] or 0
    work = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), host.alias("site"), lines.alias("lines"))
    if many <= broadcast_lines:
        joined = work.join(F.broadcast(known), F.col("site") == F.col("host"), "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        work = work.withColumn("own", F.pmod(F.xxhash64("lines"), F.lit(SALTS)))
        joined = work.join(salted, (F.col("site") == F.col("host")) & (F.col("own") == F.col("salt")), "left")
    kept = F.when(F.col("hashes").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("hashes"), F.xxhash64(x))))
    return (
        joined.withColumn("kept", kept)
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dropped", (F.size("lines") - F.size("kept")).cast("long"))
        .select("row.*", "site", "kept", "n_lines", "n_dropped")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the text that stays, of every page.

    The lines are taken out of the HTML once, and written: counting and dropping read them there.
    """
    pages = table(spark, sf_dir, "pages")
    lines = written(pages.select("page_id", host_of(F.col("url")).alias("host"), trimmed_lines(html_text(F.col("html"))).alias("lines")))
    found = line_dedup(lines, F.col("host"), F.col("lines")).drop("host")
    return found.select("page_id", F.col("site").alias("host"), "n_lines", "n_dropped", F.array_join("kept", "\n").alias("kept_text"))


def _entities(sql: str) -> str:
    for entity, plain in ENTITIES:
        sql = f"replace({sql}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return sql


OP7_SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]+)', 1), '') AS host,
         coalesce(list_filter(list_transform(string_split({_entities(f"regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g')")}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), []) AS lines
  FROM pages),
t AS (SELECT host, count(*) AS total FROM p WHERE host IS NOT NULL GROUP BY host),
l AS (SELECT DISTINCT rid, host, unnest(lines) AS line FROM p),
b AS (SELECT l.host, line FROM l JOIN t USING (host) GROUP BY l.host, line, total HAVING count(*) >= 2 AND count(*) / total > 0.1),
k AS (SELECT host, list(line) AS gone FROM b GROUP BY host)
SELECT page_id, p.host, len(lines)::BIGINT AS n_lines,
       (len(lines) - len(list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false))))::BIGINT AS n_dropped,
       coalesce(array_to_string(list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)), chr(10)), '') AS kept_text
FROM p LEFT JOIN k ON p.host = k.host
"""
