"""Operator 11, a Merkle manifest of a dataset that stores every few levels and recomputes the rest.

A leaf is the sha256 of a row's columns, each `-` if null, else its UTF-8 byte count, `:` and its value.
The leaves of a tree (here: of a language) ascend by id, and every `ARITY` consecutive nodes, the last run
being shorter, become the hash of their hashes until one is left. The roots of the trees, in the order
of their keys with null first, are the leaves of one more tree: its root is the root of the dataset.

Only every `every`-th level is stored, as a Parquet table in the shared folder. The node of a stored
level is computed from the ARITY ** every nodes of its aligned subtree, so that one shuffle of narrow
rows makes several levels, and no row of it is larger than one subtree. Proofs come from the top down: a
subtree's stored nodes are gathered again, the nodes between are made anew, each stored node gets its
siblings at these levels and those that its subtree's node got above, and the nodes between are gone.

Leaves are ordered by one range sort, which spreads any tree, and any id, over many tasks; places within
a tree follow from the counts of (tree, task). Columns of the input other than those hashed are passed
by, whatever their names. Rows that repeat are leaves of their own; equal ids are ordered by leaf, null ids come
first. A null or empty text, and a very long one, is a value like any other. An empty table gives
an empty manifest. A tree of one leaf has that leaf as its root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stie.llm.common import placed, small, table, written

ARITY = 8
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    """The hash of a row: every value with its length in front, so that no two rows read alike."""
    told = lambda v: F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))
    return digest(F.concat(*[F.coalesce(told(v), F.lit("-")) for v in values]))


def depth(n: Column) -> Column:
    """How often n nodes shrink until one is left."""
    return sum((F.when(n > ARITY**k, 1).otherwise(0) for k in range(21)), F.lit(0))


def _shrunk(hashes: Column) -> Column:
    """The level above: every ARITY hashes become one."""
    runs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda run: digest(F.array_join(F.slice(hashes, run * ARITY + 1, ARITY), "")))


def _levels(hashes: Column, up: Column, every: int) -> Column:
    """`up` levels of one subtree from its stored nodes on, and the one above them, its node."""
    climb = lambda made, _: F.concat(made, F.array(_shrunk(F.element_at(made, -1))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(every)), F.array(hashes), lambda made, k: F.when(k <= up, climb(made, k)).otherwise(made))


def _siblings(levels: Column, up: Column, at: Column) -> Column:
    """For the node at `at` of a subtree, the hashes left and right of it and of its ancestors, level by level."""

    def one(level: Column, k: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(float(ARITY)), k)).cast("int")
        first = (place - place % ARITY).cast("int")
        return F.struct(F.array_join(F.slice(level, first + 1, place % ARITY), "").alias("left"), F.array_join(F.slice(level, place + 2, ARITY - 1 - place % ARITY), "").alias("right"))

    return F.transform(F.slice(levels, 1, up), one)


def folded(node: Column, proof: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(proof, node, lambda made, s: digest(F.concat(s["left"], made, s["right"])))


def _subtrees(nodes: DataFrame, every: int) -> DataFrame:
    """tree, above, up, nodes: the stored nodes of every aligned subtree in order, and how many levels it has."""
    width = ARITY**every
    gathered = nodes.groupBy("tree", F.floor(F.col("at") / width).alias("above")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "hash", *[c for c in ("row",) if c in nodes.columns]))).alias("nodes"))
    return gathered.withColumn("up", F.least(F.lit(every), depth(F.col("n"))))


def _kept_levels(leaves: DataFrame, every: int) -> list[DataFrame]:
    """The leaves and every `every`-th level above, until each tree is one node."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        hashes = F.transform("nodes", lambda x: x["hash"])
        top = F.element_at(F.element_at(_levels(hashes, F.col("up"), every), -1), 1)
        shrunk = F.ceil(F.col("n") / F.pow(F.lit(float(ARITY)), F.col("up"))).cast("long")
        levels.append(written(_subtrees(levels[-1].select("tree", "at", "n", "hash"), every).select("tree", F.col("above").alias("at"), shrunk.alias("n"), F.when(F.col("up") > 0, top).otherwise(hashes[0]).alias("hash"))))
        most = -(-most // ARITY**every)
    return levels


def _proved(levels: list[DataFrame], above: DataFrame, every: int) -> DataFrame:
    """The leaves with `proof`: their siblings up to the root. above: tree, at, proof, and more of every node of the last level."""
    passed = [c for c in above.columns if c not in ("tree", "at", "proof")]
    for nodes in reversed(levels[:-1]):
        over = above.select("tree", F.col("at").alias("above"), F.col("proof").alias("_over"), *passed)
        pieces = _subtrees(nodes, every).join(over, ["tree", "above"])
        made = F.array(_levels(F.transform("nodes", lambda x: x["hash"]), F.col("up"), every))  # in an array, so that it's made once and not for every node
        each = F.flatten(F.transform(made, lambda levels: F.transform("nodes", lambda x, j: F.struct(x.alias("node"), _siblings(levels, F.col("up"), j).alias("own")))))
        below = pieces.select("tree", "_over", *passed, F.explode(each).alias("x"))
        above = below.select("tree", F.col("x.node.at").alias("at"), *[F.col(f"x.node.{c}").alias(c) for c in ("hash", "row") if c in nodes.columns], F.concat("x.own", "_over").alias("proof"), *passed)
    return above


def manifest(rows: DataFrame, tree: Column, order: str, columns: list[str], tampered: Column | None = None, every: int = 3) -> DataFrame:
    """`order`, leaf, subroot, root, proof (left and right siblings from the leaf up to the root), changed (the leaf where `tampered` gives another text, else null) of every row.

    tampered: what is found for the last of `columns` when the proof is checked; null means unchanged.
    """
    values = [F.col(f"`{c}`") for c in columns]
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf([*values[:-1], tampered]))
    key = F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit(""))  # null stands before any key
    leaves = written(rows.select(key.alias("tree"), F.col(f"`{order}`").alias("_id"), leaf(values).alias("hash"), changed.alias("changed")))
    leaves = placed(leaves, ["_id", "hash"]).select("tree", "at", "n", "hash", F.struct("_id", "changed").alias("row"))
    levels = _kept_levels(leaves, every)
    roots = placed(levels[-1].select("tree", "hash").withColumnsRenamed({"tree": "own", "hash": "subroot"}).withColumn("tree", F.lit("")), ["own"])
    top = _kept_levels(roots.select("tree", "at", "n", F.col("subroot").alias("hash"), F.struct("own", "subroot").alias("row")), every)
    root = top[-1].select("tree", "at", F.array().cast("array<struct<left:string,right:string>>").alias("proof"), F.col("hash").alias("root"), *(["hash", "row"] if len(top) == 1 else []))
    proved = _proved(top, root, every).select(F.col("row.own").alias("tree"), F.lit(0).cast("long").alias("at"), "proof", "root", F.col("row.subroot").alias("subroot"))
    if len(levels) == 1:
        found = leaves.join(small(proved.drop("at")), "tree")
    else:
        found = _proved(levels, small(proved), every)
    return found.select(F.col("row._id").alias(order), F.col("hash").alias("leaf"), "subroot", "root", "proof", F.col("row.changed").alias("changed"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether the leaf that is found now (a third of the documents is tampered with) still gives the root."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = manifest(docs, F.col("lang"), "doc_id", COLUMNS, F.when(picked, F.translate("text", UPPER, LOWER)))
    proof = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    again = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    return found.select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB has no crc32: eight steps a byte.
CRC32_SQL = "xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split({x}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))]), lambda a, e: xor(xor(a, e) >> 1, CASE WHEN xor(a, e) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"

_LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in COLUMNS[:-1]) + " || coalesce(strlen({text}) || ':' || {text}, '-'))"

OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF_SQL.format(text='text')} AS leaf,
    {_LEAF_SQL.format(text="CASE WHEN coalesce(" + CRC32_SQL.format(x='doc_id::VARCHAR') + f" % 3 = 0, false) THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END")} AS now FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
t AS (SELECT tree, 0 AS level, place, n, leaf AS hash FROM l
  UNION ALL SELECT tree, max(level) + 1, place // 8, any_value((n + 7) // 8), sha256(string_agg(hash, '' ORDER BY place)) FROM t WHERE n > 1 GROUP BY tree, place // 8),
s AS (SELECT tree AS own, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, place, n, subroot AS hash FROM s UNION ALL SELECT max(level) + 1, place // 8, any_value((n + 7) // 8), sha256(string_agg(hash, '' ORDER BY place)) FROM u WHERE n > 1 GROUP BY place // 8),
r AS (SELECT own AS tree, level, place // 8 AS run, list(hash ORDER BY place) AS hashes FROM (SELECT tree AS own, level, place, n, hash FROM t WHERE n > 1) GROUP BY ALL),
q AS (SELECT level, place // 8 AS run, list(hash ORDER BY place) AS hashes FROM u WHERE n > 1 GROUP BY ALL),
f AS (SELECT doc_id, leaf, tree, place AS spot, 0 AS level, place, now AS made, '' AS proof FROM l
  UNION ALL SELECT doc_id, leaf, f.tree, spot, f.level + 1, place // 8, sha256(array_to_string(hashes[:place % 8], '') || made || array_to_string(hashes[place % 8 + 2:], '')), proof || array_to_string(hashes[:place % 8], '') || array_to_string(hashes[place % 8 + 2:], '')
  FROM f JOIN r ON r.tree = f.tree AND r.level = f.level AND run = place // 8),
e AS (SELECT tree, spot, arg_max(doc_id, level) AS doc_id, arg_max(leaf, level) AS leaf, arg_max(made, level) AS made, arg_max(proof, level) AS proof FROM f GROUP BY tree, spot),
g AS (SELECT doc_id, leaf, subroot, tree, spot, 0 AS level, s.place, made, proof FROM e JOIN s ON s.own = e.tree
  UNION ALL SELECT doc_id, leaf, subroot, tree, spot, g.level + 1, place // 8, sha256(array_to_string(hashes[:place % 8], '') || made || array_to_string(hashes[place % 8 + 2:], '')), proof || array_to_string(hashes[:place % 8], '') || array_to_string(hashes[place % 8 + 2:], '')
  FROM g JOIN q ON q.level = g.level AND run = place // 8),
h AS (SELECT tree, spot, arg_max(doc_id, level) AS doc_id, arg_max(leaf, level) AS leaf, arg_max(subroot, level) AS subroot, arg_max(made, level) AS made, arg_max(proof, level) AS proof FROM g GROUP BY tree, spot),
o AS (SELECT hash AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, made AS folded_root, made = root AS verified FROM h, o
"""
