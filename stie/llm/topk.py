"""Operator 9, exact top-k search by inner product with M-trees.

Components x become floor(256 * x), with x as double; the score is the integer inner product. A
vector v gets one more coordinate, sqrt(M^2 - |v|^2), where M is the greatest norm in its tree;
then |q - v|^2 = |q|^2 + M^2 - 2 q.v for a query with 0 there, so the nearest vectors in this
metric are those with the highest scores.

The upper level of the tree is global: routing vectors (a bounded sample in hash order, `pivots` at most
and PIVOT_BYTES in all), each with the covering radius of all vectors that are nearest to it. Below,
the vectors of one routing vector are dealt by hash into parts of about `part` rows, and each part is an
M-tree of pages: a node has a routing vector, a covering radius and its distance from its parent's
routing vector; a leaf page holds vectors with their distances from its routing vector. Nodes are
visited best first; a child or vector whose stored parent distance, by the triangle
inequality, can't bring it below the k-th distance is skipped without computing anything. All
distances only decide what is skipped, with a margin for rounding; scores are integers. The
queries of a block share the walk, so that a page is one matrix product for those that need it.

The queries are a stated set against all rows. They walk twice: first each goes to its own part, which
gives it a k-th score; then to the other parts whose routing vector's ball that score doesn't rule out.
A part's rows and the queries that come to it are sorted into one task's stream, so every vector
moves once a walk, a tree is built where it is used, and memory holds one part and one batch of queries.

Vectors that are null or hold a null, NaN or infinity take no part, nor do rows without an id.
Rows that repeat with id and vector count once; rows with the query's id are its own and no
candidates. Vectors of another dimension than the query's are no candidates. A query without
candidates returns no rows, nor does an empty table. Vectors may have any length. Scores must fit 64
bits; one that doesn't is an error. Embeddings may have any other columns.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stie.llm.common import reliable, table

PAGE = 64
FANOUT = 16
PIVOT_BYTES = 8 << 20


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products where doubles can't hold them."""
    return (vectors.astype(object) @ query.astype(object)).astype(np.int64)


class MTree:
    """Pages over integer vectors, bulk-loaded from the top."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.ids, self.vectors = ids, vectors
        self.square = float(norms.max())
        self.points = np.hstack([vectors.astype(np.float64), np.sqrt(np.maximum(self.square - norms, 0))[:, None]])
        self.router: list[np.ndarray] = []
        self.radius: list[float] = []
        self.radii: list[np.ndarray] = []  # of a node's children, and their routing vectors
        self.routers: list[np.ndarray] = []
        self.children: list[np.ndarray] = []  # nodes, or rows in a leaf
        self.far: list[np.ndarray] = []  # their distances from the routing vector
        self.leaf: list[bool] = []
        self.small = bool(len(vectors) == 0 or float(np.abs(vectors).max()) ** 2 * max(1, vectors.shape[1]) < 2**53)
        self.root = self._load(np.arange(len(ids)))

    def _load(self, rows: np.ndarray) -> int:
        own = self.points[rows]
        center = rows[int(np.argmin(((own - own.mean(axis=0)) ** 2).sum(axis=1)))]
        distance = np.sqrt(((own - self.points[center]) ** 2).sum(axis=1))
        if len(rows) <= PAGE:
            kids, far = rows, distance
        else:
            kids = np.array([self._load(part) for part in self._split(rows, own)])
            far = np.sqrt(((np.array([self.router[k] for k in kids]) - self.points[center]) ** 2).sum(axis=1))
        self.radii.append(np.array([self.radius[k] for k in kids]) if len(rows) > PAGE else distance[:0])
        self.routers.append(np.array([self.router[k] for k in kids]) if len(rows) > PAGE else own[:0])
        self.router.append(self.points[center])
        self.radius.append(float(distance.max()))
        self.children.append(kids)
        self.far.append(far)
        self.leaf.append(len(rows) <= PAGE)
        return len(self.leaf) - 1

    @staticmethod
    def _split(rows: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        k = min(FANOUT, -(-len(rows) // PAGE))
        pivots = [0]
        nearest = ((own - own[0]) ** 2).sum(axis=1)
        belongs = np.zeros(len(rows), dtype=np.int64)
        while len(pivots) < k and nearest.max() > 0:
            pivots.append(int(np.argmax(nearest)))
            d = ((own - own[pivots[-1]]) ** 2).sum(axis=1)
            belongs[d < nearest] = len(pivots) - 1
            nearest = np.minimum(nearest, d)
        if len(pivots) == 1:  # all the same
            return np.array_split(rows, k)
        return [rows[belongs == p] for p in range(len(pivots))]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, least_score: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, score, id of the k best of each query, ties to the smaller id; none below least_score.

        The queries walk the tree together: the node with the least bound of any query comes
        next, and only the queries that need it take part, with one matrix product a page.
        """
        q = np.hstack([queries.astype(np.float64), np.zeros((len(queries), 1))])
        base = (q**2).sum(axis=1) + self.square
        margin = 1e-4 * (1 + np.sqrt(base))
        lowest = np.iinfo(np.int64).min
        floor = np.full(len(q), lowest + 1) if least_score is None else np.maximum(least_score, lowest + 1)
        limit = np.where(floor > lowest + 1, np.sqrt(np.maximum(base - 2.0 * floor, 0)), np.inf)
        scores, names = np.full((len(q), k), lowest), np.full((len(q), k), np.iinfo(np.int64).max)

        def distances(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum((q[rows] ** 2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * q[rows] @ points.T, 0))

        at = distances(self.router[self.root][None], np.arange(len(q)))[:, 0]
        bounds = np.maximum(at - self.radius[self.root], 0)
        heap = [(float(bounds.min()), 0, self.root, bounds, at)]
        pushed = 0
        while heap:
            least, _, node, bounds, at = heapq.heappop(heap)
            active = np.flatnonzero(bounds <= limit + margin)
            if not len(active):
                continue
            kids, far = self.children[node], self.far[node]
            reach = (limit + margin)[active, None]
            if not self.leaf[node]:
                needed = np.abs(at[active, None] - far) - self.radii[node] <= reach
                near = np.flatnonzero(needed.any(axis=0))
                d = distances(self.routers[node][near], active)
                low = np.where(needed[:, near], np.maximum(d - self.radii[node][near], 0), np.inf)
                for n in np.flatnonzero((low <= reach).any(axis=0)).tolist():
                    child, away = np.full(len(q), np.inf), np.zeros(len(q))
                    child[active], away[active] = low[:, n], d[:, n]
                    pushed += 1
                    heapq.heappush(heap, (float(low[:, n].min()), pushed, int(kids[near[n]]), child, away))
                continue
            near = kids[(np.abs(at[active, None] - far) <= reach).any(axis=0)]
            if not len(near):
                continue
            got = exact_products(self.vectors[near], queries[active].T) if not self.small else (q[active, :-1] @ self.vectors[near].T.astype(np.float64)).astype(np.int64).T
            got = np.where(self.ids[near][:, None] == own[active], lowest, got).T
            better = np.flatnonzero(got.max(axis=1) >= np.maximum(scores[active, -1], floor[active]))
            if not len(better):
                continue
            rows = active[better]
            all_scores = np.hstack([scores[rows], got[better]])
            all_names = np.hstack([names[rows], np.where(got[better] == lowest, np.iinfo(np.int64).max, self.ids[near])])
            order = np.lexsort((all_names, ~all_scores), axis=-1)[:, :k]
            scores[rows], names[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_names, order, 1)
            full = rows[scores[rows, -1] > lowest]
            limit[full] = np.minimum(limit[full], np.sqrt(np.maximum(base[full] - 2.0 * scores[full, -1], 0)))
        number, place = np.nonzero(scores >= floor[:, None])
        return number, scores[number, place], names[number, place]


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lifted(vectors: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The vectors with the coordinate that makes the inner product a distance."""
    x = vectors.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


def _placed(pivots: dict[int, np.ndarray]):
    """Every vector's routing vector (-1 if its length has none) and the distance from it."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == d))
                part = batch.take(at)
                pivot, far = np.full(len(at), -1), np.zeros(len(at))
                if d in pivots:
                    away = _distances(_lifted(_vectors(part.column("v"), d), part.column("top").to_numpy()), pivots[d])
                    pivot, far = np.argmin(away, axis=1), away.min(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot.astype(np.int32)), pa.array(far)], [*part.schema.names, "pivot", "far"])

    return of_batches


def _routed(pivots: dict[int, np.ndarray], balls: dict[tuple[int, int], tuple[float, int]]):
    """Queries, once for every part that may hold a better vector than their least score."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                v, top = _vectors(part.column("v"), d).astype(np.float64), part.column("top").to_numpy()
                base = (v**2).sum(axis=1) + top
                least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)  # NaN where there is none
                limit = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(base - 2 * np.nan_to_num(least), 0))) + 1e-4 * (1 + np.sqrt(base))
                own, own_salt = part.column("pivot").to_numpy(), part.column("salt").to_numpy()
                away = _distances(np.hstack([v, np.zeros((len(v), 1))]), pivots[d]) if d in pivots else np.zeros((len(v), 0))
                for (of_dims, pivot), (radius, salts) in balls.items():
                    if of_dims != d:
                        continue
                    near = np.flatnonzero(away[:, pivot] - radius <= limit) if pivot >= 0 else np.arange(len(v))
                    for salt in range(salts):
                        going = near[(own[near] != pivot) | (own_salt[near] != salt)]
                        if len(going):
                            sent = part.take(pa.array(going)).drop_columns(["pivot", "salt"])
                            yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(np.full(len(going), pivot, np.int32)), pa.array(np.full(len(going), salt, np.int32))], [*sent.schema.names, "pivot", "salt"])

    return of_batches


def _walk(k: int, block: int):
    """Streams of parts, each with its vectors first and then its queries."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("dims", "pivot", "salt", "kind")]
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                part = batch.slice(start, end - start)
                dims, pivot, salt, kind = (int(x[start]) for x in names)
                if key != (dims, pivot, salt):
                    key, held, tree = (dims, pivot, salt), [], None
                ids, vectors = part.column("vec_id").to_numpy(), _vectors(part.column("v"), dims)
                if kind == 0:
                    held.append((ids, vectors.copy()))
                    continue
                if tree is None:
                    if not held:
                        continue
                    all_ids = np.concatenate([x for x, _ in held])
                    order = np.argsort(all_ids, kind="stable")
                    tree, held = MTree(all_ids[order], np.concatenate([x for _, x in held])[order]), []
                which = part.column("which").to_numpy()
                least = part.column("least").fill_null(np.iinfo(np.int64).min).to_numpy()
                for p in range(0, len(ids), block):
                    number, score, name = tree.search(ids[p : p + block], vectors[p : p + block], k, least[p : p + block])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[p + number], which[p + number], name, score)], ["query_id", "which", "vec_id", "score"])

    return of_batches


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, scale: int = 256, part: int = 8192, block: int = 256, pivots: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: which rows are queries, on vec_id."""
    number = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    rows = embeddings.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long"), number.alias("v"), F.size("embedding").alias("dims"))
    rows = reliable(rows.dropDuplicates(["vec_id", "v"]).where(F.col("dims") > 0).withColumn("which", F.xxhash64("v")))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    shape = rows.groupBy("dims").agg(F.max(square).alias("top"), F.count("*").alias("n"))
    size = shape.agg(F.sum("n").alias("n"), F.max("dims").alias("dims")).first()
    many = min(pivots, max(1, -(-(size.n or 0) // part)), max(1, PIVOT_BYTES // (8 * (size.dims or 1))))
    rows = rows.join(F.broadcast(shape.drop("n")), "dims").select("vec_id", "v", "dims", "which", "top")
    chosen: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("which", "vec_id"), "vec_id", "which").limit(many).collect():
        chosen.setdefault(r.dims, []).append((r.v, r.top))
    routers = {d: _lifted(np.array([v for v, _ in x], dtype=np.int64), np.array([t for _, t in x])) for d, x in chosen.items()}
    placed = reliable(rows.mapInArrow(_placed(routers), "vec_id long, v array<long>, dims int, which long, top double, pivot int, far double"))
    balls = {(r.dims, r.pivot): (r.radius, -(-r.n // part)) for r in placed.groupBy("dims", "pivot").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}
    if not balls:
        return placed.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    salts = placed.groupBy("dims", "pivot").agg(F.ceil(F.count("*") / part).alias("salts"))
    dealt = placed.join(F.broadcast(salts), ["dims", "pivot"]).select("vec_id", "v", "dims", "which", "top", "pivot", F.pmod(F.xxhash64("vec_id", "which"), "salts").cast("int").alias("salt"))
    asked = dealt.where(F.coalesce(is_query, F.lit(False)))
    least = F.lit(None).cast("long").alias("least")

    def walked(queries: DataFrame) -> DataFrame:
        both = dealt.select("*", least, F.lit(0).alias("kind")).unionByName(queries.withColumn("kind", F.lit(1))).drop("top")
        stream = both.repartition(sum(n for _, n in balls.values()), "dims", "pivot", "salt").sortWithinPartitions("dims", "pivot", "salt", "kind")
        return stream.mapInArrow(_walk(k, block), "query_id long, which long, vec_id long, score long")

    own = reliable(walked(asked.select("*", least)))
    known = own.groupBy(F.col("query_id").alias("vec_id"), "which").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    sent = asked.join(known, ["vec_id", "which"], "left").select("vec_id", "v", "dims", "which", "top", "pivot", "salt", "least")
    routed = sent.mapInArrow(_routed(routers, balls), "vec_id long, v array<long>, dims int, which long, top double, least long, pivot int, salt int")
    found = own.unionByName(walked(routed.select("vec_id", "v", "dims", "which", "top", "pivot", "salt", "least")))
    order = W.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score
      FROM e AS q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
