"""Nearest neighbours by cosine with vantage-point trees per shard.

Unit vectors are points with Euclidean distances, for which the triangle
inequality holds and nearest means largest cosine.  A bounded sample gives the
top tree: its leaves are the shards' regions, salted where a region holds more
than ``SHARD`` vectors.  Each query takes its first radius from the sample of its
own region and goes only to the regions its ball can reach.  Every shard builds
its own vantage-point tree, and blocks of queries walk it together, nearer
halves first, with a shrinking radius.

``factor`` relaxes the pruning: the radius is divided by it, so values above one
skip more and may miss neighbours; one is exact.

Of equal vectors only the ``k + 1`` smallest ids can be anybody's neighbours, so
the rest is dropped before the shuffle (as candidates, not as queries).

Cases: vectors that are null, empty, zero, hold null or non-finite components or
differ in length from the longest take no part, nor do null ids; rows of equal
id count once, with the smallest of their vectors.  Equal scores are ranked by
id.  An empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrespark.llm.common import parts_for, persisted

SHARD = 8_192        # vectors of a shard
SAMPLE = 16_384      # vectors of the top tree at most
LEAF = 64
QUERY_BLOCK = 4_096  # queries that walk a shard together
SPARE = 4            # candidates kept beyond k until their exact scores are known
SLACK = 1e-9         # on distances, for rounding
ROUNDED = 2e-12      # on cosines, which are rounded to 12 digits; only widens the ball
FACTOR = 1.0


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision, summed in order of the components."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        dot += a[:, i] * b[:, i]
        aa += a[:, i] * a[:, i]
        bb += b[:, i] * b[:, i]
    both = aa * bb
    odd = (both < 1e-280) | ~np.isfinite(both)  # components whose squares leave the range of doubles
    if odd.any():
        dot[odd], both[odd] = (unit(a[odd]) * unit(b[odd])).sum(axis=1), 1.0
    return np.clip(dot / np.sqrt(both), -1.0, 1.0)


def apart(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cos, 0))


class Tree:
    """Vantage-point tree: nodes split at the median distance from one of their points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, leaves: int | None = None, seed: int = 0):
        """Splits down to ``leaf`` points, or into ``leaves`` parts."""
        self.points, rng = points, np.random.default_rng(seed)
        self.vantage, self.radius, self.children, self.members = [], [], [], []
        parts = leaves if leaves else math.inf

        def grow(at: np.ndarray, parts) -> int:
            node = len(self.vantage)
            for x in (self.vantage, self.radius, self.children, self.members):
                x.append(None)
            self.members[node] = at
            if parts > 1 and len(at) > (1 if leaves else leaf):
                trial = rng.choice(at, min(4, len(at)), replace=False)
                away = apart(points[at] @ points[trial].T)
                best = int(np.argmax(away.var(axis=0)))  # the point that tells most about the others
                away = away[:, best]
                middle = float(np.median(away))
                near = away <= middle
                if near.any() and not near.all():
                    self.vantage[node], self.radius[node] = points[trial[best]], middle
                    half = parts if parts == math.inf else (parts + 1) // 2
                    self.children[node] = (grow(at[near], half), grow(at[~near], parts if parts == math.inf else parts - half))
                    self.members[node] = None
            return node

        grow(np.arange(len(points)), parts)
        self.leaf_nodes = [n for n, c in enumerate(self.children) if c is None]

    def home(self, q: np.ndarray) -> np.ndarray:
        """Leaf node of each point."""
        out = np.zeros(len(q), dtype=np.int64)
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, at = todo.pop()
            if self.children[node] is None:
                out[at] = node
            elif len(at):
                near = apart(q[at] @ self.vantage[node]) <= self.radius[node]
                todo += [(self.children[node][0], at[near]), (self.children[node][1], at[~near])]
        return out

    def reach(self, q: np.ndarray, radius: np.ndarray, factor: float) -> list[tuple[int, np.ndarray]]:
        """Leaf nodes with the queries whose balls reach them."""
        out, todo = [], [(0, np.arange(len(q)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if self.children[node] is None:
                out.append((node, at))
                continue
            d, r = apart(q[at] @ self.vantage[node]), radius[at] / factor + SLACK
            todo += [(self.children[node][0], at[d - r <= self.radius[node]]), (self.children[node][1], at[d + r > self.radius[node]])]
        return out


class Best:
    """The best candidates of each query so far."""

    def __init__(self, n: int, k: int, radius: np.ndarray):
        self.k, self.keep = k, k + SPARE
        self.cos = np.full((n, self.keep), -np.inf)
        self.id = np.full((n, self.keep), np.iinfo(np.int64).max)
        self.at = np.full((n, self.keep), -1)
        self.start = radius

    def radius(self, rows: np.ndarray) -> np.ndarray:
        kth = self.cos[rows, self.k - 1]
        return np.minimum(self.start[rows], np.where(np.isfinite(kth), apart(np.where(np.isfinite(kth), kth, 1.0) - ROUNDED), np.inf))

    def offer(self, rows: np.ndarray, cos: np.ndarray, ids: np.ndarray, at: np.ndarray, own: np.ndarray) -> None:
        cos = np.where(ids[None, :] == own[rows][:, None], -np.inf, np.round(cos, 12))  # equal vectors tie
        everything = [np.concatenate([old[rows], np.broadcast_to(new, cos.shape)], axis=1) for old, new in ((self.cos, cos), (self.id, ids), (self.at, at))]
        order = np.lexsort((everything[1], -everything[0]), axis=1)[:, :self.keep]
        self.cos[rows], self.id[rows], self.at[rows] = (np.take_along_axis(x, order, axis=1) for x in everything)


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, radius: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(query row, point row) of the candidates for the k nearest of each query."""
    p, q = unit(points), unit(queries)
    tree, best = Tree(p), Best(len(q), k, radius)
    todo = [(0, np.arange(len(q)), None)]
    while todo:
        node, at, bound = todo.pop()
        if bound is not None:  # least distance to the half, checked now that the radius may have shrunk
            at = at[bound <= best.radius(at) / factor + SLACK]
        if not len(at):
            continue
        if tree.children[node] is None:
            members = tree.members[node]
            best.offer(at, q[at] @ p[members].T, ids[members], members, own)
            continue
        gap = apart(q[at] @ tree.vantage[node]) - tree.radius[node]
        inside = gap <= 0
        inner, outer = tree.children[node]
        todo += [(inner, at[~inside], gap[~inside]), (outer, at[inside], -gap[inside]), (outer, at[~inside], None), (inner, at[inside], None)]
    row, place = np.nonzero((best.at >= 0) & np.isfinite(best.cos))
    return row, best.at[row, place]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) that take part: doubles, one row an id."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col(id_col).isNotNull() & v.isNotNull() & ok)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, is_query, k: int = 5, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding",
            shard: int = SHARD, sample: int = SAMPLE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row where ``is_query`` holds."""
    spark = vectors.sparkSession
    schema = "query_id bigint, vec_id bigint, score double"
    rows = persisted(usable(vectors, id_col, vector_col))
    size = rows.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == size)
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    points = persisted(rows.withColumn("_n", first).where(F.col("_n") <= k + 1).drop("_n"))
    n = points.count()
    chosen = points.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30)).limit(sample).toPandas().sort_values("vec_id")
    if not len(chosen):
        chosen = points.limit(1).toPandas()
    top_points = unit(np.array(chosen["v"].tolist()))
    top = Tree(top_points, leaves=max(1, min(math.ceil(n / shard), len(chosen) // LEAF)))
    shared = spark.sparkContext.broadcast((top, chosen["vec_id"].to_numpy()))

    def place(batches):
        tree = shared.value[0]
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.home(unit(matrix(b.column(1)))))], ["vec_id", "v", "leaf"])

    placed = points.mapInArrow(place, "vec_id bigint, v array<double>, leaf bigint")
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = {leaf: math.ceil(c / shard) for leaf, c in sizes.items()}  # of each region of the bounded top tree
    salt_of = F.element_at(F.create_map(*[F.lit(x) for kv in salts.items() for x in kv]), F.col("leaf"))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), salt_of).cast("int"))

    def ask(batches):
        tree, ids = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            own, q = b.column(0).to_numpy(), unit(matrix(b.column(1)))
            home, radius = tree.home(q), np.full(len(q), np.inf)
            for leaf in np.unique(home):
                at, members = np.flatnonzero(home == leaf), tree.members[leaf]
                cos = np.where(ids[members][None, :] == own[at][:, None], -np.inf, q[at] @ tree.points[members].T)
                if len(members) > k:
                    kth = np.partition(cos, -k, axis=1)[:, -k]
                    radius[at] = np.where(np.isfinite(kth), apart(np.where(np.isfinite(kth), kth, 1.0) - ROUNDED), np.inf)
            for leaf, at in tree.reach(q, radius, factor):
                for salt in range(salts.get(leaf, 0)):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(radius[at]), pa.array(home[at]),
                         pa.array(np.full(len(at), leaf)), pa.array(np.full(len(at), salt), pa.int32())],
                        ["query_id", "q", "radius", "home", "leaf", "salt"])

    queries = rows.where(is_query)
    blocks = max(1, math.ceil(queries.count() / query_block))
    asked = queries.mapInArrow(ask, "query_id bigint, q array<double>, radius double, home bigint, leaf bigint, salt int")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    keys = ["leaf", "salt", "part"]
    wanted = asked.select(*(F.col(c).alias(f"to_{c}") for c in keys)).distinct()
    copies = placed.join(wanted, (F.col("leaf") == F.col("to_leaf")) & (F.col("salt") == F.col("to_salt"))).select("vec_id", "v", *(f"to_{c}" for c in keys))

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, own = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        points, q = matrix(left["v"]), matrix(right["q"])
        row, at = search(points, ids, q, own, k, right["radius"].to_numpy(), factor)
        return pa.table({"query_id": own[row], "vec_id": ids[at], "score": cosine(q[row], points[at])})

    dealt = parts_for(spark, len(sizes) * blocks, 1)
    found = copies.repartition(dealt, *wanted.columns).groupBy(*wanted.columns).cogroup(asked.repartition(dealt, *keys).groupBy(*keys)).applyInArrow(walk, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(vectors: DataFrame) -> DataFrame:
    return nearest(vectors.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
w AS (SELECT * FROM v WHERE len(e) = (SELECT max(len(e)) FROM v)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM w q, w c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
