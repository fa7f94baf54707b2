"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best bin first.

* The tree is fitted on a documented bounded sample (`sample_rows`), level by level; every vector
  is indexed.  The number of leaves follows the number of vectors (`leaf_rows` each) up to a quarter
  of the sample; beyond `sample_rows / 4 * leaf_rows` vectors leaves grow, unless the sample does.
* A query walks the tree with a priority queue of nodes by the inner product with their centroids
  plus the norm of the query times the node's radius times `slack`, and visits leaves best first.
* Visits are widened (doubled) until a calibration set of at most `calibration` queries, compared
  with exact search over all vectors, reaches `target` recall; the last resort is all leaves.
* Neighbouring leaves lie in one shard of about `shard_rows` vectors, a larger leaf in several.  A query
  goes once to each shard that has leaves it visits; a shard meets its queries in blocks of about
  `block_queries`.  Equal vectors count once: of each, the k + 1 smallest ids are kept, as no other
  can be among anyone's k nearest when ties go to the smaller id.

Semantics: vectors that are null, empty, zero, or hold null or non-finite components take no part,
neither as queries nor as candidates; nor do vectors of a length other than the most frequent one.
Rows that repeat an id count as separate candidates but not as their own neighbours; of a query id's
vectors the least one, component by component, is the query.  Rows without
an id take no part.  Scores are float64 sums over the original components.  Fewer than k
candidates give as many rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, prepare

HITS = "query_id long, vec_id long, score double"


class Tree:
    """Centroids, radii and children; leaves are numbered."""

    def __init__(self, x: np.ndarray, leaves: int, branch: int = 8, seed: int = 3, rounds: int = 8):
        rng = np.random.default_rng(seed)
        self.centre, self.radius, self.children, self.leaf = [], [], [], []
        self.leaves = 0
        least = max(1, len(x) // max(1, leaves))

        def build(rows: np.ndarray) -> int:
            me = len(self.centre)
            self.centre.append(x[rows].mean(0))
            self.radius.append(float(np.sqrt(((x[rows] - self.centre[me]) ** 2).sum(1).mean())))
            self.children.append([])
            self.leaf.append(-1)
            split = []
            if len(rows) > least and len(rows) > 1:
                c = x[rng.choice(rows, min(branch, len(rows)), replace=False)]
                for _ in range(rounds):
                    near = (x[rows] @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
                    c = np.array([x[rows[near == k]].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
                near = (x[rows] @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
                split = [rows[near == k] for k in range(len(c)) if (near == k).any()]
            if len(split) > 1:
                self.children[me] = [build(r) for r in split]
            else:
                self.leaf[me], self.leaves = self.leaves, self.leaves + 1
            return me

        build(np.arange(len(x)))
        self.centre = np.array(self.centre)
        self.radius = np.array(self.radius)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest child at each level."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centre[kids]
            near = (x[rows] @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            todo += [(kids[k], rows[near == k]) for k in range(len(kids)) if (near == k).any()]
        return out

    def visit(self, q: np.ndarray, leaves: int, slack: float = 0.5) -> list[int]:
        """Best leaves first, by a priority queue over nodes."""
        bound = self.centre @ q + slack * np.linalg.norm(q) * self.radius
        heap, out = [(-bound[0], 0)], []
        while heap and len(out) < leaves:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for kid in self.children[node]:
                heapq.heappush(heap, (-bound[kid], kid))
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.transform(vectors[vec_col], lambda c: c.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size[0] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.place(matrix(batch.column(1))) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "v", "leaf"])

    return run


def _visits(shared, leaves: int, home: dict[int, list[int]]):
    """(query_id, v) -> a row for each query and shard it needs, with the leaves it visits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shards, lists = [], [], []
            for k, q in enumerate(matrix(batch.column(1))):
                mine: dict[int, list[int]] = {}
                for leaf in shared.value.visit(q, leaves):
                    for shard in home.get(leaf, ()):
                        mine.setdefault(shard, []).append(leaf)
                at += [k] * len(mine)
                shards += mine
                lists += mine.values()
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(shards, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["query_id", "v", "shard", "leaves"])

    return run


def nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, best first, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, one order of summation for every caller."""
    return np.einsum("ij,j->i", x, q)


def _search(k: int, group: int = 256):
    """Queries against the visited leaves of a shard: one product per group of queries picks, `scores` decides."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, ids, leaf = np.array(rows["v"].tolist()), rows["vec_id"].to_numpy(), rows["leaf"].to_numpy()
        known, at = np.unique(leaf, return_inverse=True)
        all_ids, all_q, out = queries["query_id"].to_numpy(), np.array(queries["v"].tolist()), []
        for a in range(0, len(queries), group):
            rough = all_q[a : a + group] @ x.T
            for j, (query, leaves) in enumerate(zip(all_ids[a : a + group], queries["leaves"].iloc[a : a + group])):
                fine = np.isin(known, leaves)[at] & (ids != query)
                s = np.where(fine, rough[j], -np.inf)
                far = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                some = np.flatnonzero(fine & (s >= far - 1e-9 * (1 + abs(far))))
                exact = scores(x[some], all_q[a + j])
                best = nearest(ids[some], exact, k)
                out.append((np.full(len(best), query), ids[some][best], exact[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out)))))

    return run


def _exact(shared, k: int):
    """Best k of each batch for the calibration queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            for query, q in shared.value if len(batch) else []:
                s = np.where(ids == query, -np.inf, scores(x, q))
                best = nearest(ids, s, k)
                best = best[ids[best] != query]
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(best), pa.int64()), pa.array(ids[best]), pa.array(s[best])], ["query_id", "vec_id", "score"])

    return run


def best_of(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_tree(queries: DataFrame, index: DataFrame, shared, home: dict[int, list[int]], leaves: int, k: int, block_queries: int) -> DataFrame:
    """The k nearest of queries (query_id, v) in the leaves they visit; shards meet blocks of queries."""
    visits = queries.mapInArrow(_visits(shared, leaves, home), "query_id long, v array<double>, shard long, leaves array<long>")
    visits = materialize(visits, "ann-visits")
    blocks = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_queries).alias("blocks"))
    asked = visits.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).drop("blocks")
    rows = index.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("shard", F.col("block").alias("block"), "leaf", "vec_id", "v")
    keys = ["shard", "block"]
    found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(lambda a, b: _search(k)(a, b), HITS)
    return best_of(found, k)


def homes(sizes: list[tuple[int, int]], shard_rows: int) -> dict[int, list[int]]:
    """Shards of each leaf (leaf, members): neighbouring leaves share one; a leaf beyond shard_rows has several of its own."""
    out, shard, held = {}, 0, 0
    for leaf, members in sorted(sizes):
        if held and held + members > shard_rows:
            shard, held = shard + 1, 0
        parts = -(-members // shard_rows)
        out[leaf] = list(range(shard, shard + parts))
        shard, held = (shard + parts, 0) if parts > 1 else (shard, held + members)
    return out


def tree_neighbours(vectors: DataFrame, query_ids: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20, leaf_rows: int = 250, sample_rows: int = 20_000, shard_rows: int = 4_000, block_queries: int = 1_000, calibration: int = 100, target: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by `every`."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = materialize(usable(vectors, id_col, vec_col), "ann-rows")
    same = W.partitionBy("v").orderBy("vec_id")
    distinct = materialize(rows.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1).drop("copy"), "ann-distinct")
    n = distinct.count()
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    if not n:
        return queries.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    roll = F.pmod(F.xxhash64(F.lit("tree"), "vec_id"), 1_000_000_000) / 1e9
    sample = matrix_of(distinct.filter(roll < sample_rows / n).orderBy("vec_id").limit(2 * sample_rows))
    if not len(sample):
        sample = matrix_of(distinct.orderBy("vec_id").limit(sample_rows))
    tree = Tree(sample, max(1, min(n // leaf_rows, len(sample) // 4)))
    shared = spark.sparkContext.broadcast(tree)  # at most 2 * sample_rows centroids
    placed = materialize(distinct.mapInArrow(_placed(shared), "vec_id long, v array<double>, leaf long"), "ann-placed")
    # one row per leaf, and leaves are bounded by the sample
    home = homes([tuple(r) for r in placed.groupBy("leaf").count().collect()], shard_rows)
    table = spark.createDataFrame([(leaf, shards[0], len(shards)) for leaf, shards in home.items()], "leaf long, first long, width long")
    place = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("width"))).alias("shard")
    index = materialize(placed.join(F.broadcast(table), "leaf").select("vec_id", "v", "leaf", place), "ann-index")
    # the calibration queries are bounded; each task answers them over its own rows
    asked = queries.orderBy(F.xxhash64(F.lit("calibrate"), "query_id"), "query_id").limit(calibration).toPandas()
    leaves = min(tree.leaves, 4)
    if len(asked):
        pairs = spark.sparkContext.broadcast([(int(i), np.asarray(v)) for i, v in zip(asked["query_id"], asked["v"])])
        truth = best_of(index.select("vec_id", "v").mapInArrow(_exact(pairs, k), HITS), k).toPandas()
        cut = truth.groupby("query_id")["score"].min()
        few = queries.join(F.broadcast(spark.createDataFrame([(int(i),) for i in asked["query_id"]], "query_id long")), "query_id", "left_semi")
        while leaves < tree.leaves:
            got = search_tree(few, index, shared, home, leaves, k, block_queries).toPandas()
            hits = (got["score"].to_numpy() >= cut.reindex(got["query_id"]).to_numpy()).sum()
            if hits >= target * len(truth):
                break
            leaves = min(tree.leaves, 2 * leaves)
    return materialize(search_tree(queries, index, shared, home, leaves, k, block_queries), "ann-found")


def matrix_of(df: DataFrame) -> np.ndarray:
    got = df.select("v").toPandas()["v"].tolist()
    return np.array(got) if got else np.zeros((0, 0))
