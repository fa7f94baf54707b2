"""Hard negatives for anchors, by a distributed nearest-neighbour join over Voronoi cells.

* norm-augmented vectors: with M the greatest norm, a candidate x stands at (x, sqrt(M^2 - |x|^2)) and an anchor q at
  (q, 0); then the squared distance is |q|^2 + M^2 - 2 qx, so that a greater inner product is a smaller distance.
* pivots are a bounded, documented sample of the candidates (`pivots`); each vector belongs to the cell of the nearest
  one, and keeps its distance to it.  Neighbouring cells' anchors form groups of at most `group_rows`.
* seeds: each anchor is first compared with the candidates of the nearest cells of its group's anchors, `seed_rows` or more of
  them, which bounds how good its partners must be.
* bounds: by the triangle inequality a candidate can serve an anchor only if its distance to its pivot lies in an interval that
  follows from the anchor's own distance to that pivot.  Each group has the hull of these intervals for each cell, and
  a candidate is copied to the groups whose interval holds its distance, and to no other.
* local exact join: a group's candidates are dealt into blocks of about `block_rows` by a hash; each block meets all anchors of
  the group, and the best of the blocks are merged.  So no cell, label or repeated vector makes a task larger.

The join runs twice, first for positives, then for negatives, whose bounds follow from the positives' scores.  Scores are exact
integers: products of whole numbers in float64 as long as squared norms are below 2^53, else in 64-bit integers.

Semantics: rows with a null id, label or vector, or a null or non-finite component, take no part, nor do vectors of a
length other than the most frequent one.  Where the id is divisible by 7, label becomes (label + 1) % 10.  Component x becomes
floor(256 x).  A row never is a positive or negative of an anchor with its own id.  Rows that repeat an id are candidates
of their own; of an anchor's rows the least label, then the least vector, component by component, is the anchor.  Squared norms of
2^63 or more raise, as no score could be stated.  Zero vectors take part.  Anchors without positives or negatives have no rows.
Empty tables give an empty result.  Other columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, prepare, sized
from .kmeans_tree import Tree, homes, matrix

PLACED = "vec_id long, label long, v array<long>, cell int, dist double"
BOUNDS = "grp long, cell int, low double, high double"
POSITIVE = "anchor_id long, positive_id long, score long"
NEGATIVE = "anchor_id long, place int, positive_id long, positive_score long, negative_id long, score long"
#: Relative slack of distances, for rounding.
SLACK = 1e-6


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v as whole numbers."""
    x = F.transform(vectors[vec_col], lambda c: c.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("long").alias("label"), x.alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null").filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = materialize(rows.select("vec_id", label.alias("label"), F.transform("v", lambda c: F.floor(256 * c)).alias("v")), "neg-rows")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size[0] if size else 0))


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole vectors; exact: float64 holds them."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a @ b.T


def lifted(x: np.ndarray, most: float | None) -> np.ndarray:
    """Vectors with the component that makes their norm sqrt(most); 0 for anchors (None)."""
    x = x.astype(np.float64)
    last = np.zeros(len(x)) if most is None else np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))
    return np.column_stack([x, last])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0.0, square))


def _placed(shared, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4_096):
                some = batch.slice(a, 4_096)
                d = distances(lifted(matrix(some.column(2)), most), shared.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "label", "v", "cell", "dist"])

    return run


def _near(shared, least: int):
    """Anchors -> with their cell and the nearest cells that hold `least` candidates together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, members = shared.value
        for batch in batches:
            for a in range(0, len(batch), 4_096):
                some = batch.slice(a, 4_096)
                order = distances(lifted(matrix(some.column(2)), None), pivots).argsort(1)
                many = (members[order].cumsum(1) < least).sum(1) + 1
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(order[:, 0], pa.int32()), pa.array([o[:m] for o, m in zip(order, many)], pa.list_(pa.int32()))], ["vec_id", "label", "v", "cell", "near"])

    return run


def _positives(k: int, exact: bool):
    """A group's anchors against a block of candidates: each anchor's k best of its own label."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            x, ids, labels = np.array(rows["v"].tolist()), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            scores = products(np.array(anchors["v"].tolist()), x, exact)
            for j, (me, label) in enumerate(zip(anchors["vec_id"], anchors["label"])):
                mine = np.flatnonzero((labels == label) & (ids != me))
                best = mine[np.lexsort((ids[mine], -scores[j, mine]))[:k]]
                out += zip([me] * len(best), ids[best].tolist(), scores[j, best].tolist())
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "score"])

    return run


def _negatives(k: int, exact: bool):
    """A group's anchors, with their positives, against a block of candidates: for each positive the k best other-label rows in its band."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            x, ids, labels = np.array(rows["v"].tolist()), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            scores = products(np.array(anchors["v"].tolist()), x, exact)
            for j, (me, label, positives) in enumerate(zip(anchors["vec_id"], anchors["label"], anchors["positives"])):
                s = scores[j]
                bands = [(p["place"], p["positive_id"], p["score"], *band(p["score"])) for p in positives]
                low, high = min(b[3] for b in bands), max(b[4] for b in bands)
                some = np.flatnonzero((labels != label) & (ids != me) & (s >= low) & (s <= high))
                some = some[np.lexsort((ids[some], -s[some]))]
                falling = -s[some]
                for place, positive, score, low, high in bands:
                    a, b = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
                    best = some[a : min(b, a + k)]
                    out += [(me, place, positive, score, int(i), int(v)) for i, v in zip(ids[best], s[best])]
        return pd.DataFrame(out, columns=["anchor_id", "place", "positive_id", "positive_score", "negative_id", "score"])

    return run


def band(positive: int) -> tuple[int, int]:
    """The least and the greatest whole score that 30 p <= 100 s <= 90 p allows; the least is above the greatest if none is."""
    return -((-3 * int(positive)) // 10), (9 * int(positive)) // 10


def _bounds(shared, most: float, far: float):
    """A group's anchors with the scores (low, high) that partners may have -> the interval of distances for each cell."""

    def run(anchors: pd.DataFrame) -> pd.DataFrame:
        pivots = shared.value
        q = lifted(np.array(anchors["v"].tolist()), None)
        own, norm = distances(q, pivots), (q * q).sum(1)
        reach = lambda s: np.sqrt(np.maximum(0.0, norm + most - 2 * s))
        widest, least = reach(anchors["low"].to_numpy(np.float64)), reach(anchors["high"].to_numpy(np.float64))
        slack = SLACK * (1 + far)
        # |d(q, p) - d(x, p)| <= d(q, x), and d(q, x) <= d(q, p) + d(x, p)
        low = np.maximum(np.maximum(0.0, own - widest[:, None]), least[:, None] - own).min(0) - slack
        high = (own + widest[:, None]).max(0) + slack
        cells = np.arange(len(pivots))
        return pd.DataFrame({"grp": anchors["grp"].iloc[0], "cell": cells, "low": low, "high": high})

    return run


def routed(placed: DataFrame, bounds: DataFrame) -> DataFrame:
    """(grp, vec_id, label, v): a copy of each candidate for every group whose interval for its cell holds its distance."""
    b = sized(materialize(bounds, "neg-bounds").select("grp", F.col("cell").alias("of"), "low", "high"))
    near = (F.col("cell") == F.col("of")) & F.col("dist").between(F.col("low"), F.col("high"))
    return placed.join(b, near).select("grp", "vec_id", "label", "v")


def local_join(anchors: DataFrame, rows: DataFrame, function, schema: str, block_rows: int) -> DataFrame:
    """function on the anchors of each group and each block of its candidates."""
    rows = materialize(rows, "neg-routed")
    blocks = materialize(rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks")), "neg-blocks")
    dealt = rows.join(sized(blocks), "grp").withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "blocks")).drop("blocks")
    asked = anchors.join(sized(blocks), "grp").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    keys = ["grp", "block"]
    return asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(function, schema)


def first_of(hits: DataFrame, keys: list[str], other: str, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), other))
    return hits.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 100, n_positives: int = 5, n_negatives: int = 10, cell_rows: int = 250, pivots: int = 512, sample_rows: int = 20_000, group_rows: int = 512, block_rows: int = 4_000, seed_rows: int = 500) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for anchors whose id is divisible by `every`."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = quantised(vectors, id_col, vec_col, label_col)
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, most = rows.agg(F.count(F.lit(1)), F.max(square)).first()
    if not n:
        return rows.select(*(F.col("vec_id").cast(t).alias(c) for c, t in (("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))))
    if most >= 2.0**63:
        raise ValueError("scores of these vectors are no 64-bit integers")
    exact, far = most < 2.0**53, 2 * most**0.5
    roll = F.pmod(F.xxhash64(F.lit("pivots"), "vec_id"), 1_000_000_000) / 1e9
    sample = rows.filter(roll < sample_rows / n).orderBy("vec_id", "v").limit(2 * sample_rows).select("v").toPandas()["v"].tolist()  # bounded
    sample = lifted(np.array(sample or [r.v for r in rows.select("v").limit(1).collect()]), most)
    tree = Tree(sample, max(1, min(pivots, n // cell_rows, len(sample))))
    leaves = np.argsort([leaf if leaf >= 0 else 1 << 40 for leaf in tree.leaf])[: tree.leaves]
    shared = spark.sparkContext.broadcast(tree.centre[leaves])  # neighbouring cells have neighbouring numbers
    placed = materialize(rows.mapInArrow(_placed(shared, most), PLACED), "neg-placed")
    chosen = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    members = np.zeros(tree.leaves, np.int64)
    for cell, count in placed.groupBy("cell").count().collect():  # a row per pivot at most
        members[cell] = count
    seeding = spark.sparkContext.broadcast((shared.value, members))
    cells = materialize(chosen.mapInArrow(_near(seeding, seed_rows), "vec_id long, label long, v array<long>, cell int, near array<int>"), "neg-anchors")
    home = homes([tuple(r) for r in cells.groupBy("cell").count().collect()], group_rows)  # a row per pivot at most
    place = spark.createDataFrame([(int(c), g[0], len(g)) for c, g in home.items()], "of int, first long, width long")
    grp = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("width"))).alias("grp")
    anchors = materialize(cells.join(F.broadcast(place), F.col("cell") == F.col("of")).select(grp, "vec_id", "label", "v", "near"), "neg-grouped")

    def bounds(rows: DataFrame) -> DataFrame:
        return rows.select("grp", "v", F.col("low").cast("double"), F.col("high").cast("double")).groupBy("grp").applyInPandas(_bounds(shared, most, far), BOUNDS)

    seeds = anchors.select("grp", F.explode("near").alias("cell")).distinct().select("grp", "cell", F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"))
    seeds = materialize(routed(placed, seeds), "neg-seeds")
    least = F.lit(-most)  # no score is less
    positives = lambda where: first_of(local_join(anchors.drop("near"), where, _positives(n_positives, exact), POSITIVE, block_rows), ["anchor_id"], "positive_id", n_positives)
    known = positives(seeds).groupBy("anchor_id").agg(F.when(F.count(F.lit(1)) == n_positives, F.min("score")).alias("low"))
    limits = anchors.join(known, F.col("vec_id") == F.col("anchor_id"), "left").withColumn("low", F.coalesce(F.col("low").cast("double"), least)).withColumn("high", F.lit(most))
    found = materialize(positives(routed(placed, bounds(limits))), "neg-positives")

    # about the band's ends; exact ones are worked out where rows are compared
    score = F.col("score").cast("double")
    usable = found.filter("score >= 0").withColumn("low", score * (0.3 - 1e-12) - 1).withColumn("high", score * (0.9 + 1e-12) + 1)
    per = usable.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("rank").alias("place"), "positive_id", "score")).alias("positives"), F.max("high").alias("high"))
    asking = materialize(anchors.drop("near").join(per, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "neg-asking")
    negatives = lambda where: first_of(local_join(asking, where, _negatives(n_negatives, exact), NEGATIVE, block_rows), ["anchor_id", "place"], "negative_id", n_negatives)
    known = negatives(seeds).groupBy("anchor_id", "place").agg(F.when(F.count(F.lit(1)) == n_negatives, F.min("score")).alias("seen"))
    known = usable.select("anchor_id", F.col("rank").alias("place"), "low").join(known, ["anchor_id", "place"], "left").groupBy("anchor_id").agg(F.min(F.coalesce("seen", "low")).alias("low"))
    limits = asking.join(known, F.col("vec_id") == F.col("anchor_id"))
    out = negatives(routed(placed, bounds(limits)))
    return materialize(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")), "neg-found")
