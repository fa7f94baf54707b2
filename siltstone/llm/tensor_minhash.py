"""Near-duplicate detection by MinHash with tensored banding, every link confirmed on full sets.

Two small collections A and B of m keys (k minhashes each) are computed per document.  Table
(i, j) of the m * m tables has the key (A_i, B_j), so m * m tables with keys of 2k minhashes cost
2 * m * k minhashes instead of 2 * m * m * k.  A pair of similarity s shares a table with
probability (1 - (1 - s**k)**m)**2; m is chosen so that this is at least `recall` at the threshold.

Stages, each a written table:
1. one pass over the texts gives for each row: set size, digest of the whole set, A and B keys.
   Equal sets become one class, represented by its smallest id, before any table is built.
2. keys of A, then of B, that only one class has are pruned; what is left is combined into
   tables; a class and the smallest member of its table form a candidate edge (never all pairs).
3. candidate components are closed worlds: every linked pair that shares a table lies in one.
   The texts of their members - and no others - are read again and the links confirmed, component
   by component.  A component beyond `cell_rows` members is split into blocks: first links within
   blocks and among samples of the resulting clusters, then all members outside the largest
   cluster against every block, so that each pair of different clusters has been compared.

Semantics: words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a document's set holds its
distinct 5-word shingles, with fewer words the whole sequence.  A null or empty text, or one of
separators only, has an empty set and no links.  Each row is a document of its own, also where rows
repeat an id: their texts may lie in different components.  A row without an id is in no
component: component_id is null and kept true.  Ties go to the smaller id; of rows of one component that
share its smallest id, drop_near_copies keeps one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, one_of_each, prepare, sized, without
from .components import components

WIDTH = 3
SIGNATURES = "doc_id long, text_hash long, n_shingles long, digest binary, a array<long>, b array<long>"


def collection_size(threshold: float, recall: float, k: int = WIDTH) -> int:
    """The least m with (1 - (1 - threshold**k)**m)**2 >= recall."""
    return math.ceil(math.log(1 - math.sqrt(recall)) / math.log(1 - threshold**k))


def digests(shingles: np.ndarray, off: np.ndarray) -> list[bytes]:
    raw = memoryview(shingles).cast("B") if len(shingles) else memoryview(b"")
    return [blake2b(raw[8 * off[d] : 8 * off[d + 1]], digest_size=16).digest() for d in range(len(off) - 1)]


def _signatures(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(2))
            sets, soff = K.shingle_sets(data, off)
            mins = K.minhashes(sets, soff, 2 * m * WIDTH)
            keys = np.zeros((len(off) - 1, 2 * m), np.uint64)
            for r in range(WIDTH):
                keys = K.fmix(keys ^ mins[:, r::WIDTH]) + np.uint64(r + 1)
            keys = keys.view(np.int64)
            at = pa.array(np.arange(0, m * len(batch) + 1, m, dtype=np.int32))
            both = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x).reshape(-1))) for x in (keys[:, :m], keys[:, m:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(soff)), pa.array(digests(sets, soff), pa.binary()), *both], ["doc_id", "text_hash", "n_shingles", "digest", "a", "b"])

    return run


def _table_edges(reps: DataFrame) -> DataFrame:
    """Edges (u, v) between a class and the smallest class of a table they share; classes go by their digests."""

    def shared(rows: DataFrame, side: str) -> DataFrame:
        keys = rows.select("digest", F.posexplode(side).alias("pos", "key")).select("digest", F.xxhash64("pos", "key").alias(side))
        often = keys.groupBy(side).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(side)
        return keys.join(often, side).select("digest", side)

    a = materialize(shared(reps, "a"), "mh-a")
    some = a.select("digest").distinct()
    b = shared(reps.join(some, "digest", "left_semi"), "b")
    tables = materialize(a.join(b, "digest").select("digest", F.xxhash64("a", "b").alias("t")), "mh-tables")
    low = tables.groupBy("t").agg(F.min("digest").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", "v")
    return tables.join(low, "t").filter("digest <> v").select(F.col("digest").alias("u"), "v").distinct()


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * |x & y| >= num * |x | y| for sorted distinct arrays."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if den * len(small) < num * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return den * both >= num * (len(x) + len(y) - both)


def _prefixes(sets: list[np.ndarray], num: int, den: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each set's rarest elements, as many as similar sets must have one in common of; and postings of these: members, offsets."""
    off = np.append(0, np.cumsum([len(s) for s in sets]))
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    out = []
    for a, b in zip(off, off[1:]):
        n = int(b - a)
        # sets of the similarity or more share ceil(num * n / den) elements of this one at least
        out.append(np.sort(rank[at[a:b]])[: n + (-num * n) // den + 1 if n else 0])
    member = np.repeat(np.arange(len(sets)), [len(x) for x in out])
    element = np.concatenate(out)
    order = np.argsort(element, kind="stable")
    return out, member[order], np.searchsorted(element[order], np.arange(len(often) + 1))


def link_cell(sets: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None, outside: np.ndarray | None = None) -> np.ndarray:
    """Roots (positions) of the clusters that linked pairs form.

    Pairs with equal labels count as linked; where `outside` is given, only pairs that hold an
    outside member are compared.  Compared are all pairs of sets that share one of their rarest
    elements, an exact bound, the most alike first, unless their clusters have met already.
    """
    n = len(sets)
    root = np.arange(n)
    if labels is not None:
        first: dict[int, int] = {}
        root = np.array([first.setdefault(x, i) for i, x in enumerate(labels)])
    size = np.array([len(s) for s in sets])
    prefixes, posted, off = _prefixes(sets, num, den)
    for i in range(1, n):
        spans = [posted[off[e] : off[e + 1]] for e in prefixes[i]]
        if not spans:
            continue
        shared = np.bincount(np.concatenate(spans), minlength=n)[:i]
        shared[(den * np.minimum(size[:i], size[i]) < num * np.maximum(size[:i], size[i])) | (root[:i] == root[i])] = 0
        if outside is not None and not outside[i]:
            shared[~outside[:i]] = 0
        others = np.flatnonzero(shared)
        others = others[np.argsort(-shared[others], kind="stable")]
        while len(others):
            j, others = others[0], others[1:]
            if similar(sets[i], sets[j], num, den):
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
                others = others[root[others] != low]
    return root


def _cells(num: int, den: int):
    """Rows (cell, digest, label, outside, text) sorted by cell and digest -> (cell, digest, root).

    A text that has another set than the digest says belongs to another row of the same id, and is passed over.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        labelled = rows[0][2] is not None
        roots = link_cell([r[4] for r in rows], num, den, [r[2] for r in rows] if labelled else None, np.array([r[3] for r in rows]) if labelled else None)
        names = [r[1] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0]] * len(rows), pa.string()), pa.array(names, pa.binary()), pa.array([names[r] for r in roots], pa.binary())], ["cell", "digest", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            sets, off = K.shingle_sets(*K.utf8(batch.column(4)))
            for d, (own, cell, digest, label, outside) in enumerate(zip(digests(sets, off), *(batch.column(c).to_pylist() for c in range(4)))):
                if rows and rows[0][0] != cell:
                    yield flush(rows)
                    rows = []
                if own == digest and (not rows or rows[-1][1] != digest):
                    rows.append((cell, digest, label, outside, sets[off[d] : off[d + 1]].copy()))
        if rows:
            yield flush(rows)

    return run


def _link(rows: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """Runs link_cell for each cell; cells are bounded, so tasks are, too."""
    rows = rows.select("cell", "digest", F.col("label").cast("binary").alias("label"), F.col("outside").cast("boolean").alias("outside"), "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "cell").sortWithinPartitions("cell", "digest")
    return materialize(dealt.mapInArrow(_cells(num, den), "cell string, digest binary, root binary"), name)


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: tuple[int, int], recall: float, cell_rows: int, cell_shingles: int, samples: int) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_shingles, component_id, class_id, cluster; the last three are null without an id."""
    spark = docs.sparkSession
    prepare(spark)
    num, den = threshold
    m = collection_size(num / den, recall)
    # repeated texts, a third of all rows perhaps, are hashed where they are read; no text is shuffled
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = materialize(rows.mapInArrow(_signatures(m), SIGNATURES), "mh-signatures")
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "mh-classes")
    # a row of the representative; the tables of all rows of a class are the same
    reps = some.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"])
    reps = materialize(reps.select("doc_id", "digest", "n_shingles", "a", "b"), "mh-reps")
    candidate = materialize(components(_table_edges(reps)), "mh-candidates")
    labels = materialize(_confirm(rows, reps.select("doc_id", "digest", "n_shingles"), candidate, num, den, cell_rows, cell_shingles, samples), "mh-labels")
    nodes = materialize(classes.join(labels, classes.digest == labels.node, "left").select("digest", "rep", "copies", F.coalesce("component", "digest").alias("cluster")), "mh-nodes")
    smallest = nodes.groupBy("cluster").agg(F.min("rep").alias("component"))
    moved = materialize(nodes.join(smallest, "cluster").filter("copies > 1 or component <> rep").select("digest", "rep", "component", "cluster"), "mh-moved")
    out = signed.select("doc_id", "text_hash", "n_shingles", "digest").join(sized(moved), "digest", "left")
    of = lambda c, other: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, other))
    return out.select("doc_id", "text_hash", "n_shingles", of("component", "doc_id").alias("component_id"), of("rep", "doc_id").alias("class_id"), of("cluster", "digest").alias("cluster"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (80, 100), recall: float = 0.9999, cell_rows: int = 4000, cell_shingles: int = 4_000_000, samples: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, class_id (smallest id with the same set).

    threshold: numerator and denominator of the least Jaccard similarity.  recall: probability
    with which one linked pair shares a table.  cell_rows, cell_shingles: members that one task
    compares, and shingles that their sets hold.
    """
    out = _grouped(docs, id_col, text_col, threshold, recall, cell_rows, cell_shingles, samples)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def _confirm(rows: DataFrame, reps: DataFrame, candidate: DataFrame, num: int, den: int, cell_rows: int, cell_shingles: int, samples: int) -> DataFrame:
    """(node, component) by confirmed links, for the classes of candidate (node, component)."""
    candidate = candidate.join(reps, candidate.node == reps.digest).drop("node")
    counted = candidate.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / cell_rows, F.sum("n_shingles") / cell_shingles)).cast("int").alias("blocks"))
    # all other components are one block
    large = materialize(counted.filter("blocks > 1"), "mh-blocked")
    members = candidate.join(sized(large), "component", "left").select("doc_id", "digest", F.hex("component").alias("component"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    members = materialize(members, "mh-members")
    texts = rows.select("doc_id", "text").join(sized(members), "doc_id")
    none = F.lit(None)
    small = texts.filter("blocks = 1").select(F.col("component").alias("cell"), "digest", none.alias("label"), none.alias("outside"), "text")
    done = _link(small, num, den, "mh-small").select(F.col("digest").alias("node"), F.col("root").alias("component"))
    if members.filter("blocks > 1").isEmpty():
        return done
    blocks = F.col("blocks")
    large = materialize(texts.filter("blocks > 1").withColumn("block", F.pmod(F.hash("digest"), blocks)), "mh-large")
    one = _link(large.select(F.concat_ws(":", "component", "block").alias("cell"), "digest", none.alias("label"), none.alias("outside"), "text"), num, den, "mh-blocks")
    edges = one.select(F.col("digest").alias("u"), F.col("root").alias("v"))
    # Samples of the clusters of all blocks meet; cells of samples are as bounded as blocks.
    rank = F.row_number().over(W.partitionBy("root").orderBy(F.xxhash64("digest"), "digest"))
    picked = one.withColumn("rank", rank).filter(F.col("rank") <= samples).select("digest")
    chosen = materialize(large.join(picked, "digest", "left_semi"), "mh-chosen")
    parts = chosen.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("parts"))
    spread = chosen.join(sized(materialize(parts, "mh-parts")), "component").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")))
    met = _link(spread.select(F.concat_ws(":", "component", "part").alias("cell"), "digest", none.alias("label"), none.alias("outside"), "text"), num, den, "mh-samples")
    edges = materialize(edges.union(met.select(F.col("digest").alias("u"), F.col("root").alias("v"))), "mh-edges")
    label = components(edges).withColumnRenamed("component", "label")
    large = large.join(label, large.digest == label.node, "left").drop("node").withColumn("label", F.coalesce("label", "digest"))
    large = materialize(large, "mh-labelled")
    # Everything outside a component's largest cluster meets every block of it.
    top = large.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
    large = large.join(sized(materialize(top, "mh-top")), "component").withColumn("outside", F.col("label") != F.col("top"))
    outside = materialize(large.filter("outside").withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(1 << 20))), "mh-outside")
    if not outside.isEmpty():
        parts = sized(materialize(outside.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("parts")), "mh-grid-parts"))
        cell = F.concat_ws(":", "component", "block", "part")
        fields = [cell.alias("cell"), "digest", "label", "outside", "text"]
        rest = outside.join(parts, "component").withColumn("part", F.pmod("part", "parts"))
        here = large.join(parts, "component").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(fields)
        there = rest.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select(fields)
        grid = _link(here.union(there), num, den, "mh-grid")
        edges = edges.union(grid.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    return done.union(components(edges))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (80, 100), recall: float = 0.9999, cell_rows: int = 4000, cell_shingles: int = 4_000_000, samples: int = 4) -> DataFrame:
    """docs with one row of each component, all columns as they are; rows without an id or with an empty set stay."""
    rows = materialize(_grouped(docs, id_col, text_col, threshold, recall, cell_rows, cell_shingles, samples), "mh-groups")
    rows = rows.filter("doc_id is not null and n_shingles > 0")
    first = rows.filter("doc_id = component_id")
    several = materialize(first.groupBy("doc_id", "cluster").agg(F.min("text_hash").alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "mh-several")
    others = first.join(sized(several), ["doc_id", "cluster"]).filter("text_hash <> stays")
    dropped = materialize(rows.filter("doc_id <> component_id").select("doc_id", "text_hash").union(others.select("doc_id", "text_hash")).distinct(), "mh-dropped")
    own = docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))
    rest = without(docs, dropped, *own)
    return one_of_each(rest, several.select("doc_id", "stays"), F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string")))
