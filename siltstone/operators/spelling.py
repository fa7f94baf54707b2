"""Names that are spelled alike: edit distance with swaps up to a cap, and a join by deletion neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capped_distances(a: list[str], b: list[str], cap: int, once: bool = False) -> np.ndarray:
    """Edits (insertion, deletion, substitution, swap of neighbours) between each a and b; cap + 1 where there are more.

    once: no part of a string is edited twice (optimal alignment); else letters may be put between those swapped.
    All pairs advance together through a band of 2 cap + 1 diagonals; pairs whose rows are all above the cap leave.
    """
    out = np.full(len(a), cap + 1, np.int64)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    live = np.flatnonzero(np.abs(la - lb) <= cap)
    if not len(live):
        return out
    width = int(max(la[live].max(), lb[live].max())) + 2 * cap + 2
    points = lambda xs: np.array([np.pad(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32), (0, width - len(x))) for x in xs])
    A, B = points([a[k] for k in live]), points([b[k] for k in live])
    n, m = la[live], lb[live]
    far = cap + 1
    swaps = [(1, 1)] if once else [(x, y) for x in range(1, cap + 1) for y in range(1, cap + 1) if x + y - 1 <= cap]
    d = np.arange(-cap, cap + 1)  # column minus row
    rows = [np.where((d >= 0) & (d <= m[:, None]), np.minimum(d, far), far)]  # row 0
    best = np.where(n == 0, rows[0][np.arange(len(n)), np.clip(m, 0, cap) + cap], far)
    for i in range(1, int(n.max()) + 1):
        prev, now = rows[-1], np.full((len(n), len(d)), far, np.int64)
        for k, shift in enumerate(d):
            j = i + shift
            if j < 0:
                continue
            cell = prev[:, k + 1] + 1 if k + 1 < len(d) else np.full(len(n), far)
            if j == 0:
                now[:, k] = np.minimum(cell, far)
                continue
            if k:
                cell = np.minimum(cell, now[:, k - 1] + 1)
            cell = np.minimum(cell, prev[:, k] + (A[:, i - 1] != B[:, j - 1]))
            for x, y in swaps:
                if i > x and j > y and len(rows) > x and 0 <= k - y + x < len(d):  # from before both letters of the swap
                    hit = (A[:, i - 1 - x] == B[:, j - 1]) & (A[:, i - 1] == B[:, j - 1 - y])
                    cell = np.where(hit, np.minimum(cell, rows[-1 - x][:, k - y + x] + x + y - 1), cell)
            now[:, k] = np.where(j <= m, np.minimum(cell, far), far)
        rows = [*rows[-cap - 1 :], now]
        ends = n == i
        if ends.any():
            best[ends] = now[ends, np.clip(m[ends] - i, -cap, cap) + cap]
        keep = (n > i) & (np.minimum(now.min(1), prev.min(1)) <= cap)
        if not keep.all():
            out[live] = best
            live, A, B, n, m, best, rows = live[keep], A[keep], B[keep], n[keep], m[keep], best[keep], [r[keep] for r in rows]
            if not len(live):
                return out
    out[live] = best
    return out


def capped_distance(a: Column, b: Column, cap: int = 3, once: bool = True) -> Column:
    """capped_distances of two columns; null if either is."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        there = x.notna() & y.notna()
        out = pd.Series(np.nan, x.index)
        out[there] = capped_distances(x[there].tolist(), y[there].tolist(), cap, once)
        return out.astype("Int32")

    return run(a, b)


def deletions(text: str, depth: int) -> set[str]:
    """The text and all that is left of it after up to depth deletions."""
    return {"".join(c for k, c in enumerate(text) if k not in gone) for n in range(min(depth, len(text)) + 1) for gone in map(set, combinations(range(len(text)), n))}


def near_names(names: DataFrame, listed: DataFrame, cap: int = 2, least: int = 4, once: bool = True) -> DataFrame:
    """(name, listed, distance): each different name within cap edits, but not equal, of a listed name of `least` letters or more.

    Names cap edits apart share what is left of them after cap deletions at most, so that the join is on equal keys.  A
    name has some length ** cap keys; caps beyond 3 are for short names only.
    """

    @F.pandas_udf("array<string>")
    def cuts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: sorted(deletions(t, cap)))

    a = names.select("name").filter("name is not null").distinct().select("name", F.explode(cuts("name")).alias("cut"))
    b = listed.select("listed").filter(F.length("listed") >= least).distinct().select("listed", F.explode(cuts("listed")).alias("cut"))
    pairs = a.join(b, "cut").filter((F.col("name") != F.col("listed")) & (F.abs(F.length("name") - F.length("listed")) <= cap)).select("name", "listed").distinct()
    return pairs.withColumn("distance", capped_distance(F.col("name"), F.col("listed"), cap, once)).filter(F.col("distance") <= cap)


def suffix_pairs(left: DataFrame, right: DataFrame, tail: int = 8) -> DataFrame:
    """(left, right): the pairs of different non-empty strings of which one ends in the other, either way round; left and right have a column of these names.

    Equal keys only: a string's last `tail` characters name the lengths of the strings that end so, and only endings of
    these lengths are looked up.
    """

    def inside(longer: DataFrame, a: str, shorter: DataFrame, b: str) -> DataFrame:
        """Pairs (a, b) where a ends in b."""
        last = lambda c, n: F.substring(c, F.length(c) - n + 1, n)
        known = shorter.select(b).filter(F.length(b) > 0).distinct()
        lengths = known.groupBy(last(F.col(b), F.least(F.length(b), F.lit(tail))).alias("tail")).agg(F.collect_set(F.length(b)).alias("lengths"))
        of = longer.select(a).filter(F.length(a) > 0).distinct()
        tails = of.select(a, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(a), F.lit(tail))), lambda n: last(F.col(a), n))).alias("tail"))
        ends = tails.join(lengths, "tail").select(a, F.explode("lengths").alias("n")).filter(F.col("n") <= F.length(a)).select(a, last(F.col(a), F.col("n")).alias(b))
        return ends.join(known, b, "left_semi").select(a, b).distinct()

    both = inside(left, "left", right, "right").unionByName(inside(right, "right", left, "left").select("left", "right"))
    return both.distinct()
