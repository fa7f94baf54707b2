"""Mergeable sketches, kept as rows: distinct counts and quantiles of parts that are combined later without their data.

A sketch table has the columns of its keys, part, kind and sketch (binary).  New parts are appended, and answers come from
merging whatever rows are there; merging is associative, so parts may be merged to fewer at any time.

* distinct: HyperLogLog of 2 ** lg registers; the relative standard error is 1.04 / sqrt(2 ** lg).
* quantile: KLL of k items; the rank error is about 1.33 % for the default k = 200, at 99 % confidence (doubled here as a bound for tests).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG, K = 12, 200


def distinct_error(lg: int = LG) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / math.sqrt(2**lg)


def rank_error(k: int = K) -> float:
    """What the rank of an answered quantile is off at most, with 99 % confidence."""
    return 2.296 / k**0.9021


def sketches(rows: DataFrame, keys: list[str], part: Column, distinct: str | None = None, number: str | None = None, lg: int = LG, k: int = K) -> DataFrame:
    """(keys, part, kind, sketch): one row for each key, part and kind, made in partial aggregates; nulls are in no sketch."""
    aggs = []
    if distinct is not None:
        aggs.append(F.struct(F.lit("distinct").alias("kind"), F.hll_sketch_agg(F.col(distinct).cast("string"), lg).alias("sketch")))
    if number is not None:
        aggs.append(F.struct(F.lit("quantile").alias("kind"), F.kll_sketch_agg_double(F.col(number).cast("double"), k).alias("sketch")))
    own = [F.col(x) for x in keys]
    return rows.groupBy(*own, part.cast("string").alias("part")).agg(F.array(*aggs).alias("all")).select(*keys, "part", F.explode("all").alias("x")).select(*keys, "part", "x.*")


def merged(table: DataFrame, keys: list[str], lg: int = LG, part: Column | None = None) -> DataFrame:
    """(keys, part, kind, sketch) with the parts of each key as one, or as the coarser ones that `part` names; of one table or of several united."""
    group = [*keys, (F.lit("all") if part is None else part.cast("string")).alias("part")]
    both = []
    for kind, merge in (("distinct", F.hll_union_agg("sketch", True)), ("quantile", F.kll_merge_agg_double("sketch"))):
        both.append(table.filter(F.col("kind") == kind).groupBy(*group).agg(merge.alias("sketch")).select(*keys, "part", F.lit(kind).alias("kind"), "sketch"))
    return both[0].unionByName(both[1])


def answers(table: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95), lg: int = LG) -> DataFrame:
    """keys, n_distinct, and a column q25, q50, ... for each quantile, over all parts; null where a sketch of the kind is missing."""
    whole = merged(table, keys, lg)
    n = whole.filter("kind = 'distinct'").select(*keys, F.hll_sketch_estimate("sketch").alias("n_distinct"))
    q = whole.filter("kind = 'quantile'").select(*keys, *[F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(x)))).alias(f"q{round(100 * x)}") for x in quantiles])
    return n.join(q, keys, "full_outer") if keys else n.crossJoin(q)
