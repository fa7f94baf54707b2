"""Top-k, budgets and hash-seeded samples.  Every order is total; randomness is md5 of a seed and the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import SKIPPED_FOLDERS, among, hash_unit, priority, routes

from .lookup import top_per


def scan_budget(files: DataFrame, most: int, largest: int) -> DataFrame:
    """Per repo: which files a bounded scan takes.  Columns path, priority, hits, selected.

    Eligible files lie in no skipped folder, are routed somewhere and are not too large; urgent ones first, then
    those with hits, by priority, number of hits and path.
    """
    f = files.filter(~among(F.col("path"), SKIPPED_FOLDERS) & (F.size(routes(F.col("path"))) > 0)).withColumn("priority", priority(F.col("path")))
    f = f.withColumn("fits", F.col("size") <= largest)
    keys = [(F.col("priority") > 1).cast("int"), (F.col("hits") == 0).cast("int"), F.col("priority"), -F.col("hits"), F.lower("path"), F.col("path")]
    f = f.withColumn("place", F.struct(*[k.alias(f"k{n}") for n, k in enumerate(keys)]))
    # the last place within the budget decides: Spark keeps the first `most` of a task before it shuffles, so that a large repo is sorted nowhere
    first = top_per(f.filter("fits").select("repo", "place"), ["repo"], most, F.col("place"))
    last = first.groupBy("repo").agg(F.max("place").alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == most).select(F.col("repo").alias("of"), "last")
    out = f.join(last, F.col("repo").eqNullSafe(F.col("of")), "left")
    return out.withColumn("selected", F.col("fits") & (F.col("last").isNull() | (F.col("place") <= F.col("last")))).drop("fits", "place", "of", "last")


def hash_order(seed: str, *cols: str) -> list[Column]:
    return [hash_unit(F.lit(seed), *map(F.col, cols)), *map(F.col, cols)]


def group_cap(rows: DataFrame, group: str, key: str, n: int, seed: str = "cap") -> DataFrame:
    return top_per(rows, [group], n, *hash_order(seed, key))


def round_robin(rows: DataFrame, strata: list[str], key: str, n: int, seed: str = "robin") -> DataFrame:
    """n rows, one per stratum and round: rank in the stratum first, then the stratum's hash - round-robin in closed form."""
    rank = F.row_number().over(W.partitionBy(*strata).orderBy(*hash_order(seed, key)))
    return rows.withColumn("round", rank).orderBy("round", *hash_order(seed, *strata), key).limit(n)


def balanced(rows: DataFrame, label: str, key: str, n: int, seed: str = "balance") -> DataFrame:
    """n // 2 positives and the rest negatives, in hash order."""
    quota = F.when(F.col(label) == 1, n // 2).otherwise(n - n // 2)
    rank = F.row_number().over(W.partitionBy(label).orderBy(*hash_order(seed, key)))
    return rows.withColumn("rank__", rank).filter(F.col("rank__") <= quota).drop("rank__")


def capped_round_robin(cases: DataFrame, language: str, repo: str, key: str, n: int, per_repo: int) -> DataFrame:
    """Up to n cases, languages in turn, at most per_repo of a repo.  (key, place)

    The cap depends on the turns, so the walk is sequential; it sees only rows that could be taken: the
    first per_repo of each language and repo, and of these the first n of each language's repo ranks.
    """
    import pandas as pd

    some = top_per(cases.filter(F.col(language).isNotNull()), [language, repo], per_repo, F.col(key))
    some = top_per(some, [language], 8 * n, F.col(key))
    kind = dict(cases.dtypes)[key]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = {g: list(zip(x[key], x[repo])) for g, x in pdf.sort_values(key).groupby(language)}
        used, out = {}, []
        while len(out) < n and any(queues.values()):
            for g in sorted(queues):
                while queues[g] and used.get(queues[g][0][1], 0) >= per_repo:
                    queues[g].pop(0)
                if queues[g] and len(out) < n:
                    k, r = queues[g].pop(0)
                    used[r] = used.get(r, 0) + 1
                    out.append((k, len(out)))
        return pd.DataFrame(out, columns=[key, "place"])

    return some.select(language, repo, key).groupBy().applyInPandas(walk, f"{key} {kind}, place long")


def few_shots(rows: DataFrame, pool: DataFrame, k: int, seed: str = "shots", key: str = "sample_id") -> DataFrame:
    """(language, place, sample_id, label): k examples for each language of rows, positives and negatives in turn, from the pool's samples of that language.

    pool: sample_id, language, label.  A language with less than k samples in the pool draws from all of them.  A side that has too few goes round.
    """
    languages = rows.select("language").distinct()
    some = pool.filter(F.col("label").isNotNull() & F.col(key).isNotNull())
    rank = lambda *by: F.row_number().over(W.partitionBy(*by, "label").orderBy(*hash_order(seed, key)))
    own = some.withColumn("k", rank("language")).filter(F.col("k") <= k).select(F.col("language").alias("pool"), key, "label", "k")
    all_ = some.withColumn("k", rank()).filter(F.col("k") <= k).select(F.lit(None).cast("string").alias("pool"), key, "label", "k")
    enough = some.groupBy(F.col("language").alias("of")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    source = languages.join(enough, F.col("language") == F.col("of"), "left").select("language", F.col("of").alias("source"))
    shots = own.unionByName(all_).withColumnRenamed("k", "rank")
    sides = shots.groupBy("pool", "label").agg(F.count(F.lit(1)).alias("side"))
    has = sides.groupBy("pool").agg(*[F.max(F.when(F.col("label") == x, F.col("side"))).alias(n) for x, n in ((1, "bad"), (0, "good"))])
    want = source.join(has, F.col("source").eqNullSafe(F.col("pool"))).drop("pool").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    label = F.when((F.col("place") % 2 == 0) & F.col("bad").isNotNull(), 1).when(F.col("good").isNotNull(), 0).otherwise(1)
    # the n-th example of a side: all places, if the other is missing
    alone = F.col("bad").isNull() | F.col("good").isNull()
    turn = F.when(alone, F.col("place")).otherwise(F.floor(F.col("place") / 2))
    want = want.withColumn("label", label).withColumn("rank", (turn % F.when(F.col("label") == 1, F.col("bad")).otherwise(F.col("good")) + 1).cast("int"))
    s = shots.select(F.col("pool").alias("p"), F.col("label").alias("l"), F.col("rank").alias("r"), key)
    return want.join(s, F.col("source").eqNullSafe(F.col("p")) & (F.col("label") == F.col("l")) & (F.col("rank") == F.col("r"))).select("language", F.col("place").cast("int").alias("place"), key, F.col("label").cast("int").alias("label"))


def case_packages(rows: DataFrame, case: list[str], vulnerable: str, key: str, least: int, most: int, ratio: float, seed: str = "case") -> DataFrame:
    """The packages of each synthetic manifest, with their place: as many as the case's hash says, from least to most.

    round(ratio * size) of them, one at least, are vulnerable where the case has so many; all stand in hash order.
    """
    size = least + hash_unit(F.lit(seed), *map(F.col, case)) % (most - least + 1)
    bad = F.greatest(F.lit(1), F.round(size * ratio)).cast("long")
    rank = F.row_number().over(W.partitionBy(*case, vulnerable).orderBy(*hash_order(seed, key)))
    picked = rows.withColumn("k__", rank).filter(F.col("k__") <= F.when(F.col(vulnerable), bad).otherwise(size - bad)).drop("k__")
    place = F.row_number().over(W.partitionBy(*case).orderBy(*hash_order("shuffle", key)))
    return picked.withColumn("place", place.cast("long"))
