"""Evaluation: scores per configuration, paired tests, intervals, multiplicity, agreement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.metrics import binary_metrics, confusion
from siltstone.functions.text import hash_unit

from .curate import written


def confusion_by(preds: DataFrame, *keys: str, null_as_negative: bool = False) -> DataFrame:
    return preds.groupBy(*keys).agg(*confusion(F.col("pred"), F.col("truth"), null_as_negative))


def scored_by(preds: DataFrame, *keys: str, null_as_negative: bool = False, empty: float | None = 0.0) -> DataFrame:
    return confusion_by(preds, *keys, null_as_negative=null_as_negative).select("*", *[v.alias(k) for k, v in binary_metrics(empty).items()])


def macro_f1(preds: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Unweighted mean of one-vs-rest F1 over the true classes, over all rows; related (truth, match) makes it lenient."""
    classes = preds.filter("truth = 1").select("config", F.col("true_cwe").alias("class")).distinct()
    rel = classes.select("class", F.col("class").alias("match")) if related is None else related.select(F.col("truth").alias("class"), "match")
    rel = rel.union(classes.select("class", "class")).distinct()
    hits = preds.filter("pred_cwe is not null").select("config", F.col("pred_cwe").alias("match"), "true_cwe").join(rel, "match")
    hits = hits.groupBy("config", "class").agg(F.count_if(F.col("true_cwe") == F.col("class")).alias("tp"), F.count_if(~F.coalesce(F.col("true_cwe") == F.col("class"), F.lit(False))).alias("fp"))
    pos = preds.filter("truth = 1").groupBy("config", F.col("true_cwe").alias("class")).agg(F.count(F.lit(1)).alias("p"))
    f1 = pos.join(hits, ["config", "class"], "left").na.fill(0, ["tp", "fp"])
    return f1.groupBy("config").agg(F.round(F.avg(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))), 6).alias("macro_f1"))


def paired(preds: DataFrame, least: int = 10) -> DataFrame:
    """b01, b10 of each pair of configurations over the samples both have; null verdicts count as negative."""
    right = F.coalesce("pred", F.lit(0)) == F.col("truth")
    a = preds.select("sample_id", F.col("config").alias("a"), right.alias("ra"), F.col("truth").alias("ta"))
    b = preds.select("sample_id", F.col("config").alias("b"), right.alias("rb"), F.col("truth").alias("tb"))
    both = a.join(b, "sample_id").filter("a < b")
    counts = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ra") & ~F.col("rb")).alias("b10"), F.count_if(~F.col("ra") & F.col("rb")).alias("b01"), F.count_if(F.col("ta") != F.col("tb")).alias("conflicts"))
    return counts.filter(F.col("n") >= least)


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series after seven steps up; right to 1e-11."""
    x = n.cast("double") + 1
    steps = F.lit(0.0)
    for k in range(7):
        steps = steps + F.log(x + k)
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def mcnemar_p(b01: Column, b10: Column) -> Column:
    """Exact two-sided p: the binomial tail from its largest term downwards.

    Each term is the one before times i / (n - i + 1); beyond ten deviations they are below 1e-80 and left out, so
    that a row needs no more memory than a root of its counts.
    """
    n, k = b01 + b10, F.least(b01, b10)
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2.0))
    terms = F.sequence(k, F.greatest(F.lit(1).cast("long"), k - F.ceil(20 * F.sqrt(n) + 50)), F.lit(-1).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * i / (n - i + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    tail = F.when(k > 0, F.aggregate(terms, start, add, lambda s: s["sum"])).otherwise(1.0)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * top * tail))


def with_mcnemar(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("p", mcnemar_p(F.col("b01"), F.col("b10")))


def holm(tests: DataFrame, key: str, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Step-down: adjusted = running maximum of min(1, p (m - i)); rejected until the first failure."""
    order = W.orderBy(p, key)
    m = F.count(F.lit(1)).over(W.partitionBy())
    left = m - F.row_number().over(order) + 1
    run = order.rowsBetween(W.unboundedPreceding, 0)
    t = tests.withColumn("left", left)
    return t.withColumn("adjusted", F.max(F.least(F.lit(1.0), F.col(p) * F.col("left"))).over(run)).withColumn("rejected", F.min((F.col(p) <= alpha / F.col("left")).cast("int")).over(run) == 1).drop("left")


def binomial(size: Column, share: Column, unit: Column) -> Column:
    """The value of a binomial distribution at a place 0 < unit < 1 of its distribution function.

    Terms follow from each other; beyond ten deviations from the mean they are below 1e-20 and left out, so that a draw takes a
    number of steps that grows as the root of size.
    """
    n, p = size.cast("double"), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    far = 10 * F.sqrt(n * p * (1 - p)) + 12
    low, high = F.greatest(F.lit(0), F.floor(n * p - far)).cast("long"), F.least(size, F.ceil(n * p + far)).cast("long")
    first = F.exp(log_factorial(size) - log_factorial(low) - log_factorial(size - low) + low * F.log(p) + (size - low) * F.log1p(-p))
    start = F.struct(first.alias("term"), first.alias("sum"), low.alias("k"))

    def step(s: Column, k: Column) -> Column:
        more = s["sum"] < unit
        term = s["term"] * ((n - k + 1) / k) * (p / (1 - p))
        return F.when(more, F.struct(term.alias("term"), (s["sum"] + term).alias("sum"), k.alias("k"))).otherwise(s)

    inner = F.aggregate(F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>")), start, step, lambda s: s["k"])
    return F.when(p <= 0, F.lit(0).cast("long")).when(p >= 1, size.cast("long")).otherwise(inner)


def resampled_cells(preds: DataFrame, reps: int) -> DataFrame:
    """(config, rep, n, tp, fp, tn, fn) of each bootstrap replicate of a configuration.

    Confusion cells are sufficient, and those of a replicate are multinomial: each is a binomial draw from what the cells before it
    have left, at the place that a hash of the replicate and the cell gives.  No row is drawn.
    """
    cells = confusion_by(preds, "config", null_as_negative=True).withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).filter("n > 0")
    drawn = written(cells, "cells").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition("config", "rep")
    left, whole = F.col("n"), F.col("n")
    for k, name in enumerate(("tp", "fp", "tn")):
        unit = (hash_unit(F.col("rep"), F.lit(k)) + 0.5) / 2.0**32
        share = F.when(whole > 0, F.col(name) / whole).otherwise(0.0)
        drawn = drawn.withColumns({f"left{k}": left, f"share{k}": share, f"unit{k}": unit})
        drawn = drawn.withColumn(f"drawn{k}", binomial(F.col(f"left{k}"), F.col(f"share{k}"), F.col(f"unit{k}")))
        left, whole = F.col(f"left{k}") - F.col(f"drawn{k}"), whole - F.col(name)
    return drawn.select("config", "rep", "n", *[F.col(f"drawn{k}").alias(name) for k, name in enumerate(("tp", "fp", "tn"))], left.alias("fn"))


def bootstrap(preds: DataFrame, metrics: tuple[str, ...] = ("f1",), reps: int = 200, alpha: float = 0.05) -> DataFrame:
    """(config, metric, low, high): percentile intervals of binary metrics."""
    known = binary_metrics(0.0)
    one = resampled_cells(preds, reps).select("config", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), known[m].alias("value")) for m in metrics])).alias("x")).select("config", "x.*")
    return percentile_interval(one, ["config", "metric"], "value", reps, alpha)


def bootstrap_f1(preds: DataFrame, reps: int = 200, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of F1 per configuration."""
    return bootstrap(preds, ("f1",), reps, alpha).drop("metric")


def report(preds: DataFrame, metrics: tuple[str, ...] = ("f1", "mcc", "balanced_accuracy"), reps: int = 200) -> tuple[DataFrame, DataFrame]:
    """The composed report: (config, n, parse_fail_rate, metric, point, low, high) and the paired tests with Holm's correction.

    Raises if a configuration judges a sample twice, or if two of them hold different truths for one.
    """
    twice = preds.groupBy("config", "sample_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated prediction {twice[0].asDict()}")
    n = preds.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("pred").isNull().cast("int")), 4).alias("parse_fail_rate"))
    points = scored_by(preds, "config", null_as_negative=True).select("config", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 6).alias("point")) for m in metrics])).alias("x")).select("config", "x.*")
    pairs = paired(preds)
    if not pairs.filter("conflicts > 0").isEmpty():
        raise ValueError("paired predictions hold different truths")
    tests = with_mcnemar(pairs).withColumn("pair", F.concat_ws("/", "a", "b"))
    return n.join(points, "config").join(bootstrap(preds, metrics, reps), ["config", "metric"]), holm(tests, "pair")


def best_strategies(scored: DataFrame, model: str = "model") -> DataFrame:
    """Per model the best strategy among those without request errors that kept the format throughout; best: the best of all models.

    scored: model, strategy, n, f1, balanced_accuracy, format_adherence, api_errors.  Ties go to the first in name.
    """
    valid = scored.filter((F.coalesce("api_errors", F.lit(0)) == 0) & (F.col("format_adherence") == 1.0) & (F.col("n") > 0))
    order = F.desc("f1"), F.desc("balanced_accuracy"), F.col("strategy")
    winners = valid.withColumn("k", F.row_number().over(W.partitionBy(model).orderBy(*order))).filter("k = 1").drop("k")
    top = winners.agg(F.min(F.struct((-F.col("f1")).alias("f"), F.col(model).alias("m"))).alias("top"))
    return winners.crossJoin(F.broadcast(top)).withColumn("best", F.col(model).eqNullSafe(F.col("top.m"))).drop("top")


def percentile_interval(values: DataFrame, key: str | list[str], value: str, reps: int, alpha: float) -> DataFrame:
    """Values at floor(alpha/2 reps) and floor((1 - alpha/2) reps) - 1 of the sorted replicates."""
    s = F.array_sort(F.collect_list(value))
    return values.groupBy(*([key] if isinstance(key, str) else key)).agg(F.round(F.element_at(s, int(alpha / 2 * reps) + 1), 6).alias("low"), F.round(F.element_at(s, int((1 - alpha / 2) * reps)), 6).alias("high"))


def cluster_bootstrap(preds: DataFrame, cluster: str, reps: int = 200, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of accuracy per configuration, resampling whole clusters by hash."""
    per = preds.groupBy("config", cluster).agg(F.count_if(F.coalesce("pred", F.lit(0)) == F.col("truth")).alias("right"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("at", F.row_number().over(W.partitionBy("config").orderBy(cluster)) - 1).withColumn("k", F.count(F.lit(1)).over(W.partitionBy("config")))
    slots = per.select("config", F.col("at").alias("slot"), "k").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    slots = slots.select("config", "rep", (hash_unit(F.col("rep"), F.col("slot")) % F.col("k")).cast("int").alias("at"))
    one = slots.join(per, ["config", "at"]).groupBy("config", "rep").agg((F.sum("right") / F.sum("n")).alias("accuracy"))
    return percentile_interval(one, "config", "accuracy", reps, alpha)


def sign_flip(preds: DataFrame, a: str, b: str, cluster: str, reps: int = 500) -> DataFrame:
    """Permutation p of the accuracy difference of two configurations, flipping whole clusters."""
    right = (F.coalesce("pred", F.lit(0)) == F.col("truth")).cast("int")
    d = preds.filter(F.col("config").isin(a, b)).groupBy(cluster).agg(F.sum(F.when(F.col("config") == a, right).otherwise(-right)).alias("d")).filter("d <> 0")
    draws = d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    sign = F.when(hash_unit(F.col("rep"), F.col(cluster)) % 2 == 0, 1).otherwise(-1)
    flips = draws.groupBy("rep").agg(F.abs(F.sum(F.col("d") * sign)).alias("flip"), F.abs(F.sum("d")).alias("seen"))
    return flips.agg(F.round((F.count_if(F.col("flip") >= F.col("seen")) + 1) / F.lit(reps + 1), 6).alias("p")).crossJoin(d.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("d"), F.lit(0)).alias("difference")))


def _ranked(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, upto, n): each different value once, with the number of rows up to it and of all rows of its key."""
    per = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(key)
    return per.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))


def exclusive_quantiles(rows: DataFrame, key: str, value: str, parts: int = 4) -> DataFrame:
    """Quantiles by the (n + 1) p convention, by rank arithmetic over different values; groups of one row are left out."""
    r = _ranked(rows, key, value).filter("n > 1")
    out = []
    for i in range(1, parts):
        j = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(i * (F.col("n") + 1) / parts)))
        delta = i * (F.col("n") + 1) - j * parts
        low, high = F.min(F.when(F.col("upto") >= j, F.col(value))), F.min(F.when(F.col("upto") >= j + 1, F.col(value)))
        out.append(F.round((low * (parts - F.max(delta)) + high * F.max(delta)) / parts, 6).alias(f"q{i}"))
    return r.groupBy(key).agg(*out)


def index_quantiles(rows: DataFrame, key: str, value: str, **places: tuple[int, int]) -> DataFrame:
    """Per key and (over, of) the value at index over * n // of of the sorted values."""
    at = {name: F.min(F.when(F.col("upto") > F.floor(over * F.col("n") / of), F.col(value))) for name, (over, of) in places.items()}
    return _ranked(rows, key, value).groupBy(key).agg(*[v.alias(k) for k, v in at.items()])
