"""Lookups and matches: advisories, novelty, hierarchy, ranges, bands, spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import one_edit_apart, severity_rank

from .curate import first_by


def dependency_status(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """deps with status affected / not_affected / unpinned / no_advisory_data, the worst advisory and how many there are.

    Worst: highest severity, then one with a CVE, then the smallest id.  Advisories shrink to one row
    per key before the join, so no dependency row is multiplied.
    """
    each = advisories.select("ecosystem", "package", F.explode("versions").alias("version"), "advisory_id", severity_rank(F.col("severity")).alias("rank"), "has_cve")
    order = F.struct("rank", F.col("has_cve").cast("int").alias("c"), (-F.col("advisory_id")).alias("i"))
    exact = each.groupBy("ecosystem", "package", "version").agg(F.max_by("advisory_id", order).alias("advisory"), F.count(F.lit(1)).alias("n_advisories"))
    known = advisories.select("ecosystem", "package").distinct().withColumn("known", F.lit(True))
    out = deps.join(exact, ["ecosystem", "package", "version"], "left").join(known, ["ecosystem", "package"], "left")
    status = F.when(F.col("known").isNull(), "no_advisory_data").when(F.col("version").isNull(), "unpinned").when(F.col("advisory").isNotNull(), "affected").otherwise("not_affected")
    return out.select(*deps.columns, status.alias("status"), "advisory", F.coalesce("n_advisories", F.lit(0).cast("long")).alias("n_advisories"))


def novelty(probes: DataFrame, index: DataFrame, position: str = "sample_id") -> DataFrame:
    """probes with known / known_location / novel and the sample matched: by body hash, else by place; first seen wins."""
    by_hash = index.groupBy("func_hash").agg(F.min(position).alias("hash_match"))
    by_place = index.groupBy("place").agg(F.min(position).alias("place_match"))
    out = probes.join(by_hash, "func_hash", "left").join(by_place, "place", "left")
    kind = F.when(F.col("hash_match").isNotNull(), "known").when(F.col("place_match").isNotNull(), "known_location").otherwise("novel")
    return out.withColumn("novelty", kind).withColumn("match", F.coalesce("hash_match", "place_match")).drop("hash_match", "place_match")


def related_classes(edges: DataFrame, kinds: DataFrame, excluded: str = "Pillar") -> DataFrame:
    """(truth, match): a class, its parents and its children, less those of the excluded kind; never empty.

    edges: (child, parent); kinds: (class, kind).
    """
    near = kinds.select(F.col("class").alias("truth"), F.col("class").alias("match")).union(edges.select("child", "parent")).union(edges.select("parent", "child")).distinct()
    kept = near.join(kinds.select(F.col("class").alias("match"), "kind"), "match").filter(F.col("kind") != excluded).select("truth", "match")
    alone = kinds.select(F.col("class").alias("truth")).join(kept.select("truth").distinct(), "truth", "left_anti")
    return kept.union(alone.select("truth", F.col("truth").alias("match")))


def band_candidates(left: DataFrame, right: DataFrame, key: str, place: str, width: int) -> DataFrame:
    """Pairs of rows with the same key whose places are at most width apart: an equi-join on places in steps of width + 1.

    The columns of right must be named otherwise than those of left, but for key; its place is `place` + "_r".
    """
    step = width + 1
    a = left.withColumn("band__", F.explode(F.array(*[F.floor(F.col(place) / step) + d for d in (-1, 0, 1)])))
    b = right.withColumn("band__", F.floor(F.col(f"{place}_r") / step))
    return a.join(b, [key, "band__"]).filter(F.abs(F.col(place) - F.col(f"{place}_r")) <= width).drop("band__")


def band_pieces(left: DataFrame, right: DataFrame, key: str, place: str, width: int) -> DataFrame:
    """(key, place, piece): the places of both sides, cut where the next one is more than width away, so that no pair within the band crosses a cut.

    Each different place is one row, so that the order of a key is over its places and not over its rows.
    """
    both = left.select(key, place).union(right.select(key, F.col(f"{place}_r"))).distinct()
    order = W.partitionBy(key).orderBy(place)
    far = F.coalesce((F.col(place) - F.lag(place).over(order) > width).cast("long"), F.lit(0))
    return both.withColumn("far", far).withColumn("piece", F.sum("far").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("far")


def greedy_matches(candidates: DataFrame, key: str, left: str, right: str, *within: str) -> DataFrame:
    """(key, left, right): each left row, in order, takes the first right row that is still free.

    Sequential inside a key and the columns of within, such as the pieces of band_pieces; matches never cross these.
    """
    import pandas as pd

    kinds = dict(candidates.dtypes)
    schema = f"{key} {kinds[key]}, {left} {kinds[left]}, {right} {kinds[right]}"

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, done, out = set(), set(), []
        for group, a, b in pdf.sort_values([left, right])[[key, left, right]].itertuples(index=False):
            if a not in done and b not in taken:
                done.add(a)
                taken.add(b)
                out.append((group, a, b))
        return pd.DataFrame(out, columns=[key, left, right])

    return candidates.select(key, left, right, *within).groupBy(key, *within).applyInPandas(match, schema)


def comparison(ours: DataFrame, theirs: DataFrame, matches: DataFrame, left: str, right: str, cwe: str = "cwe") -> DataFrame:
    """One row: how many findings two scans share, and how many each has alone.

    ours, theirs: findings with keys left and right and a class; matches: (left, right), one to one.
    agreement_rate: the share of all different findings; 0 without any.
    """
    pairs = matches.join(ours.select(left, F.col(cwe).alias("a")), left).join(theirs.select(right, F.col(cwe).alias("b")), right)
    counts = pairs.agg(F.count(F.lit(1)).alias("agreed"), F.count_if(F.col("a").startswith("CWE-") & (F.col("a") == F.col("b"))).alias("same_cwe_when_agreed"))
    size = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))
    n = counts.crossJoin(size(ours, "ai_total")).crossJoin(size(theirs, "static_total"))
    n = n.withColumn("ai_only", F.col("ai_total") - F.col("agreed")).withColumn("static_only", F.col("static_total") - F.col("agreed")).withColumn("unique_total", F.col("ai_total") + F.col("static_total") - F.col("agreed"))
    rate = F.when(F.col("unique_total") > 0, F.round(F.col("agreed") / F.col("unique_total"), 3)).otherwise(0.0)
    return n.select("ai_total", "static_total", "agreed", "ai_only", "static_only", "unique_total", rate.alias("agreement_rate"), "same_cwe_when_agreed")


def target_scores(targets: DataFrame, scanned: DataFrame, flagged: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: selected, detected (a target file flagged), localised (a target's body flagged), alarms elsewhere.

    targets: (case, file, func_hash); scanned: (case, file); flagged: (case, file, func_hash).  Raises if a target is
    flagged that was not scanned.
    """
    t, here = targets.select(case, "file").distinct(), [case, "file"]
    bodies = targets.filter("func_hash is not null").select(case, "file", "func_hash").distinct()
    mark = lambda df, name: df.select(case).distinct().withColumn(name, F.lit(True))
    seen, hit = t.join(scanned, here, "left_semi"), t.join(flagged, here, "left_semi")
    exact = bodies.join(flagged, [*here, "func_hash"], "left_semi")
    alarms = flagged.join(t, here, "left_anti").groupBy(case).agg(F.count(F.lit(1)).alias("alarms"))
    out = targets.select(case).distinct()
    for df, name in ((seen, "selected"), (hit, "detected"), (exact, "localised")):
        out = out.join(mark(df, name), case, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    out = out.join(alarms, case, "left").withColumn("alarms", F.coalesce("alarms", F.lit(0).cast("long")))
    bad = hit.join(scanned, here, "left_anti").limit(1).collect()
    if bad:
        raise ValueError(f"flagged but not scanned: {bad[0].asDict()}")
    return out


def containing(points: DataFrame, ranges: DataFrame, key: str, at: str, low: str, high: str, step: int = 64) -> DataFrame:
    """points joined to the ranges of their key that contain them: ranges are dealt into steps, so the join has keys."""
    r = ranges.withColumn("step__", F.explode(F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high) / step))))
    p = points.withColumn("step__", F.floor(F.col(at) / step))
    return p.join(r, [key, "step__"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("step__")


def lookalikes(names: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, imitated): names one edit from a listed name of 4 letters or more, the first listed winning.

    Listed names are a curated list of fixed size; names that are listed themselves imitate nothing.
    Deletion neighbourhoods make the join an equi-join: strings one edit or swap apart share one.
    """

    def cuts(c: Column) -> Column:
        return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))

    fresh = names.select("name").distinct().join(popular.select(F.col("listed").alias("name")), "name", "left_anti")
    a = fresh.select("name", F.explode(cuts(F.col("name"))).alias("cut"))
    b = popular.filter(F.length("listed") >= 4).select("listed", "pos", F.explode(cuts(F.col("listed"))).alias("cut"))
    pairs = a.join(b, "cut").select("name", "listed", "pos").distinct().filter(one_edit_apart(F.col("name"), F.col("listed")))
    return first_by(pairs, ["name"], F.col("pos")).select("name", F.col("listed").alias("imitated"))


def not_own(rows: DataFrame, names: DataFrame, of: str) -> DataFrame:
    """rows less those about a name of their own repo: names (repo, name) and, of scoped ones (@scope/name), the part after the scope; in any case."""
    own = names.select("repo", F.explode(F.array(F.lower("name"), F.element_at(F.split(F.lower("name"), "/"), -1))).alias("own")).distinct()
    return rows.join(own.withColumnRenamed("repo", "repo_"), (F.col("repo") == F.col("repo_")) & (F.lower(of) == F.col("own")), "left_anti")


def split_overlap(rows: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """(key, a, b, shared): distinct non-null values that two splits share, for each key column."""
    v = rows.select(F.col(split).alias("split"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")).select("split", "x.*").filter("value is not null").distinct()
    pairs = v.select("key", "value", F.col("split").alias("a")).join(v.select("key", "value", F.col("split").alias("b")), ["key", "value"]).filter("a < b")
    return pairs.groupBy("key", "a", "b").agg(F.count(F.lit(1)).alias("shared"))


def top_per(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key in a total order."""
    return rows.withColumn("rank__", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank__") <= n).drop("rank__")
