"""Nearest neighbours against exact search; the shard store against its rows."""

import numpy as np

from siltstone.llm.kmeans_tree import tree_neighbours
from siltstone.llm.tiered_shards import ShardStore, shard_table

from .conftest import ODD, docs_of


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 12)) + 3 * rng.normal(size=(30, 12))[rng.integers(0, 30, 900)]
    x[100:180] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [1.0] * 12), (2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [1.0] * 11), (2080, [None] * 12), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in tree_neighbours(df, leaf_rows=20, shard_rows=60, block_queries=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 20))
    recall = []
    for q, hits in got.items():
        s = np.einsum("ij,j->i", x, x[q])
        ids = np.array([i for i in np.lexsort((np.arange(900), -s)) if i != q][:20])
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21)) and q not in [h[1] for h in hits]
        assert np.allclose([h[2] for h in hits], [s[h[1]] for h in hits], rtol=1e-12)
        assert [(-h[2], h[1]) for h in hits] == sorted((-h[2], h[1]) for h in hits)
        recall.append(len({h[1] for h in hits} & set(ids.tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in tree_neighbours(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert tree_neighbours(df.limit(0)).count() == 0


def test_shards_hold_every_row(spark, tmp_path):
    rows = ODD + [(100 + i, f"text {i} " * 40) for i in range(3000)]
    docs = docs_of(spark, rows)
    out = shard_table(docs, target_bytes=40_000, fan_in=3, number=5, root=str(tmp_path / "store"))
    same = docs.columns
    assert out.select(same).exceptAll(docs).count() == 0 and docs.exceptAll(out.select(same)).count() == 0
    store = ShardStore(spark, str(tmp_path / "store"), 40_000, 3)
    listed = {s["file"].split("/data/")[1] for s in store.manifest()["shards"]}
    assert {r.shard for r in out.select("shard").distinct().collect()} <= listed
    assert not store.plan() and len(store.versions()) == 1 and store.versions()[-1] > 5
    files = {f.split("/data/")[1] for f in map(str, (tmp_path / "store" / "data").rglob("part-*.parquet"))}
    assert files == listed


def test_registered_query_merges_two_tiers(spark, monkeypatch, tmp_path):
    """With the query's own parameters: sixteen arrivals become four shards, and these one."""
    done, compact = [], ShardStore.compact
    monkeypatch.setattr(ShardStore, "compact", lambda self, **how: done.extend(compact(self, **how)))
    docs_of(spark, [(i, " ".join(str(i * k * 7919 % 5003) for k in range(60))) for i in range(4000)]).coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    out = shard_table(spark.read.parquet(str(tmp_path / "d.parquet")))
    assert len(done) == 5 and len(set(done[:4])) == 1 and done[4] < done[0]
    assert out.count() == 4000 and out.select("shard").distinct().count() == 1 and out.first().store_version == 18


def test_left_over_shards_stay(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), 100_000, 3)
    for k in range(8):
        store.append(docs_of(spark, [(k, f"{k} " * 3000)]).coalesce(1))
    assert [len(r) for r in store.plan()] == [3, 3]
    tiers = store.compact()  # two runs of three in one commit; what they become may be a run with the two that were left
    assert len(tiers) >= 2 and not store.plan() and len(store.manifest()["shards"]) == 8 - 2 * len(tiers) and store.read().count() == 8 and store.versions()[-1] == 7 + len(tiers)


def test_versions_stay_until_vacuum(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), 10_000, 2)
    for k in range(5):
        store.append(docs_of(spark, [(k, "some text " * 50)]).coalesce(1))
    store.compact()
    assert store.versions() == list(range(1, store.versions()[-1] + 1)) and store.read(1).count() == 1 and store.read(5).count() == 5
    last = store.versions()[-1]
    assert store.vacuum(keep=2) > 0 and store.versions() == [last - 1, last] and store.read().count() == store.read(last - 1).count() == 5


def test_lost_race(spark, tmp_path):
    """Another writer commits between a writer's look at the manifest and its rename: it tries again on the newer version."""
    store, other = ShardStore(spark, str(tmp_path / "s")), ShardStore(spark, str(tmp_path / "s"))
    new, tries = store._write(docs_of(spark, [(1, "a")])), []

    def change(base):
        tries.append(base["version"])
        if len(tries) == 1:
            other.append(docs_of(spark, [(2, "b")]))
        return base["shards"] + new

    store._commit(change)
    assert tries == [0, 1] and store.versions() == [1, 2] and sorted(r.doc_id for r in store.read().collect()) == [1, 2]
    assert not [f for f in (tmp_path / "s" / "manifest").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]
    assert shard_table(docs_of(spark, []), root=str(tmp_path / "e")).count() == 0


def test_repeated_query_ids_have_one_vector(spark):
    df = spark.createDataFrame([(20, [0.0, 2.0]), (20, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = tree_neighbours(df).orderBy("rank").collect()
    assert {r.query_id for r in got} == {20} and got[0].vec_id == 2 and got[0].score == 6.0
