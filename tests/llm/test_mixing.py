import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import mixing as mix

SCHEMA = "doc_id long, text string, source string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Shares by weight, capped at twice the size, by giving out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    aim, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        heft = sum(weight[s] for s in open_)
        for s in open_:
            aim[s] += left * weight[s] / heft
        left = sum(max(aim[s] - 2 * sizes[s], 0) for s in names)
        for s in names:
            aim[s] = min(aim[s], 2.0 * sizes[s])
        open_ = {s for s in names if aim[s] < 2 * sizes[s] - 1e-12}
    return aim


def documents(seed=1, n=500):
    rng = random.Random(seed)
    sources = ["b", "a", "", None, "Z", "é", "tiny"]
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice(sources[:6] + ["a"] * 4)) for i in range(n)]
    return rows + [(9000, "one two three", "tiny"), (9001, None, "tiny"), (9002, "\t \n", "empty"), (None, "no id", "a"), (7, "again and again", "a"), (7, "again and again", "a"),
                   (9003, "w w\x0bx " * 4000, "b")]


def test_targets_quotas_and_taken_words(spark):
    rows = documents()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    aim = brute_targets(sizes)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mix.taken(docs, block_words=64, shard_blocks=8).join(
        docs.select("doc_id", "text", "source").distinct(), "doc_id", "left").collect()
    placed, drawn, pieces = mix.mix(mix.sizes(docs), block_words=64, shard_blocks=8)
    taken = {r["source"]: r["n"] for r in pieces.join(placed.select("row", "source"), "row").groupBy("source").agg(F.sum("n_words").alias("n")).collect()}
    for r in drawn.collect():
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(aim[r["source"]], rel=1e-9, abs=1e-9)
        assert taken.get(r["source"], 0) == int(np.floor(r["target"] + 0.5))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert sum(r["target"] for r in drawn.collect()) == pytest.approx(1.5 * sum(sizes.values()))
    assert mix.taken(docs).count() == len(rows)


def test_pieces_are_disjoint_in_every_pass_and_shards_are_even(spark):
    docs = spark.createDataFrame(documents(2), SCHEMA)
    rows, drawn, pieces = mix.mix(mix.sizes(docs), block_words=32, shard_blocks=4)
    size = {r["row"]: r["size"] for r in rows.collect()}
    seen, shards, places = {}, {}, {}
    for p in pieces.collect():
        span = seen.setdefault((p["row"], p["pass"]), set())
        mine = set(range(p["first_word"], p["first_word"] + p["n_words"]))
        assert mine and not span & mine and max(mine) < size[p["row"]]
        span |= mine
        shards.setdefault(p["shard"], set()).add((p["rank"], p["pass"], p["block"]))
        places.setdefault(p["shard"], []).append(p["position"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    total = drawn.agg(F.sum("quota")).first()[0]
    assert sorted(shards) == list(range(-(-total // 4))) and sum(map(len, shards.values())) == total
    assert all(len(b) == 4 for s, b in shards.items() if s < max(shards))
    owners = [b for v in shards.values() for b in v]
    assert len(owners) == len(set(owners))


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.createDataFrame(documents(3), SCHEMA)
    once = [sorted(map(tuple, mix.taken(d, block_words=50).collect()), key=repr) for d in (docs.repartition(1), docs.repartition(7, "text"))]
    assert once[0] == once[1]


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        for key in (0, 5, 123456789):
            k = np.arange(n)
            p = mix.permuted(k, np.full(n, n), np.full(n, key))
            assert sorted(p) == list(k)
    n = 5000
    a, b = (mix.permuted(np.arange(n), np.full(n, n), np.full(n, key)) for key in (1, 2))
    assert abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.06 and abs(np.corrcoef(a, b)[0, 1]) < 0.06


def test_splits_follow_the_hypergeometric_distribution():
    quota, start = np.array([30, 50, 20]), np.zeros(3, np.int64)
    left = []
    for seed in range(800):
        (low, mid, ranks, drawn, _), (_, high, others, rest, begin) = mix.split(0, 10, np.arange(3), quota, start, 10, 100, seed)
        assert (low, mid, high) == (0, 5, 10) and drawn.sum() == 50 and rest.sum() == 50
        full = dict(zip(ranks, drawn))
        assert all(full.get(r, 0) + q == quota[r] and b == full.get(r, 0) for r, q, b in zip(others, rest, begin))
        left.append([full.get(r, 0) for r in range(3)])
    mean, var = np.mean(left, axis=0), np.var(left, axis=0)
    assert np.abs(mean - quota / 2).max() < 0.5
    assert np.abs(var / (50 * (quota / 100) * (1 - quota / 100) * 50 / 99) - 1).max() < 0.2


def test_empty_and_wordless_tables(spark):
    assert mix.taken(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, "a"), (2, "", None)]
    assert sorted(tuple(r) for r in mix.taken(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_other_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "a b", "s", 4, 5, 6)], SCHEMA + ", size int, row int, rank int")
    assert [tuple(r) for r in mix.taken(df).collect()] == [(1, 2, 2, 3.0, 3)]


def test_too_many_blocks_are_refused(spark):
    sized = spark.createDataFrame([(1, "s", 4 * 10 ** 9)], "doc_id long, source string, size long")
    drawn = mix.quotas(mix.targets(mix.placed(sized)), block_words=1)
    with pytest.raises(ValueError, match="enlarge block_words"):
        mix.shard_plan(drawn)
