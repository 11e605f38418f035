import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import components, minhash


def elements(text):
    words = minhash.normal(text or "").split()
    seen, out = Counter(), set()
    for i in range(max(1, len(words) - 4) if words else 0):
        run = tuple(words[i:i + 5])
        out.add((run, seen[run]))
        seen[run] += 1
    return out


def classes(rows, similar=0.8):
    """Closed links by comparing every pair; rows of (id, text)."""
    sets = [elements(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (common and common >= similar * (len(sets[i]) + len(sets[j]) - common)):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted((min(g), len(g)) for g in groups.values() for _ in g)


WORDS = [f"w{i}" for i in range(3000)]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 9)}"
    return " ".join(words)


def corpus(seed):
    """Copies in small groups, a hub whose copies are unlike each other, and a crowd that shares a passage."""
    rng = random.Random(seed)
    new = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [new(rng.randrange(1, 400)) for _ in range(150)]
    for t in texts[:60]:
        texts += [edited(rng, t, rng.randrange(4)) for _ in range(rng.randrange(3))]
    hub = new(400)
    texts += [hub] + [edited(rng, hub, 7) for _ in range(60)]
    passage = new(150)
    texts += [passage + " " + new(50 + rng.randrange(60)) for _ in range(60)]
    texts += ["", " \n", "one", "One", "two words", "a a a a a a a a", "a a a a a a a a a", new(30_000)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, together", [(1, 1500), (2, 20)])
def test_classes_against_all_pairs(spark, monkeypatch, seed, together):
    monkeypatch.setattr(minhash, "TOGETHER", together)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, node string")
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    assert sorted((r.class_id, r.class_size) for r in out) == classes(rows)


def test_signature_estimates_weighted_similarity():
    rng = random.Random(4)
    a = [" ".join(rng.choice(WORDS[:40]) for _ in range(rng.randrange(20, 900))) for _ in range(200)]
    b = [edited(rng, t, max(1, len(t.split()) // 60)) for t in a]
    both = [minhash.signatures(*minhash.elements([minhash.normal(t) for t in x])) for x in (a, b)]
    estimate = (both[0] == both[1]).mean(axis=1)
    truth = np.array([len(elements(x) & elements(y)) / len(elements(x) | elements(y)) for x, y in zip(a, b)])
    error = estimate - truth
    assert abs(error.mean()) < 0.01 and math.sqrt((error ** 2).mean()) < 0.035


def test_nulls_repeats_carried_and_empty(spark):
    rows = [(None, None, 1), (5, "", 2), (7, "the same text here now", 3), (7, "the same text here now", 3),
            (7, "another text", 4), (None, "The same  text here NOW", 5), (9, "x y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    out = minhash.near_duplicates(docs, carry=["class_id"]).collect()
    got = sorted((r.carried.class_id, r.doc_id, r.class_id, r.class_size) for r in out)
    assert got == [(1, None, 5, 2), (2, 5, 5, 2), (3, 7, 7, 3), (3, 7, 7, 3), (4, 7, 7, 1), (5, None, 7, 3), (6, 9, 9, 1)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_random_links_and_a_path(spark):
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(70)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(df.where(F.col("a") < 0)).count() == 0


def test_large_outside_set_misses_no_pair_of_one_band(spark, monkeypatch):
    """Two similar nodes that share one bucket only, in a crowd larger than ``TOGETHER``."""
    monkeypatch.setattr(minhash, "TOGETHER", 2)
    rng = np.random.default_rng(5)
    brief = rng.integers(0, 256, (14, minhash.COORDINATES)).astype(np.uint8)
    brief[:, :minhash.ROWS] = 7
    brief[1] = brief[0]
    brief[1, minhash.ROWS:minhash.BANDS * minhash.ROWS:minhash.ROWS] ^= 1  # no other band agrees
    rows = [(bytes([i]), [0] + [100 * i + b for b in range(1, minhash.BANDS)], brief[i].tobytes()) for i in range(len(brief))]
    nodes = spark.createDataFrame(rows, "node binary, bands array<long>, brief binary")
    members = nodes.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("band"), "node")
    roots = spark.createDataFrame([], "node binary, root binary")
    got = minhash.left_over(members, nodes, roots, 0.8).collect()
    assert [(bytes(r.a), bytes(r.b)) for r in got] == [(b"\x01", b"\x00")]


def test_estimates_may_be_four_deviations_low(spark):
    """277 of 384 coordinates agree: 3.85 deviations below 0.8."""
    brief = np.zeros((2, minhash.COORDINATES), np.uint8)
    brief[1, 277:] = 1
    rows = [(bytes([i]), [0], b.tobytes()) for i, b in enumerate(brief)]
    nodes = spark.createDataFrame(rows, "node binary, bands array<long>, brief binary")
    members = nodes.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("band"), "node")
    assert minhash.left_over(members, nodes, spark.createDataFrame([], "node binary, root binary"), 0.8).count() == 1
