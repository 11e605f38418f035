import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import multi_index as index


def brute(rows, queries, k=5):
    vectors = {i: v for i, v in rows}
    out = {}
    for q in queries:
        a = vectors[q]
        scores = [(math.fsum(x * y for x, y in zip(a, v)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(x * x for x in v)), i)
                  for i, v in vectors.items() if i != q]
        out[q] = sorted(scores, key=lambda s: (-round(s[0], 12), s[1]))[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_all_cells_give_exact_results_with_ties(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(7)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, [x * 3 for x in rows[10][1]])]
    got = index.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, share=1.0).collect()
    want = brute(rows, [i for i, _ in rows if i % 50 == 0])
    assert len(got) == 5 * len(want)
    for r in got:
        score, vec = want[r.query_id][r["rank"] - 1]
        assert r.vec_id == vec and r.score == pytest.approx(score, abs=1e-12)


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1e-300, 1e-300]), (9, [-1e-300, 1e-300]), (50, [3.0, 0.0])]
    got = index.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 50), (0, 2, 1), (0, 3, 9), (50, 1, 0), (50, 2, 1), (50, 3, 9)]
    assert got[2].score == pytest.approx(-math.sqrt(0.5))
    assert index.nearest(frame(spark, [])).count() == 0
    assert index.nearest(frame(spark, [(1, None)])).count() == 0
    assert index.nearest(frame(spark, [(1, [2.0])])).count() == 0


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    v = rows.toPandas()
    unit = np.stack(v.embedding).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = v.vec_id.to_numpy()
    original, index.LEAST = index.LEAST, 1  # so that the share decides, as in large tables
    try:
        got = index.nearest(rows, F.col("vec_id") % 50 == 0).toPandas()
    finally:
        index.LEAST = original
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[q]
        near[q] = -2
        hits += len(set(got[got.query_id == ids[q]].vec_id) & set(ids[np.argsort(-near)[:5]]))
    assert len(got) == 5 * (ids % 50 == 0).sum()
    assert hits / len(got) >= 0.9


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    sizes = rng.integers(0, 4, 63)
    cells = index.traverse([a, b], sizes, int(sizes.sum()))
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sums == sorted(sums) and set(cells) == set(np.flatnonzero(sizes))
    assert sum(sizes[index.traverse([a, b], sizes, 10)]) >= 10
