import random
import zlib

import numpy as np
import pytest

from formline.llm import toxicity

COMMON = [a + b for a in ("th", "er", "on", "an", "re", "st") for b in ("ing", "ed", "er", "tion", "ly", "es")]
STEMS = ["lowei", "vequor", "chllan"]


def text(rng, toxic, n=120):
    words = [rng.choice(COMMON) + rng.choice(["", "", rng.choice(COMMON)]) for _ in range(n)]
    for _ in range(5 if toxic else 0):
        words[rng.randrange(n)] = rng.choice(STEMS) + rng.choice(["ed", "er", "tion", "es", "ing", "!"])
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, text(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(1200)]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    extra = [(None, None, 0), (7000, "", 0), (7001, "x" * 300_000, 0), (7001, "x" * 300_000, 0), (7002, "word " * 200_000, 0)]
    out = toxicity.score(docs.union(spark.createDataFrame(extra, docs.schema)), model, carry=["score"]).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {i: y for i, _, y in rows}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in out)
    right = [r.predicted == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]
    assert len(right) > 150 and np.mean(right) > 0.97
    assert {r.predicted for r in out if r.doc_id in (None, 7000, 7001, 7002)} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_labels_are_not_read(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    one = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    other = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows] + [(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    assert toxicity.train(docs, one) == toxicity.train(docs, other)


def test_bounded_sample(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = []
    original, toxicity.fit = toxicity.fit, lambda a, b, share: seen.append((len(a), len(b))) or original(a, b, share)
    try:
        toxicity.train(docs, labels, max_toxic=50, max_ordinary=70)
    finally:
        toxicity.fit = original
    assert seen[0][0] <= 50 and seen[0][1] <= 70 and min(seen[0]) > 30


def test_without_labels(spark, rows):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, ones)).collect()} == {1.0}


def test_given_documents(spark):
    from formline.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in QUERIES["op6_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.93
    assert np.mean([r.predicted for r in out if not truth[r.doc_id]]) < 0.03


def test_repeated_ids_do_not_pass_the_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 400, f"text {i % 3} of {i % 400} " * 4) for i in range(8000)] + [(1, "short")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] * 2, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary, share: seen.append((toxic, ordinary)))
    toxicity.train(docs, labels, max_toxic=30, max_ordinary=40, max_chars=500)
    for texts, most in zip(seen[0], (30, 40)):
        assert 0 < len(texts) <= most and sum(map(len, texts)) <= 500
