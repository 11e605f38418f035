"""How runs go from blocks of documents to groups of the tree and back."""

import numpy as np
import pytest

from formline.llm import lm

U = np.uint64


def test_turned_runs_come_back_and_stand_by_suffix():
    runs = np.random.default_rng(4).integers(0, 2 ** 56, 5_000).astype(U)
    assert (lm.turned_back(lm.turned(runs)) == runs).all()
    a, b = (np.array([int.from_bytes(x, "big")], U) for x in (b"zyxthea"[:6] + b"!", b"aaxthea"[:6] + b"!"))
    assert int(lm.turned(a)[0]) >> 32 == int(lm.turned(b)[0]) >> 32


def test_blocks_of_any_size_give_the_same_scores(spark, monkeypatch):
    rows = [(i, f"the {'other ' * (i % 7)}word {i % 13} and é{i % 5}") for i in range(400)] + [(5, "twice"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score(docs).collect())
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1_500)
    monkeypatch.setattr(lm, "GROUP_RUNS", 30)
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score(docs).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) == len(rows)
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)


def test_texts_are_shuffled_once_and_not_stored(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(lm, "materialize", lambda df, real=lm.materialize: plans.append(df.columns) or real(df))
    lm.score(spark.createDataFrame([(i, "some text") for i in range(20)], "doc_id long, text string"))
    assert not any("text" in columns for columns in plans)
