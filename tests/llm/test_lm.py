import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from formline.llm import lm
from formline.llm.minhash import normal

U = np.uint64
SYLLABLES = ["th", "er", "on", "an", "re", "sch", "é", "ing", "The", "X"]


def texts(seed, n=300):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))
    return [rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randrange(60))) for _ in range(n)]


def training(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2


def tree(corpus):
    """The same tree in plain Python: a function from (context, byte) to its probability."""
    after = [defaultdict(Counter) for _ in range(lm.DEPTH + 1)]
    places = 0
    for t in corpus:
        s = b"\n" * lm.DEPTH + normal(t) + b"\n"
        for i in range(lm.DEPTH, len(s)):
            places += 1
            for k in range(lm.DEPTH + 1):
                after[k][s[i - k:i]][s[i]] += 1
    listed = {}
    for k in range(1, lm.DEPTH + 1):
        for c, n in after[k].items():
            if n.total() >= lm.CONTEXT_SHARE * places:
                rows = {x: m for x, m in n.items() if m >= lm.SYMBOL_SHARE * places}
                if rows:
                    listed[c] = rows
    root = {x: (after[0][b""][x] + 1) / (places + 256) for x in range(256)}
    kept = set()
    for c in sorted(listed, key=len, reverse=True):
        n, up = after[len(c)][c], after[len(c) - 1][c[1:]]
        total, above = n.total(), up.total()
        # the root's counts have one added to every byte
        share = (lambda x: (up[x] + 1) / (above + 256)) if len(c) == 1 else (lambda x: up[x] / above)
        evidence = sum(m * math.log(m / total / share(x)) for x, m in listed[c].items())
        if c in kept or (evidence >= lm.LEAST_EVIDENCE and evidence >= lm.LEAST_DIVERGENCE * sum(listed[c].values())):
            kept.add(c)
            if len(c) > 1:
                kept.add(c[1:])
    memo = {}

    def p(c, x):
        while c and c not in kept:
            c = c[1:]
        if not c:
            return root[x]
        if (c, x) not in memo:
            n, d = after[len(c)][c].total(), len(after[len(c)][c])
            own = {y: (m + d * p(c[1:], y)) / (n + d) for y, m in listed[c].items()}
            rest = max(1 - sum(own.values()), 1e-12) / max(1 - sum(p(c[1:], y) for y in own), 1e-12)
            memo[c, x] = own[x] if x in own else rest * p(c[1:], x)
        return memo[c, x]
    return p


def log10_of(p, text):
    s = b"\n" * lm.DEPTH + normal(text) + b"\n"
    return sum(math.log10(p(s[i - lm.DEPTH:i], s[i])) for i in range(lm.DEPTH, len(s)))


@pytest.mark.parametrize("context_share, group_runs", [(lm.CONTEXT_SHARE, lm.GROUP_RUNS), (2e-3, lm.GROUP_RUNS), (lm.CONTEXT_SHARE, 40)])
def test_scores_against_plain_python(spark, monkeypatch, context_share, group_runs):
    monkeypatch.setattr(lm, "GROUP_RUNS", group_runs)  # a small one splits groups down to long suffixes
    monkeypatch.setattr(lm, "CONTEXT_SHARE", context_share)
    monkeypatch.setattr(lm, "SYMBOL_SHARE", context_share / 16)
    monkeypatch.setattr(lm, "WORD_SHARE", 5e-3)  # so that some words are joined
    rows = list(enumerate(texts(2))) + [(None, "the other"), (7, "twice twice"), (7, "twice twice"), (401, ""), (402, None),
                                        (403, "ONLY here \x00 \x1c é"), (404, "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, known string")
    corpus = [t or "" for i, t in rows if training(i)]
    words = Counter(w for t in corpus for w in normal(t).split(b" ") if w)
    words["end"] = len(corpus)
    n, v, p = sum(words.values()), len(words), tree(corpus)
    want = []
    for i, t in rows:
        tokens = [w for w in normal(t or "").split(b" ") if w] + ["end"]
        want.append((str(i), not training(i), len(tokens), sum(words[w] > 0 for w in tokens), n,
                     round(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens), 4), round(log10_of(p, t or ""), 4)))
    got = [(str(r.doc_id), *r[1:5], round(r.base_score, 4), round(r.score, 4)) for r in lm.score(docs).collect()]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6, abs=2e-4)


def test_every_context_has_probability_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = lm.train(docs, lm.count(docs))
    runs = np.unique(lm.runs_of([normal(r.text) for r in docs.limit(40).collect()])[0])
    rng = np.random.default_rng(1)
    for run in [*rng.choice(runs, 60), *rng.integers(0, 2 ** 48, 20).astype(U)]:
        after = (run & ~U(255)) | np.arange(256).astype(U)
        assert (10 ** lm.run_logs(model.levels, after)).sum() == pytest.approx(1, abs=1e-9)


def test_tree_beats_base_on_held_out_documents(spark):
    out = lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").selectExpr(
        "sum(score) / sum(n_tokens) AS tree", "sum(base_score) / sum(n_tokens) AS base").first()
    assert out.tree > out.base


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs).count() == 0
    held = next(i for i in range(100) if not training(i))
    row = lm.score(spark.createDataFrame([(held, "ab")], docs.schema)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (2, 0, 0, 0.0)
    assert row.score == pytest.approx(-3 * math.log10(256))


def test_contexts_are_kept_by_evidence_not_by_share(spark):
    """A rare run in a corpus of 8 million positions: 12 occurrences were less than the least share of a context."""
    rng = random.Random(3)
    common = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(1_800))
    texts_ = [common] * 1_000 + ["qzxjvk " * 3] * 4
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "doc_id long, text string").repartition(8)
    counts = lm.count(docs)
    assert counts.where(f"kind = {lm.RUN}").agg({"n": "sum"}).first()[0] > 8_000_000
    model = lm.train(docs, counts)
    assert ord("x") in model.levels[1].contexts
    run = np.array([int.from_bytes(b"qzxj", "big")], U)
    assert 10 ** lm.run_logs(model.levels, run)[0] > 0.9


def test_contexts_reach_past_five_bytes(spark):
    """The byte after five equal ones depends on the one before them."""
    docs = spark.createDataFrame([(i, ("abbbbbx" if i % 2 else "cbbbbby") + " ") for i in range(400)], "doc_id long, text string")
    model = lm.train(docs, lm.count(docs))
    runs = np.array([int.from_bytes(r, "big") for r in (b"abbbbbx", b"cbbbbby")], U)
    assert (10 ** lm.run_logs(model.levels, runs) > 0.9).all()
