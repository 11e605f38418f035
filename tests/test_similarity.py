"""The prefix-filtered similarity join against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from formline.operators import similarity as S


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


SCORES = {"edits": lambda n, t: 1 - edits(n, t) / max(len(n), len(t)),
          "blocks": lambda n, t: difflib.SequenceMatcher(None, t, n).ratio()}


def words(rng, n, alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZ ÁÑé", low=1, high=18):
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n)})


def spoiled(rng, text):
    text = list(text)
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(text) + 1)
        text[at:at + rng.randint(0, 1)] = rng.choice("ABZ ")
    return "".join(text) or "A"


@pytest.mark.parametrize("measure", ["edits", "blocks"])
def test_best_targets_are_those_of_all_pairs(spark, measure):
    rng = random.Random(5)
    targets = words(rng, 120)
    names = sorted({spoiled(rng, rng.choice(targets)) for _ in range(60)} | set(words(rng, 25)) | {"A" * 300, "zq"})
    got = {}
    for r in S.nearest_targets(spark.createDataFrame([(n,) for n in names], "name string"),
                               spark.createDataFrame([(t,) for t in targets], "target string"), measure=measure).collect():
        got.setdefault(r["name"], {})[r["rank"]] = (round(r["score"], 12), r["target"])
    for name in names:
        scored = sorted(((round(SCORES[measure](name, t), 12), t) for t in targets), reverse=True)
        want = [s for s in scored if s[0] >= 0.4][:3]
        assert [got.get(name, {}).get(i + 1) for i in range(len(got.get(name, {})))] == want, name


def test_candidates_hold_all_pairs_of_the_ratio_and_few_others(spark):
    rng = random.Random(8)
    targets = words(rng, 3000, low=6)
    names = [spoiled(rng, rng.choice(targets)) for _ in range(80)]
    left = spark.createDataFrame(list(enumerate(names)), "id long, text string")
    right = spark.createDataFrame(list(enumerate(targets)), "id long, text string")
    tokens = [S.token_rows(left), S.token_rows(right)]
    frequency = tokens[0].select("token").unionByName(tokens[1].select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    rows = [S.rarest_first(t, frequency) for t in tokens]
    found = {(r["id"], r["other"]) for r in S.candidates(*rows, 0.75).collect()}
    for i, name in enumerate(names):
        for j, target in enumerate(targets):
            if difflib.SequenceMatcher(None, name, target).quick_ratio() >= 0.75:
                assert (i, j) in found
    assert len(found) < len(names) * len(targets) / 20


def test_tokens_number_repeated_characters(spark):
    rows = S.token_rows(spark.createDataFrame([(1, "ABAñ😀"), (2, "")], "id long, text string")).collect()
    assert {(r["id"], r["size"], r["token"]) for r in rows} == {(1, 5, f"{c}\x00{i}") for c, i in (("A", 1), ("A", 2), ("B", 1), ("ñ", 1), ("😀", 1))}


def test_empty_sides(spark):
    some, none = spark.createDataFrame([("A",)], "name string"), spark.createDataFrame([], "target string")
    assert S.nearest_targets(some, none).count() == 0
    assert S.nearest_targets(spark.createDataFrame([], "name string"), spark.createDataFrame([("A",)], "target string")).count() == 0
