"""Each stage against a plain program over its own input."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from formline.llm import minhash, packing, secrets

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents, then every stage's output, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    frames = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{folder}/{k}")
        frames.append(spark.read.parquet(f"{folder}/{k}"))
    return frames


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "secrets", "packing"]
    for frame in stages[:-1]:
        assert frame.columns == COLUMNS
        assert frame.where(F.col("n_chars") != F.length("text")).count() == 0
    assert all(frame.count() for frame in stages)


def test_toxic_documents_go_and_the_rest_stay_as_they_are(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(before[i] == r for i, r in after.items())
    gone = set(before) - set(after)
    assert 0 < len(gone) < 0.2 * len(before)
    assert sum(toxic.get(i) == 0 for i in gone) <= 0.02 * sum(v == 0 for v in toxic.values())


def test_repeated_lines(stages):
    before, after = rows(stages[1]), rows(stages[2])
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, r in before.items():
        for line in r.text.split("\n"):
            held[key(line)].add(i)
    for i, r in before.items():
        kept = [x for x in r.text.split("\n") if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i]
        assert after[i].text == "\n".join(kept) and after[i].lang == r.lang


def test_one_document_of_each_class(stages):
    before, after = rows(stages[2]), rows(stages[3])
    sets, root = {}, {i: i for i in before}
    for i, r in before.items():
        words, seen, sets[i] = minhash.normal(r.text).split(), Counter(), set()
        for k in range(max(1, len(words) - 4) if words else 0):
            run = tuple(words[k:k + 5])
            sets[i].add((run, seen[run]))
            seen[run] += 1

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    by_run = defaultdict(list)
    for i, s in sets.items():
        for run in s or {()}:
            by_run[run].append(i)
    compared = set()
    for group in by_run.values():
        for k, i in enumerate(group):
            for j in group[:k]:
                if (i, j) not in compared:
                    compared.add((i, j))
                    c = len(sets[i] & sets[j])
                    if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c):
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
    assert set(after) == {find(i) for i in before}
    assert all(after[i] == before[i] for i in after)


def test_secrets_are_replaced(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    found = {r.doc_id: r.spans for r in secrets.find_secrets(stages[3]).collect()}
    assert any(found.values())
    for i, r in before.items():
        text, at, out = r.text, 0, ""
        for s in found[i]:
            if s.start >= at:
                out += text[at:s.start] + "[SECRET]"
            at = max(at, s["end"])
        assert after[i].text == out + text[at:]


def test_all_text_is_packed(stages):
    pieces, ends = stages[5].collect(), {}
    assert {r.doc_id for r in pieces} == set(rows(stages[4]))
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.CAPACITY
    assert len(ends) <= 1.02 * -(-sum(r.length for r in pieces) // packing.CAPACITY) + 1


def test_run_is_the_stages_in_turn(spark, stages):
    assert corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").exceptAll(
        stages[5].select("doc_id", "piece", "length", "ids_crc32")).count() == 0


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_one_per_class_of_repeated_rows(spark):
    data = [(1, "a b c"), (1, "a  b c"), (1, "other"), (None, None), (None, ""), (3, "x y z"), (2, "x y z")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    out = minhash.one_per_class(docs, carry=["text"]).collect()
    assert sorted((str(r.doc_id), r.class_size) for r in out) == [("1", 1), ("1", 2), ("2", 2), ("None", 2)]
