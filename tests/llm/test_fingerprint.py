import hashlib

import pytest
from pyspark.sql import functions as F

from formline.llm import fingerprint as fp
from formline.llm.common import id_and_text


def lanes_of(text):
    """The same sums in plain Python."""
    import re

    lanes = [0] * 137
    for p in text.split("\n"):
        sha = hashlib.sha256(p.encode()).hexdigest()
        for i in range(8):
            lanes[i] += int(sha[8 * i:8 * i + 8], 16)
        for run in re.findall(fp.RUN, p):
            lanes[8] += 1
            md5 = hashlib.md5(run.encode()).hexdigest()
            for j in range(4):
                word = int(md5[8 * j:8 * j + 8], 16)
                for i in range(32):
                    lanes[9 + 32 * j + i] += word >> i & 1
    return [x % 2 ** 32 for x in lanes]


def lanes(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string")
    return {r.k: r.lanes for r in fp.fingerprints(df, "text", ["k"]).collect()}


def test_sums_order_insert_and_delete(spark):
    a, b, c = "one two three four five six", "seven  eight\tnine", "zehn ölf 🙂"
    texts = ["", a, b, "\n".join([a, b, c]), "\n".join([c, a, b]), "\n".join([a, c]), c, "\n\n", a + "\n" + a]
    got = lanes(spark, texts)
    assert all(got[i] == lanes_of(t) for i, t in enumerate(texts))
    assert got[3] == got[4] and len({tuple(got[i]) for i in (0, 1, 2, 3, 5, 6, 7, 8)}) == 8
    df = spark.createDataFrame([(got[3], got[5], got[2])], "abc array<long>, ac array<long>, b array<long>")
    row = df.select(fp.insert(F.col("ac"), F.col("b")).alias("i"), fp.delete(F.col("abc"), F.col("b")).alias("d")).first()
    assert row.i == got[3] and row.d == got[5]


def test_neighbours_and_edited_texts(spark):
    rows = [(10 ** 18, "last one"), (None, "x" * 7), (5, "abcde"), (6, None), (9, "🙂🙂🙂🙂"), (-3, "minus"), (9000, "w " * 3000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, next_id string")
    got = {r.doc_id: r for r in fp.compare_edited(docs).collect()}
    order = sorted(rows, key=lambda r: fp.NULL_ID if r[0] is None else r[0])
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == "".join(f"{x:08x}" for x in lanes_of(t))
        assert got[i].edited_fingerprint == "".join(f"{x:08x}" for x in lanes_of(edited))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    linked = {r.id: r.next_id for r in fp.neighbours(id_and_text(docs).withColumn("id", F.coalesce("doc_id", F.lit(fp.NULL_ID)))).collect()}
    ids = [fp.NULL_ID if i is None else i for i, _ in order]
    assert linked == dict(zip(ids, ids[1:] + ids[:1]))


@pytest.mark.parametrize("rows, n", [([], 0), ([(1, "a b")], 1), ([(1, "a b"), (1, "a b"), (1, "c d"), (2, "e f")], 4)])
def test_empty_single_and_repeated(spark, rows, n):
    out = fp.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == n
    if n == 1:
        assert out[0].near_next == 1.0 and out[0].edited_sha256 == hashlib.sha256(b"a a").hexdigest()
    same = [r for r in out if r.doc_id == 1 and r.edited_sha256 == hashlib.sha256(b"a e ").hexdigest()[:64]]
    assert len({r.fingerprint for r in same}) <= 1


def test_likeness_follows_shared_runs(spark, sf_dir):
    out = fp.compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 1500")).agg(
        F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"),
        F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("w")).first()
    assert 0.35 < out.e < 0.65 and out.n < 0.1 and out.w > 0.97


def test_packed_lanes(spark):
    small = lanes_of("a b c d e f\ng")
    large = [2 ** 32 - 1] * 8 + [70_000] + [65_536] * 128
    edge = [2 ** 32 - 1, 0, 2 ** 31] + [5] * 5 + [65_535] * 129
    df = spark.createDataFrame([(small,), (large,), (edge,)], "v array<long>").withColumn("p", fp.packed("v"))
    rows = df.select("v", F.size("p").alias("n"), fp.unpacked("p").alias("u")).collect()
    assert all(r.v == r.u for r in rows) and sorted(r.n for r in rows) == [37, 37, 137]
