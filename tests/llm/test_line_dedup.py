import random
from collections import defaultdict

import pytest

from formline.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows, min_chars=20, min_docs=3):
    rows = [(i, t or "") for i, t in rows]
    order = lambda i: line_dedup.NULL_ID if i is None else i
    held = defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            held[key(line)].add(order(i))
    out = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == order(i)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(spark, rows, **settings):
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, key string")
    out = line_dedup.dedup_lines(docs, carry=["key"], **settings).collect()
    assert all(r.carried.key == "c" for r in out)
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    lines = [f"a line that many documents may hold, number {k} é" for k in range(30)]
    lines += ["short", "", "exactly nineteen ch", "exactly twenty chars", "ääääääääääääääääääää", "ÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄ"]
    rows = []
    for i in range(n):
        own = [rng.choice([" ", "\t", ""]) + rng.choice([str.upper, str])(rng.choice(lines)) + rng.choice(["", " \r", "\x0b"])
               for _ in range(rng.randrange(6))]
        own += [f"own line {rng.random()} of this document alone"] * rng.randrange(3) + ["The hot line of a third of all documents"] * (i % 3 == 0)
        rng.shuffle(own)
        rows.append((i * 7, "\n".join(own)))
    return rows


# A filter of 2^16 bits is full of false suspects; the results stay the same.
@pytest.mark.parametrize("seed, max_bits", [(1, line_dedup.MAX_BITS), (2, 1 << 16)])
def test_against_plain_program(spark, monkeypatch, seed, max_bits):
    monkeypatch.setattr(line_dedup, "MIN_BITS", min(max_bits, line_dedup.MIN_BITS))
    rows = corpus(seed)
    assert run(spark, rows, max_bits=max_bits) == brute(rows)


def test_nulls_repeats_long_texts_and_empty_table(spark):
    line = "one line of more than twenty characters"
    rows = [(None, line), (None, line + "\n" + line), (1, None), (2, ""), (3, line + "\n\n" + line), (3, line), (4, "x\n" + line),
            (5, "\n".join(f"line {k} of a very long document" for k in range(40_000))), (6, "ſtraße " * 5), (-5, "\n")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, min_docs=2, min_chars=1) == brute(rows, 1, 2)
    assert run(spark, []) == []


def test_long_enough_counts_code_points():
    for text in ("a" * 19, "a" * 20, "é" * 19, "é" * 20, "🙂" * 19, "🙂" * 20, "🙂" * 5 + "a" * 14, ""):
        assert line_dedup.long_enough(text.encode(), 20) == (len(text) >= 20)
