import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from formline.llm import secrets

BASE = [
    (re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    base = sorted((m.start(), k, m.end()) for k, (p, keep) in enumerate(BASE) for m in p.finditer(text) if keep(m))
    more = []
    for m in re.finditer(secrets.CANDIDATE, text):
        word = m[0]
        if any(re.search(p, word) for p in secrets.ALLOWED) or any(s <= m.start() and e >= m.end() for s, _, e in base):
            continue
        kind = next(c for c, p in secrets.CLASSES.items() if re.search(p, word))
        best = max(-sum(n / 20 * math.log2(n / 20) for n in Counter(word[i:i + 20]).values()) for i in range(len(word) - 19))
        if best >= secrets.THRESHOLDS[kind] - 1e-5:
            more.append((m.start(), 3, m.end()))
    return base, sorted(base + more)


def spell(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def random_text(rng):
    pieces = ["password: ", "Token='", "api_key=", "APIKEY = ", "AKIA", "AKIAIOSFODNN7", "token=token=", "secret: token: ", "é🙂", "\n", " ",
              "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "0123456789abcdef", "deadbeef" * 4, "aB3" * 9, "a1b2c3d4e5f6g7h8i9j0k1",
              "zX9kQ2mW7pL4vB8nT3rY6", "123e4567-e89b-12d3-a456-426614174000", "path/to/some/file2/with/parts", "the", "=", "\"", "x" * 30]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    for r in secrets.digest(docs).collect():
        base, spans = brute(texts[r.doc_id] or "")
        counts = Counter(k for _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(counts[k] for k in range(3)), texts[r.doc_id]
        assert r.spans == spell(spans), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(spell(base).encode()).hexdigest()


def test_against_brute_force(spark):
    rng = random.Random(8)
    check(spark, ["", None, "token=" + "a" * 100_000, "AKIA" * 6, "x" + "0f" * 5000 + "y", *(random_text(rng) for _ in range(600))])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("tokenTOKEN =:'\"aA1zZ9+/_-f0é", max_size=200), min_size=20, max_size=40))
def test_any_text(spark, texts):
    check(spark, texts)


def test_redaction_rows_and_empty_table(spark):
    rows = [(1, "a token=abcdef b", 1), (1, "a token=abcdef b", 1), (None, None, 2), (2, "🙂 secret: " + "0a" * 20 + " é", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = secrets.find_secrets(docs, carry=["spans"]).select("doc_id", secrets.redacted().alias("t"), "carried.spans").collect()
    assert sorted(map(tuple, out), key=str) == sorted(
        [(1, "a [SECRET] b", 1), (1, "a [SECRET] b", 1), (None, "", 2), (2, "🙂 [SECRET] é", 3)], key=str)
    assert secrets.digest(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = secrets.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_long_texts_of_every_allowed_shape(spark):
    shapes = ["a1/", "ab_", "/x9=", "0_1", "x", "A", "9", "=", "abcdef12/"]
    check(spark, [shape * (1_000_000 // len(shape)) for shape in shapes] + ["a1/" * 4000 + "7", "a1/" * 4000 + "7a"])


def test_long_candidates_take_time_in_proportion(spark):
    rng = random.Random(3)
    check(spark, ["".join(rng.choice(secrets.ALPHABET) for _ in range(150_000)), "abc-12-" * 20_000])


def test_patterns_for_java_say_the_same():
    rng = random.Random(4)
    for pattern, other in secrets.WITHOUT_REPEATED_GROUPS.items():
        for _ in range(20_000):
            word = "".join(rng.choice("ab01/_-") for _ in range(rng.randrange(12)))
            assert bool(re.search(pattern, word)) == bool(re.search(other, word)), word
