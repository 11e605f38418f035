import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from formline.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = []

    def below(node):
        leaves, saved = 0, (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for child in children[node]:
            a, b = below(child)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(rebuilt[c]) == len(node)))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]),
                    leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if rebuilt:
        below(())
    return sorted(out, key=repr)


def got(spark, rows):
    return sorted(map(tuple, trie.nodes(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def random_rows(n, seed, depth=7, words=3):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "é" * 3, "x", "yy", None][:words]))
            for c in rng.sample(range(-40, 4 * n), n) for t in range(rng.randrange(depth))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = random_rows(400, seed)
    assert got(spark, rows) == brute(rows)


def test_one_path_of_most_conversations_is_split_between_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 64)
    rows = [(c, t, "u", f"turn {t}") for c in range(0, 4000, 1) for t in range(3)] + random_rows(60, 3)
    rows = [r for r in rows if r[0] is not None]
    paths = trie.rebuilt_paths(spark.createDataFrame(rows, SCHEMA)).cache()
    borders = trie.splitters(paths, paths.count(), 1 << 20, 16 * 7)
    assert len(borders) >= 5 and len({p for p, _ in borders}) < len(borders)
    assert got(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_absent_bases(spark):
    rows = [(10, None, "user", "first"), (10, 0, None, None), (10, 0, None, None), (11, 5, "b", "tie"), (11, 5, "a", "tie"), (11, 5, "a", "later"),
            (-3, 1, "u", "negative"), (-5, 1, "u", "base of it"), (23, 1, "u", "no base"), (None, 1, "u", "no id"), (14, 0, "u", "x" * 200_000)]
    assert got(spark, rows) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    # Without a base, conversations lose their first turns; those with none left end at the root.
    rows = [(c, 0, "u", "only") for c in range(1, 200) if c % 5]
    want = brute(rows)
    assert got(spark, rows) == want
    assert want and max(r[3] for r in want) == len(rows)


def test_long_conversations_and_small_skeletons(spark, monkeypatch):
    monkeypatch.setattr(trie, "SKELETON_BYTES", 40_000)
    rows = [(c, t, "u", str(min(c, 3))) for c in (0, 5, 10, 15) for t in range(500)] + random_rows(80, 9)
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_other_columns(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(0, 0, "u", "a", 9, "p", 3)], SCHEMA + ", depth int, path string, base long")
    assert sorted(map(tuple, trie.nodes(df).collect()), key=repr) == brute([(0, 0, "u", "a")])
