import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from formline.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "a", " ", "  ", "a  b", " lead", "trail ", "x\n y", "x \ny", "tab\t here \t", "nbsp   x", " em space  ",
    "it's I'll <|endoftext|> and <|endoftext|>x", "naïve Straße ê ", "汉字 テスト", "9" * 5000, "word " * 3000, "\n\n\n", "a\x1c b \x1c", "🙂 🙂🙂",
    "The end.\nNew line, and   three spaces", "the the the", "the the the", "x" * 30000,
]


def brute(texts, capacity=2048):
    tk = Tokenizer.from_file(PATH)
    out = []
    for i, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        start, stop, k = 0, len(ids) % capacity or capacity, 0
        while start < len(ids):
            out.append((i, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start, stop, k = stop, stop + capacity, k + 1
    return out


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pieces_and_places(spark, capacity):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, rank string")
    out = packing.pack_documents(docs, PATH, capacity=capacity).collect()
    assert sorted(tuple(r)[:5] for r in out) == brute(TEXTS, capacity)
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= capacity


def test_empty_null_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, PATH).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    out = packing.pack_documents(docs, PATH).collect()
    assert len(out) == 3 and len({(r.sequence_id, r.offset) for r in out}) == 3


@pytest.mark.parametrize("counts, best", [
    ({60: 5, 40: 5}, 5), ({50: 7}, 4), ({70: 3, 20: 3, 10: 3}, 3), ({40: 2, 30: 2, 20: 2, 10: 2}, 2),
    ({100: 4, 1: 250}, 7), ({34: 10}, 5), ({99: 2, 2: 1}, 3), ({}, 0), ({1: 1}, 1),
])
def test_plan_places_every_piece(counts, best):
    patterns = packing.plan(counts, 100)
    placed = {}
    for pattern, n in patterns:
        assert n > 0 and sum(a * k for a, k in pattern) <= 100
        for length, k in pattern:
            placed[length] = placed.get(length, 0) + n * k
    assert placed == counts
    assert sum(n for _, n in patterns) == best


def test_plan_is_tight_on_many_lengths():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(6, 1, 20000).astype(int), 1, 2048)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    used = sum(n for _, n in packing.plan(counts))
    assert used <= 1.002 * -(-lengths.sum() // 2048)
