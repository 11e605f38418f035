import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from formline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as _f:
    ENCODER = bpe.ChunkEncoder(_f.read())
ODD = ["", " ", "  \n ", "a" * 5000, "x́ é ́a", "<|startoftext|> x<|endoftext|>y", "A B C\x1cD\x85E",
       "it's they'll I'd", "ＡＢ 漢字テスト \U0001f642\U0001f642", "İstanbul ΑΣ ς",
       "123 45a6", "가 ᆨ", "t\x00 \x00", "\ta\tb\x0bc\x0cd", "word " * 20000]


def agree(texts):
    got = list(ENCODER.texts(texts))
    for text, (ids, names) in zip(texts, got):
        want = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert ids.decode() == " ".join(map(str, want))
        assert names.decode() == TOKENIZER.decode(want, skip_special_tokens=False)


def test_odd_texts():
    agree(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=600), max_size=4),
       st.text("ab ,.é\U0001f642\n'sS1<|>", min_size=300, max_size=1500))
def test_any_text_and_shared_passages(texts, passage):
    agree([*texts, passage, *(t + passage for t in texts), passage + passage])


def test_shared_passages_are_cut_alike():
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 123, 20_000, dtype=np.uint8).tobytes()
    a, b = bpe.chunks([b"x" * 37 + shared, b"something else" + shared])
    assert b"".join(a) == b"x" * 37 + shared and len(set(a) & set(b)) >= len(a) - 3


def test_rows(spark):
    rows = [(i, t, "c") for i, t in enumerate(ODD)] + [(None, None, None), (3, "twice", "c"), (3, "twice", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path, tk = PATH, TOKENIZER
    want = []
    for i, t, _ in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        text = tk.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(docs, path).collect()) == sorted(want)
    full = bpe.encode(docs, path, carry=["ids"]).collect()
    assert sorted((str(r.doc_id), len(r.ids)) for r in full) == sorted(w[:2] for w in want)
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_memo_keeps_what_is_asked_for_again():
    from formline.llm.units import Memo

    memo, made = Memo(entries=8), []

    def make(pieces):
        made.extend(pieces)
        return [p.upper() for p in pieces]

    for i in range(50):
        wanted = {"often", f"once{i}"}
        memo.fill(wanted, make)
        assert all(memo.young[w] == w.upper() for w in wanted)
        assert len(memo.young) + len(memo.old) <= 12
    assert made.count("often") == 1


def test_long_texts_without_spaces():
    for text in ("YWJj" * 100_000, "数据处理" * 20_000, "x" * 100_000 + " " + "y" * 50_000):
        (ids, _), = ENCODER.texts([text])
        assert [int(i) for i in ids.split()] == TOKENIZER.encode(text, add_special_tokens=False).ids
