"""Toxicity by compression distance under two zstandard dictionaries.

Training takes a bounded sample of labelled rows (``MAX_TOXIC`` and ``MAX_ORDINARY``
documents of ``MAX_CHARS`` characters in all per label, by a hash of the id, whole texts) to the driver; labels of rows held out
are never read. Two thirds of it make the dictionaries:

* ordinary: the most frequent words of ordinary documents, most frequent last;
* toxic: the same, followed by what marks toxic documents: five-character pieces of
  words that occur in clearly more toxic than ordinary documents, joined where they
  overlap in a word.

A window is a word between its spaces (words over ``WINDOW`` characters give several,
overlapping). Its characters are spelled in codes of three bytes, so that zstandard
can match pieces of two characters and lengths resolve single phrases; case and signs
at the ends of a word are ignored. A window's distance is its compressed length under
the ordinary dictionary less that under the toxic one.

The last third of the sample calibrates: a logistic model of how many windows of a
document reach each distance threshold, and of the document's length, weighted to
the share of toxic rows among all training labels. Scoring reads every document once;
a worker remembers the distances of words.

Defined cases: a null or empty text has no windows and gets the model's score for none;
without labels of both kinds every score is the share of toxic rows (0 without rows);
labels other than 0 and 1 are ignored; repeated label rows count each in the share of toxic
rows, while an id and label is fitted on once, with the shortest of its texts if the id repeats;
a null id is not held out and has no label; repeated ids are kept as rows; an empty table
gives an empty result; columns that are not named are ignored unless carried.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import id_and_text, schema_of
from formline.llm.units import give_back, slices, worker_store

#: The sample of labelled rows that the classifier is fitted on.
MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 3000, 6000, 40_000_000
FOLDS, HELD_OUT = 5, 0
PIECE, CODE, LEVEL, WINDOW, STRIDE = 5, 3, 4, 64, 48
FREQUENT_WORDS, LEAST_DOCUMENTS, LEAST_RATIO, LEAST_SCORE = 4000, 4, 6.0, 5.0
MEMO_WORDS = 250_000
THRESHOLDS = (5, 6, 7, 8, 9, 10, 11)
RIDGE = 1.0
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_random = random.Random(7)
CODES = [bytes(_random.randrange(256) for _ in range(CODE)) for _ in range(256)]


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % FOLDS


def words_of(text: str) -> list[str]:
    return text.lower().split()


def spelled(text: str) -> bytes:
    return b"".join(map(CODES.__getitem__, text.encode("utf-8", "surrogatepass")))


def marked_pieces(word: str) -> list[str]:
    """The five-character pieces of a word, a space standing for its start."""
    word = " " + word
    return [word[i:i + PIECE] for i in range(max(1, len(word) - PIECE + 1))]


def toxic_stems(toxic: list[set[str]], ordinary: list[set[str]]) -> list[str]:
    """What marks toxic documents, the most telling last."""
    seen = [Counter(), Counter()]
    for counts, docs in zip(seen, (toxic, ordinary)):
        for words in docs:
            counts.update({p for w in words for p in marked_pieces(w)})
    n, m = len(toxic), len(ordinary)
    telling = set()
    for piece, a in seen[0].items():
        b = seen[1][piece]
        expected = n * (a + b) / (n + m)
        if (a >= LEAST_DOCUMENTS and (a + 0.5) / (n + 1) > LEAST_RATIO * (b + 0.5) / (m + 1)
                and a - expected > LEAST_SCORE * math.sqrt(expected) / 2):
            telling.add(piece)
    stems: Counter = Counter()
    for words in toxic:
        found = set()
        for word in words:
            run = ""
            for i, piece in enumerate(marked_pieces(word)):
                if piece in telling:
                    run = run + piece[-1] if run else piece
                elif run:
                    found.add(run)
                    run = ""
            if run:
                found.add(run)
        stems.update(found)
    kept = [s for s, k in stems.items() if k >= LEAST_DOCUMENTS // 2 + 1]
    return sorted(kept, key=lambda s: (stems[s], s))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    share: float
    name: str = ""

    def __post_init__(self):
        self.name = hashlib.sha256(self.ordinary + self.toxic).hexdigest()


class Meter:
    """Distances of words under a model's two dictionaries."""

    def __init__(self, model: Model):
        self.pair = [self._compressor(d) for d in (model.ordinary, model.toxic)]
        self.known: dict[str, int] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                                        write_dict_id=False)

    def distance(self, window: str) -> int:
        coded = spelled(f" {window} ")
        ordinary, toxic = (len(c.compress(coded)) for c in self.pair)
        return min(max(ordinary - toxic, 0), THRESHOLDS[-1])

    def of_word(self, word: str) -> int:
        word = word.strip(SIGNS)
        if len(word) <= WINDOW:
            return self.distance(word) if word else 0
        return max(self.distance(word[i:i + WINDOW]) for i in range(0, len(word) - WINDOW + STRIDE, STRIDE))

    def features(self, texts: list[str]) -> np.ndarray:
        """A row per text: log counts of windows per threshold, and of all windows."""
        out = np.zeros((len(texts), len(THRESHOLDS) + 1))
        for a, b in slices(texts):
            split = [words_of(t) for t in texts[a:b]]
            new = set().union(*split) - self.known.keys()
            if len(self.known) + len(new) > MEMO_WORDS:
                self.known.clear()
                new = set().union(*split)
            self.known.update((w, self.of_word(w)) for w in new)
            get = self.known.__getitem__
            for i, words in enumerate(split, a):
                counts = np.bincount(np.fromiter(map(get, words), np.int64, len(words)), minlength=THRESHOLDS[-1] + 1)
                reached = counts[::-1].cumsum()[::-1]
                out[i, :-1] = reached[list(THRESHOLDS)]
                out[i, -1] = len(words)
            for w in [w for w in new if len(w) > WINDOW]:
                del self.known[w]
        return np.log1p(out)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights, the constant last, of the ridge-penalised logistic model, by Newton steps with halving."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6

    def loss(w):
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * w * w).sum())

    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-8:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            return w
    raise RuntimeError("the logistic model did not converge")


def fit(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """A model from texts of both labels; ``share`` is that of toxic rows among all labels."""
    if not toxic or not ordinary:
        return Model(b"", b"", (), share)
    cut = [max(1, len(texts) * 2 // 3) for texts in (toxic, ordinary)]
    pool: dict[str, str] = {}  # one object per word, however many texts have it

    def once(text: str) -> set[str]:
        return {pool.setdefault(w, w) for w in (w.strip(SIGNS) for w in words_of(text))}

    clean = [[once(t) for t in texts[:k]] for texts, k in zip((toxic, ordinary), cut)]
    counts = Counter(w for words in clean[1] for w in words if w)
    frequent = sorted(counts, key=lambda w: (-counts[w], w))[:FREQUENT_WORDS]
    base = spelled(" ".join(reversed(frequent)) + " ")
    model = Model(base, base + spelled("".join(toxic_stems(*clean)) + " "), (), share)
    rest = [texts[k:] or texts for texts, k in zip((toxic, ordinary), cut)]
    meter = Meter(model)
    x = np.vstack([meter.features(texts) for texts in rest])
    y = np.repeat([1.0, 0.0], [len(r) for r in rest])
    each = np.repeat([share / len(rest[0]), (1 - share) / len(rest[1])], [len(r) for r in rest]) * len(y)
    model.weights = tuple(logistic(x, y, each))
    return model


def scores(model: Model, meter: Meter | None, texts: list[str]) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.share)
    w = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(meter.features(texts) @ w[:-1] + w[-1], -500, 500)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_chars: int = MAX_CHARS) -> Model:
    """The model of the labelled rows that are not held out."""
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isin(0, 1) & (fold() != HELD_OUT))
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return Model(b"", b"", (), 0.0)
    order = F.xxhash64("doc_id")
    picked = None
    for label, bound in ((1, max_toxic), (0, max_ordinary)):
        # The hash admits somewhat more than the bound, the sort by it then cuts at the bound.
        admitted = min(1.0, 1.3 * bound / max(1, n.get(label, 0)) + 1e-3)
        some = marks.where((F.col("toxic") == label) & (F.pmod(order, F.lit(1_000_000)) < int(1_000_000 * admitted)))
        some = some.orderBy(F.pmod(order, F.lit(1_000_000)), "doc_id").limit(bound)
        picked = some if picked is None else picked.union(some)
    texts = id_and_text(docs, id_col, text_col)
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("at")
    # At most max_toxic + max_ordinary rows of four numbers, as each id and label counts once, with its shortest text.
    # Lengths first: long documents must not fill the driver.
    known = [F.length("text").alias("n"), F.xxhash64("text").alias("h")]
    sizes = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(*known)).alias("s"))
    sizes = sizes.select("toxic", at, "doc_id", "s.n", "s.h").collect()
    held, chosen = {0: 0, 1: 0}, set()
    for r in sorted(sizes, key=lambda r: (r["at"], r["doc_id"], r["n"])):
        if held[r["toxic"]] + r["n"] <= max_chars or not held[r["toxic"]]:
            held[r["toxic"]] += r["n"]
            chosen.add((r["doc_id"], r["toxic"], r["n"], r["h"]))
    if not chosen:
        return Model(b"", b"", (), n.get(1, 0) / sum(n.values()))
    chosen = docs.sparkSession.createDataFrame(sorted(chosen), "doc_id long, toxic int, n int, h long")
    rows = texts.withColumns({"n": known[0], "h": known[1]}).join(F.broadcast(chosen), ["doc_id", "n", "h"])
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select(at, "doc_id", "text", "toxic").toArrow()
    rows = sorted(zip(*(column.to_pylist() for column in rows.columns)))
    by_label = {k: [text for _, _, text, toxic in rows if toxic == k] for k in (0, 1)}
    model = fit(by_label[1], by_label[0], n.get(1, 0) / sum(n.values()))
    del rows, by_label
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry=(),
          keep_text: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` (and ``text``, ``carried``), a row per row of ``docs``."""
    docs = id_and_text(docs, id_col, text_col, carry).withColumn("held_out", F.coalesce(fold() == HELD_OUT, F.lit(False)))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["doc_id", "held_out"] + ["text"] * keep_text
    schema = schema_of("doc_id long, held_out boolean, " + "text string, " * keep_text + "score double, predicted int", docs)

    def run(batches):
        held, model = worker_store("toxicity_meters"), sent.value
        for batch in batches:
            meter = held.get(model.name)
            if meter is None and model.weights:
                held.clear()
                meter = held[model.name] = Meter(model)
            found = scores(model, meter, batch.column("text").to_pylist())
            arrays = [batch.column(c) for c in columns] + [pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))]
            if "carried" in batch.schema.names:
                arrays.append(batch.column("carried"))
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return docs.mapInArrow(run, schema)
