"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts a text into chunks wherever its top bits are zero,
so a passage that several documents share is cut alike in each of them, whatever
stands before it. What lies between the first and the last space of a chunk is
encoded once and remembered; a worker keeps a bounded number of chunks across
documents and tasks.

The join of two chunks is repaired by encoding again what lies between the last space
before it and the first space after it; a chunk without a space is taken up whole,
and the repair goes on until it stands at a space on both sides. There the repaired
ids agree exactly with those of the whole text: the tokenizer turns white space into
one space, composes no character over a space, and splits words at it before any
merge. Special tokens hold no space and are found by the tokenizer itself.

The words of new chunks and joins are encoded by ``tokenizers`` in batches, distinct
ones only. ``word_bpe_49k.json`` names no decoder, so ids decode to its token
strings joined by spaces; other files are decoded by ``tokenizers`` itself.

Defined cases: a null or empty text has no ids and decodes to the empty text; null
and repeated ids are kept as rows; texts of any length are encoded whole; an empty
table gives an empty result; columns that are not named are ignored unless carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from formline.llm.common import id_and_text, schema_of
from formline.llm.units import Memo, one_thread, slices, worker_store

WINDOW, CHUNK_BITS = 16, 8
CHUNKS_KEPT, CHUNK_BYTES_KEPT = 40_000, 2048
GEAR = np.random.default_rng(20).integers(0, 2 ** 32, 256, dtype=np.uint64).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the hash of the 16 bytes that end there (fewer at the start)."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        moved = np.zeros_like(h)
        moved[width:] = h[:-width] << np.uint32(width) if len(h) > width else 0
        h, width = h + moved, 2 * width
    return h


def chunks(texts: list[bytes]) -> list[list[bytes]]:
    """The content-defined chunks of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    cut = (rolling(data) >> np.uint32(32 - CHUNK_BITS)) == 0
    ends = np.cumsum([len(t) for t in texts])
    at = np.flatnonzero(cut) + 1
    which = np.searchsorted(ends, at, side="left")
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    # A window that reaches into the text before says nothing about this one.
    own = (at - starts[np.minimum(which, len(starts) - 1)] >= WINDOW) & (at < ends[np.minimum(which, len(ends) - 1)])
    at, which = (at[own], which[own])
    first = np.searchsorted(which, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        edges = [0, *(at[first[i]:first[i + 1]] - starts[i]).tolist(), len(text)]
        out.append([text[a:b] for a, b in zip(edges, edges[1:]) if b > a])
    return out


class ChunkEncoder:
    """Ids as decimal numbers and decoded token strings, both joined by spaces."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        one_thread()
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.by_strings = self.whole.decoder is None
        self.tokens = {i: (b"%d" % i, t.encode()) for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.words, self.known, self.known_before = Memo(), {}, {}

    def _encode(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        out, token = [], self.tokens.__getitem__
        for e in self.whole.encode_batch_fast([w.decode() for w in words], add_special_tokens=False):
            ids = e.ids
            if len(ids) == 1:
                out.append(token(ids[0]))
            else:
                pairs = [token(i) for i in ids]
                out.append((b" ".join([p[0] for p in pairs]), b" ".join([p[1] for p in pairs])))
        return out

    def texts(self, texts: list[str]):
        """``(ids, decoded)`` of each text, as bytes."""
        for a, b in slices(texts):
            yield from self._slice([t.encode("utf-8").replace(b"\n", b" ") for t in texts[a:b]])

    def _slice(self, texts: list[bytes]):
        if len(self.known) >= CHUNKS_KEPT // 2:
            self.known_before, self.known = self.known, {}
        known, before, fresh, words, plans = self.known, self.known_before, {}, {b""}, []
        for parts in chunks(texts):
            plan, pending = [], []
            for chunk in parts:
                entry = known.get(chunk) or fresh.get(chunk)
                if entry is None and (entry := before.pop(chunk, None)) is not None:
                    known[chunk] = entry
                if entry is None:
                    i, j = chunk.find(b" "), chunk.rfind(b" ")
                    inner = chunk[i + 1:j].split(b" ") if 0 <= i < j else []
                    words.update(inner)
                    entry = fresh[chunk] = [chunk[:i] if i >= 0 else None, inner, chunk[j + 1:]]
                if entry[0] is None:  # no space: the repair goes on
                    pending.append(chunk)
                    continue
                pending.append(entry[0])
                joined = b"".join(pending)
                words.add(joined)
                plan += (joined, entry)
                pending = [entry[2]]
            joined = b"".join(pending)
            words.add(joined)
            plan.append(joined)
            plans.append(plan)
        made = self.words.fill(words, self._encode)
        pair = self.words.young.__getitem__
        for entry in fresh.values():
            pairs = [pair(w) for w in entry[1] if w]
            entry[1] = (b" ".join([p[0] for p in pairs if p[0]]), b" ".join([p[1] for p in pairs if p[1]]))
        for plan in plans:
            pairs = [pair(part) if part.__class__ is bytes else part[1] for part in plan]
            yield b" ".join([p[0] for p in pairs if p[0]]), b" ".join([p[1] for p in pairs if p[1]])
        known.update((c, e) for c, e in fresh.items() if len(c) <= CHUNK_BYTES_KEPT)
        self.words.forget_long(made)

    def decode(self, ids: bytes, strings: bytes) -> bytes:
        if self.by_strings:
            return strings
        return self.whole.decode([int(i) for i in ids.split()], skip_special_tokens=False).encode()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry=()) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` (and ``carried``), a row per row of ``docs``."""
    return _encoded(docs, path, id_col, text_col, carry, "doc_id long, ids array<int>, decoded string",
                    lambda ids, text: (np.array(ids.split(), dtype=np.int32), text.decode()))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry=()) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``carried``), a row per row of ``docs``."""
    return _encoded(docs, path, id_col, text_col, carry,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                    lambda ids, text: (ids.count(b" ") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, carry, ddl: str, row) -> DataFrame:
    docs = id_and_text(docs, id_col, text_col, carry)
    with open(path, encoding="utf-8") as f:  # the driver's own installed file, not a table
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = schema_of(ddl, docs)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        held = worker_store("chunk_encoders")
        encoder = held.get(path) or held.setdefault(path, ChunkEncoder(spec.value))
        types = [to_arrow_type(f.dataType) for f in schema.fields[1:] if f.name != "carried"]
        for batch in batches:
            rows = [row(ids, encoder.decode(ids, text)) for ids, text in encoder.texts(batch.column("text").to_pylist())]
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types))]
            if "carried" in batch.schema.names:
                arrays.append(batch.column("carried"))
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return docs.mapInArrow(run, schema)
