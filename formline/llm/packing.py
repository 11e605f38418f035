"""Best-fit packing of token sequences by exact complements.

Documents are encoded once into pieces of at most ``capacity`` tokens (a longer
document is cut into full pieces, its first piece takes the rest). The plan only
needs how many pieces there are of each length, at most ``capacity`` numbers, so
it is made on the driver whatever the size of the corpus:

1. from the longest length down, the gap it leaves is filled exactly by one
   length, a pair or a triple found by their sum, as many times at once as the
   counts allow;
2. what remains is placed best-fit, longest first, again by counts.

The plan is a list of rank ranges per length. Every piece gets its rank among the
pieces of its length (within a salted slice, plus the sizes of the slices before
it, so one hot length is spread over many tasks) and finds its place in the plan
by binary search.

Defined cases: a null or empty text is the end token alone; a null or repeated
document id is kept as it is; an empty table gives an empty result; columns that
are not named are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import id_and_text
from formline.llm.units import Memo, merged, odd, one_thread, slices, text_slices, worker_store
from formline.session import materialize

CAPACITY, END = 2048, 0
#: Pieces of one slice when ranks are counted.
SLICE_ROWS = 50_000


def byte_symbols() -> dict[str, int]:
    """The byte that each printable symbol of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(text: str) -> bool:
    """ASCII without a special token."""
    return text.isascii() and "<|" not in text


class ByteEncoder:
    """Ids of a byte-level BPE file as ``tokenizers`` gives them, as little-endian bytes.

    Texts of plain ASCII go through ``tiktoken`` whole, with the ranks of the same file, which is
    faster than looking up their words. Other texts are cut into pieces, whose ids are remembered;
    pieces that may hold a special token or other characters go through ``tokenizers``.
    """

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        one_thread()
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_padding()
        self.whole.no_truncation()
        known = json.loads(spec)
        special = {t["content"] for t in known["added_tokens"]}
        of = byte_symbols()
        ranks = {bytes(of[c] for c in token): i for token, i in known["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.after = Memo(), Memo()

    def _encode(self, pieces: list[str], before: str, without=lambda piece: False) -> list[bytes | None]:
        out, slow = [None] * len(pieces), []
        for i, piece in enumerate(pieces):
            if without(piece):
                continue
            if plain(piece):
                out[i] = array("I", self.fast.encode_ordinary(before + piece)).tobytes()
            else:
                slow.append(i)
        if slow:
            for i, e in zip(slow, self.whole.encode_batch_fast([before + pieces[i] for i in slow], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out

    def ids(self, texts: list[str]):
        """The ids of each text, four bytes each."""
        for a, b in slices(texts):
            split = [None if plain(t) else t.split(" ") for t in texts[a:b]]
            first, after = {p[0] for p in split if p}, set()
            for p in filter(None, split):
                after.update(p[1:])
            made = [(self.first, self.first.fill(first, lambda x: self._encode(x, "", odd))),
                    (self.after, self.after.fill(after, lambda x: self._encode(x, " ", odd)))]
            start, get = self.first.young, self.after.young.__getitem__
            for text, p in zip(texts[a:b], split):
                if p is None:
                    yield array("I", self.fast.encode_ordinary(text)).tobytes()
                    continue
                try:
                    yield start[p[0]] + b"".join(map(get, p[1:]))
                except TypeError:  # an odd piece has no ids of its own
                    p = merged(p)
                    yield b"".join(self._encode(p[:1], "") + self._encode(p[1:], " "))
            for memo, new in made:
                memo.forget_long(new)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:  # the driver's own installed file, not a table
        spec = spark.sparkContext.broadcast(f.read())

    def cut(batches):
        held = worker_store("byte_encoders")
        for batch in batches:
            encoder = held.get(path) or held.setdefault(path, ByteEncoder(spec.value))
            rows: list[list[int]] = [[], [], [], [], []]
            encoded = (ids for _, _, texts in text_slices(batch.column(1)) for ids in encoder.ids(texts))
            for i, ids in enumerate(encoded):
                ids += end.to_bytes(4, "little")
                total, view, start = len(ids) // 4, memoryview(ids), 0
                stop, piece = total % capacity or capacity, 0
                while start < total:
                    for to, value in zip(rows, (i, piece, start, stop - start, zlib.crc32(view[4 * start:4 * stop]))):
                        to.append(value)
                    start, stop, piece = stop, stop + capacity, piece + 1
            ids = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``([(length, times), ...], sequences)`` that place all counted lengths."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[list[tuple[int, int]], int]] = []

    def take(lengths: list[int]) -> bool:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        n = min(int(left[x]) // k for x, k in need.items())
        if n > 0:
            for x, k in need.items():
                left[x] -= n * k
            patterns.append((sorted(need.items(), reverse=True), n))
        return n > 0

    def pair(total: int, most: int) -> list[tuple[int, int]]:
        """Available ``(a, b)``, ``a >= b``, of that sum, nearest to equal last."""
        a = np.arange(min(total - 1, most), (total + 1) // 2 - 1, -1)
        if not len(a):
            return []
        ok = (left[a] > 0) & (left[total - a] > 0)
        return [(int(x), total - int(x)) for x in a[ok]]

    for long in range(capacity, 0, -1):
        if not left[long]:
            continue
        gap = capacity - long
        if not gap:
            take([long])
            continue
        if gap <= long:
            take([long, gap])
        for a, b in pair(gap, long) if left[long] else ():
            take([long, a, b])
            if not left[long]:
                break
        for a in range(min(gap - 2, long), (gap + 2) // 3 - 1, -1) if left[long] else ():
            if left[a]:
                for b, c in pair(gap - a, a):
                    take([long, a, b, c])
                    if not left[long] or not left[a]:
                        break
            if not left[long]:
                break

    open_: list[tuple[int, int, list[tuple[int, int]]]] = []  # gap, sequences, pattern
    for length in range(capacity, 0, -1):
        n = int(left[length])
        open_.sort(key=lambda g: g[0])
        after = []
        for gap, bins, pattern in open_:
            each = gap // length
            if not n or not each:
                after.append((gap, bins, pattern))
                continue
            full, some = min(bins, n // each), 0
            n -= full * each
            if full:
                after.append((gap - each * length, full, [*pattern, (length, each)]))
            if full < bins and n:
                some, n = n, 0
                after.append((gap - some * length, 1, [*pattern, (length, some)]))
            if bins > full + bool(some):
                after.append((gap, bins - full - bool(some), pattern))
        if n:
            each = capacity // length
            if n // each:
                after.append((capacity - each * length, n // each, [(length, each)]))
            if n % each:
                after.append((capacity - n % each * length, 1, [(length, n % each)]))
        open_ = after
    return patterns + [(pattern, bins) for _, bins, pattern in open_]


def ranges(patterns) -> np.ndarray:
    """Rows ``length, first rank, first sequence, offset, times``, sorted by the first two."""
    rows, used, base = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, used.get(length, 0), base, offset, times))
            used[length] = used.get(length, 0) + n * times
            offset += length * times
        base += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``pieces``."""
    found = materialize(found)
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = found.sparkSession.sparkContext.broadcast(ranges(plan(counts, capacity)))
    salts = max(16, -(-sum(counts.values()) // SLICE_ROWS))
    salted = found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    in_slice = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (salted.withColumn("rank", F.row_number().over(in_slice) - 1)
              .join(sizes, ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("before")))

    def place(batches):
        table = places.value
        keys = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
            at = rank - row[:, 1]
            arrays = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            arrays += [pa.array(row[:, 2] + at // row[:, 4]), pa.array(row[:, 3] + at % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(
                arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path, id_col, text_col, capacity), capacity)
