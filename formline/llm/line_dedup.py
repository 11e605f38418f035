"""Line de-duplication: two Bloom filters find suspects, a join confirms them.

Every line has a key: the line without white space ``[\\x20\\x09-\\x0D]`` at its
ends and with A-Z in lower case. A key of at least ``min_chars`` code points that
occurs in at least ``min_docs`` documents loses all its lines except those in the
largest document id that holds it.

1. Each task inserts its keys, one per document, into a Bloom filter of keys seen
   once and one of keys seen twice. Only the positions set in each are sent on,
   in blocks; a position set by two tasks counts as seen twice. The merged
   second filter is at most ``max_bits / 8`` bytes, whatever the corpus, and is
   broadcast. More keys than it is made for mean more false suspects, not other
   results.
2. Only keys that the second filter suspects are shuffled; they are grouped by
   the key itself, so false suspects and collisions drop out.
3. Documents meet the keys they lose by document id and are rebuilt.

Defined cases: a null text is empty; an empty text is one empty line; a null id
counts as one document that sorts first; rows that repeat an id count as one
document and lose the same keys; a key repeated in one document counts once; a
key in a single document keeps all its lines. An empty table gives an empty
result. Columns other than the named ones are ignored unless carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import NULL_ID, id_and_text, schema_of
from formline.llm.units import worker_store
from formline.session import materialize

SPACE = b" \t\n\x0b\x0c\r"
BITS_PER_DOCUMENT = 64
#: Tasks over which the documents of one key are dealt when they meet its decision.
SALTS = 32
MIN_BITS, MAX_BITS, BLOCK_BITS, PROBES = 1 << 20, 1 << 29, 1 << 16, 2


def line_keys(text: str) -> list[bytes]:
    return [line.strip(SPACE) for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    if len(key) < least or len(key) >= 4 * least:
        return len(key) >= least
    return sum((b & 0xC0) != 0x80 for b in key) >= least


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """One row per key, one column per probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)
    return ((hashes[:, None] + probes * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def held(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these positions are set."""
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _hashes(texts: list[str], least: int) -> np.ndarray:
    out: list[int] = []
    for text in texts:
        out.extend({xxhash.xxh3_64_intdigest(k) for k in line_keys(text) if long_enough(k, least)})
    return np.array(out, dtype=np.uint64)


def seen_twice(docs: DataFrame, bits: int, least: int) -> bytes:
    """The merged filter of keys seen at least twice, one bit per position."""

    def insert(batches):
        worker_store()
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys, n = np.unique(_hashes(batch.column(0).to_pylist(), least), return_counts=True)
            at = positions(keys, bits)
            again = held(once, at).all(axis=1) | (n > 1)
            for packed, own in ((twice, at[again].ravel()), (once, at.ravel())):
                np.bitwise_or.at(packed, own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
        for name, packed in (("once", once), ("twice", twice)):
            used = np.flatnonzero(packed)
            bit = np.unpackbits(packed[used], bitorder="little").astype(bool)
            found = (used[:, None] * 8 + np.arange(8)).ravel()[bit]
            edges = np.flatnonzero(np.diff(found // BLOCK_BITS, prepend=-1))
            blocks = found[edges] // BLOCK_BITS
            parts = np.split((found % BLOCK_BITS).astype("<u2"), edges[1:]) if len(edges) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array([name == "twice"] * len(parts), pa.bool_()),
                 pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "twice", "at"])

    def merge(rows: pa.Table) -> pa.Table:
        hits = np.zeros(BLOCK_BITS, dtype=np.int64)
        for is_twice, at in zip(rows["twice"].to_pylist(), rows["at"].to_pylist()):
            np.add.at(hits, np.frombuffer(at, "<u2"), 2 if is_twice else 1)
        return pa.table({"block": rows["block"][:1].cast(pa.int64()),
                         "bits": pa.array([np.packbits(hits > 1, bitorder="little").tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(insert, "block long, twice boolean, at binary")
    merged = parts.groupBy("block").applyInArrow(merge, "block long, bits binary")
    out = bytearray(bits // 8)
    for block, packed in merged.collect():  # at most max_bits / 8 bytes in all
        out[block * BLOCK_BITS // 8:(block + 1) * BLOCK_BITS // 8] = packed
    return bytes(out)


def suspects(docs: DataFrame, bits: int, twice, least: int) -> DataFrame:
    """``key, doc_id`` of the keys that the filter suspects, once per row of ``docs``."""

    def find(batches):
        table = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            keys, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = list({k for k in line_keys(text) if long_enough(k, least)})
                if not own:
                    continue
                at = positions(np.array([xxhash.xxh3_64_intdigest(k) for k in own], dtype=np.uint64), bits)
                hit = held(table, at).all(axis=1)
                keys.extend(k for k, h in zip(own, hit) if h)
                ids.extend([NULL_ID if doc is None else doc] * int(hit.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(find, "key binary, doc_id long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry=(),
                min_chars: int = 20, min_docs: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` (the remaining text) and ``carried``, a row per row of ``docs``."""
    docs = id_and_text(docs, id_col, text_col, carry)
    bits = MIN_BITS
    while bits < min(max_bits, BITS_PER_DOCUMENT * docs.count()):
        bits *= 2
    twice = docs.sparkSession.sparkContext.broadcast(seen_twice(docs, bits, min_chars))
    found = materialize(suspects(docs, bits, twice, min_chars))
    repeated = found.groupBy("key").agg(
        F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs)
    # A key that many documents hold is dealt out over SALTS tasks; its decision goes to each.
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    decided = repeated.select("key", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("salt"))
    lost = (dealt.join(decided, ["key", "salt"]).where(F.col("doc_id") != F.col("keep"))
            .groupBy(F.col("doc_id").alias("at")).agg(F.collect_set("key").alias("lost")))
    both = docs.join(lost, F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("at"), "left").drop("at")

    def rebuild(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("lost").to_pylist()):
                lines = text.split("\n")
                if gone:
                    gone = set(gone)
                    rest = [x for x, key in zip(lines, line_keys(text)) if key not in gone]
                else:
                    rest = lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(rest))
                kept.append("\n".join(rest))
            names = ["doc_id", "n_lines", "n_dropped", "kept"]
            arrays = [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
            if "carried" in batch.schema.names:
                names.append("carried")
                arrays.append(batch.column("carried"))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return both.mapInArrow(rebuild, schema_of("doc_id long, n_lines long, n_dropped long, kept string", docs))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line,
        translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
g AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, g.keep IS NOT NULL AND l.doc_id <> g.keep AS gone FROM l LEFT JOIN g USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
