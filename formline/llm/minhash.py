"""Near-duplicate classes by DartMinHash signatures and banded joins.

A document is the multiset of its runs of five words (white space separated, A-Z in
lower case); one with fewer words has the run of all of them. The ``j``-th occurrence
of a run is an element of its own, so the Jaccard similarity of element sets is the
weighted similarity of runs.

Signature: every element has a region of width one on the weight axis, into which
darts are thrown as a Poisson process along the rank axis, by hashes of the element
and the dart's number; each dart falls on one of ``COORDINATES`` coordinates. A
document of ``n`` elements looks at ranks below ``t / n`` only, so it throws about
``t = k ln k + 2k`` darts however long it is, and keeps the earliest dart of each
coordinate; if one stays empty, it looks twice as far. Two documents agree on a
coordinate with a chance of their weighted similarity.

Join: equal texts are one node from the start. Nodes share a bucket if they agree on
all coordinates of a band (32 bands of 6: at similarity 0.8, all bands fail in 6 of
100,000 cases). Within a bucket nodes are linked to its hub, the node whose buckets are
largest in all, and to its least node, never to each other. All such candidates are
compared exactly, by their element sets. Buckets that then still hold several classes
are looked at again: every node outside the bucket's largest class is estimated
against the others by whole signatures, and candidates are compared exactly.
Links are closed to classes by alternating stars.

Defined cases: texts without words (null, empty, white space) are one class of equal
texts; the class id is the least document id of the class, null if it has none; null
and repeated ids are kept as rows; rows that repeat are equal texts; an empty table
gives an empty result; columns that are not named are ignored unless carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import NULL_ID, carried, id_and_text, schema_of
from formline.llm.components import components
from formline.llm.units import text_slices, worker_store
from formline.session import materialize

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 6
#: The bands take the first BANDS * ROWS coordinates; estimates use all.
COORDINATES = 2 * BANDS * ROWS
DARTS = COORDINATES * math.log(COORDINATES) + 2 * COORDINATES
#: Whole signatures may understate the similarity of a pair by so many standard deviations.
DEVIATIONS = 4.0
#: Nodes of a bucket in one part, of which two are looked at together.
TOGETHER = 1500
PRIME = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes half of the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def normal(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as needed."""

    up = down = np.ones(1, U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = pow(PRIME, -1, 2 ** 64)
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(n, p, U)])) for p in (PRIME, inverse))
        return cls.up, cls.down


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of normal texts in order, and the number of words of each text."""
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts])
    data = np.frombuffer(b" ".join(t for t in texts if t) + b" ", np.uint8)
    if not counts.sum():
        return np.zeros(0, U), counts
    up, down = Powers.of(len(data) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[:len(data)])])
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U)), counts


def elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of all texts in order, and the number of elements of each text."""
    words, counts = word_hashes(texts)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    which = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(counts) - counts
    at = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[which]
    runs = np.zeros(len(which), U)
    for k in range(SHINGLE):
        inside = np.minimum(counts, SHINGLE)[which] > k
        runs = mix(runs * U(PRIME) + np.where(inside, words[np.minimum(at + k, len(words) - 1)], U(k))) if len(words) else runs
    keyed = mix(runs + which.astype(U) * U(0xD6E8FEB86659FD93))
    order = np.argsort(keyed, kind="stable")
    fresh = np.concatenate([[True], keyed[order][1:] != keyed[order][:-1]]) if len(order) else np.zeros(0, bool)
    group = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) if len(order) else order
    occurrence = np.empty(len(order), U)
    occurrence[order] = group
    return mix(runs + occurrence * U(0xA24BAED4963EE407)), sizes


def signatures(units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The earliest dart of every coordinate, a row per text (zeros for a text without elements)."""
    out = np.full((len(sizes), COORDINATES), ~U(0), U)
    which = np.repeat(np.arange(len(sizes)), sizes)
    reach, todo = DARTS / np.maximum(sizes, 1), sizes > 0
    while todo.any():
        out[todo] = ~U(0)
        keep = todo[which]
        seed, row = units[keep], which[keep]
        rank, number, limit = np.zeros(len(seed)), 0, reach[row]
        while len(seed):
            number += 1
            dart = mix(seed + U((number * PRIME) % 2 ** 64))
            rank = rank - np.log(((dart >> U(11)).astype(np.float64) + 1) * 2.0 ** -53)
            near = rank < limit
            seed, row, rank, limit, dart = seed[near], row[near], rank[near], limit[near], dart[near]
            place = mix(dart)
            packed = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (place >> U(32))
            coordinate = ((place & U(0xFFFFFFFF)) * U(COORDINATES)) >> U(32)
            np.minimum.at(out.reshape(-1), row * COORDINATES + coordinate.astype(np.int64), packed)
        todo = todo & (out == ~U(0)).any(axis=1)
        reach = np.where(todo, reach * 2, reach)
    out[sizes == 0] = 0
    return out


def bands(signed: np.ndarray) -> np.ndarray:
    """A number per band and text that depends on all its coordinates."""
    parts = signed[:, :BANDS * ROWS].reshape(len(signed), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), parts.shape[:2])
    for k in range(ROWS):
        out = mix(out * U(PRIME) + parts[:, :, k])
    return out


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, node`` (a hash of the words), ``bands`` and ``brief`` (the signature in bytes), a row per row."""

    def run(batches):
        worker_store()
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in text_slices(batch.column(1)):
                words = [normal(t) for t in texts]
                signed = signatures(*elements(words))
                keys = bands(signed).view(np.int64)
                brief = mix(signed).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([xxhash.xxh3_128_digest(w) for w in words], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1))),
                     pa.array([r.tobytes() for r in brief], pa.binary())], ["doc_id", "node", "bands", "brief"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node binary, bands array<long>, brief binary")


def element_sets(docs: DataFrame) -> DataFrame:
    """``node, units`` (its element set), a row per row."""

    def run(batches):
        worker_store()
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                words = [normal(t) for t in texts]
                units, sizes = elements(words)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(w) for w in words], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(units.view(np.int64)))], ["node", "units"])

    return docs.select("text").mapInArrow(run, "node binary, units array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs ``a, b`` whose element sets have at least that Jaccard similarity.

    A node ``b`` with many partners is dealt out in slices, each with a copy of its set.
    """
    slices_of = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("slices"))
    left = pairs.join(slices_of, "b").withColumn("slice", F.pmod(F.xxhash64("a"), F.col("slices")).cast("int"))
    left = left.join(sets.select(F.col("node").alias("a"), F.col("units").alias("u")), "a")
    right = slices_of.join(sets.select(F.col("node").alias("b"), F.col("units").alias("v")), "b").select(
        "b", "v", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    common = F.size(F.array_intersect("u", "v"))
    both = left.join(right, ["b", "slice"]).select("a", "b", F.size("u").alias("m"), F.size("v").alias("n"), common.alias("c"))
    return both.where(F.col("c") >= F.lit(similar) * (F.col("m") + F.col("n") - F.col("c"))).select("a", "b")


def hubs(nodes: DataFrame) -> DataFrame:
    """``bucket, band, node`` of every bucket with several nodes, with its ``hub`` and ``least`` node."""
    rows = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = materialize(rows.join(sizes, "bucket"))
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    heavy = shared.select("bucket", "node").join(weight, "node")
    best = heavy.groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"), F.min("node").alias("least"))
    return shared.select("bucket", "band", "node").join(best, "bucket")


def candidates(members: DataFrame) -> DataFrame:
    """Distinct pairs of a node and a hub or least node of one of its buckets."""
    return members.select("node", F.explode(F.array("hub", "least")).alias("b")).where(F.col("node") != F.col("b")).select(
        F.col("node").alias("a"), "b").distinct()


def left_over(members: DataFrame, nodes: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """Pairs of different classes of one bucket whose signatures look similar.

    Nodes outside a bucket's largest class are dealt into parts of about ``TOGETHER``, that class as
    well; every part outside meets every other part and itself, each two of them in a group of their own.
    """
    rows = members.select("bucket", "band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("all"),
                                          F.max(F.struct("n", "root")).alias("main")).where(F.col("classes") > 1)
    rows = rows.join(mixed, "bucket").withColumn("outside", F.col("root") != F.col("main.root"))
    rows = rows.withColumn("others", F.col("all") - F.col("main.n"))
    rows = rows.join(nodes.select("node", "bands", "brief"), "node")
    parts, slices = (F.ceil(F.col(n) / TOGETHER).cast("int") for n in ("others", "main.n"))
    rows = rows.withColumn("parts", parts).withColumn("slices", slices)
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("parts")).otherwise(F.col("slices"))).cast("int")
    rows = rows.withColumn("part", F.when(F.col("outside"), mine).otherwise(F.col("parts") + mine))  # those outside come first
    last = F.when(F.col("outside"), F.col("parts") + F.col("slices")).otherwise(F.col("parts")) - 1
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last))).where(F.col("other") != F.col("part")).select(
        "bucket", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "band", "node", "root", "brief", "part", "parts")

    least = similar - DEVIATIONS * math.sqrt(similar * (1 - similar) / COORDINATES)

    def compare(group: pa.Table) -> pa.Table:
        node = group["node"].to_pylist()
        root = np.unique(np.array([r.hex() for r in group["root"].to_pylist()]), return_inverse=True)[1]
        left = group["part"].to_numpy() == group["left"][0].as_py()
        itself = group["right"][0].as_py() == group["parts"][0].as_py()  # once per part outside: with the first slice of the largest class
        brief = np.frombuffer(b"".join(group["brief"].to_pylist()), np.uint8).reshape(len(node), COORDINATES)
        band = group["band"][0].as_py()
        found: list[tuple[bytes, bytes]] = []
        for i in np.flatnonzero(left):
            others = np.flatnonzero((root != root[i]) & (itself | ~left))
            same = brief[others] == brief[i]
            near = np.count_nonzero(same, axis=1) >= least * COORDINATES
            others, same = others[near], same[near]
            # A pair is reported by the first bucket it shares.
            others = others[same[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
            found.extend((max(node[i], node[j]), min(node[i], node[j])) for j in others)
        found = list(set(found))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return dealt.groupBy("bucket", "left", "right").applyInArrow(compare, "a binary, b binary").distinct()


def classified(docs: DataFrame, similar: float) -> DataFrame:
    """``doc_id, node, class_id, class_size, first`` (and ``carried``), a row per row of ``docs``.

    ``first`` marks the node, of those with a document of the class id, that stands for the class.
    """
    signed = materialize(sign(docs).withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID))))
    firsts = signed.groupBy("node").agg(F.min("id").alias("id"))
    # One row per node: its id stands for it, and rows that repeat are equal.
    nodes = materialize(signed.join(firsts, ["node", "id"]).select("node", "id", "bands", "brief").dropDuplicates(["node"]))
    members = materialize(hubs(nodes))
    wanted = members.select("node").distinct().join(nodes.select("node", "id"), "node")
    texts = docs.join(wanted.select(F.col("id").alias("at")).distinct(), F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("at"), "left_semi")
    sets = materialize(element_sets(texts).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    links = materialize(verified(materialize(candidates(members)), sets, similar))
    roots = components(links)
    more = materialize(verified(materialize(left_over(members, nodes, roots, similar)), sets, similar))
    if more.limit(1).count():
        roots = components(links.union(more))
    per_node = signed.groupBy("node").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    per_node = per_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stands = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("node")))["node"]
    classes = per_node.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"), stands.alias("stands"))
    of_node = per_node.select("node", "root").join(classes, "root").select(
        "node", "class_id", "class_size", (F.col("node") == F.col("stands")).alias("first"))
    if not carried(docs):
        return signed.select("doc_id", "node").join(of_node, "node")

    def key(batches):
        for batch in batches:
            digests = [xxhash.xxh3_128_digest(normal(t)) for _, _, texts in text_slices(batch.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), batch.column("carried")],
                                             ["doc_id", "node", "carried"])

    keyed = docs.mapInArrow(key, schema_of("doc_id long, node binary", docs))
    return keyed.join(of_node, "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry=(),
                    similar: float = SIMILAR) -> DataFrame:
    """``doc_id, class_id, class_size`` (and ``carried``), a row per row of ``docs``."""
    return classified(id_and_text(docs, id_col, text_col, carry), similar).drop("node", "first")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry=(),
                  similar: float = SIMILAR) -> DataFrame:
    """``doc_id, class_id, class_size`` (and ``carried``) of one row of every class, that of its least id.

    Rows that repeat the id and the words of that row are already together by node.
    """
    rows = classified(id_and_text(docs, id_col, text_col, carry), similar)
    return rows.where(F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).dropDuplicates(["node"]).drop("node", "first")
