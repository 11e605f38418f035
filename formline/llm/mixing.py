"""Mixes sources to target weights by a multivariate hypergeometric splitting tree.

Documents of a source are laid end to end, in an order hashed from their ids, and cut into blocks
of ``block_words`` words (the last may be shorter). A source's target is its share by weight of
``total`` times all words, at most ``most`` times its own words; the excess is shared again by
weight until no source is above. From the target follows an exact quota: whole passes over the
source's blocks, then blocks of one more pass, the last of them cut so that the words taken are
the target rounded to a whole word. Every pass has its own permutation of the source's blocks (a
keyed Feistel network walked inside its domain), so a block is drawn at most once in a pass.

Output shards hold equal numbers of blocks. The quotas of all sources are split between the two
halves of the shards by a draw from the multivariate hypergeometric distribution, then within
each half, down to single shards. A shard thus owns a range of every source's permuted blocks; ranges are
disjoint and exhaust the quotas. Within a shard, pieces are shuffled by hash. A document that
crosses the border of two blocks may be cut there.

Texts are read once, for their sizes. Word positions come from a range-partitioned sort and one sum
per task and source, so a source with a third of all rows is many tasks. Source weights are settled
by aggregates over the table of sources. The tree is split in tasks: the root holds one number per
source (labels: at most some millions), and every node draws from its own random numbers, so reruns agree.
There may be 10^9 blocks at most (a limit of the hypergeometric draws; enlarge ``block_words``).

Defined cases: null texts and texts without words have size 0 and are never taken; a source without words
has target 0; null is a source of its own, the last; an empty source name is a source; rows that
repeat an id are documents of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.operators.ordering import with_ordinal
from formline.session import materialize

WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2.0
BLOCK_WORDS, SHARD_BLOCKS, SEED = 4096, 256, 12
#: Modulus of the permutations' arithmetic.
PRIME = 2 ** 31 - 1
MOST_BLOCKS = 10 ** 9
#: Nodes of the tree that one task splits to the end.
SUBTREES = 256
ROUNDS = 4


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of element ``k`` in a permutation of ``n`` elements, one of many told apart by ``key``.

    Four Feistel rounds over the least even number of bits that holds n, repeated while
    the outcome is outside.
    """
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2)
    mask = (np.int64(1) << bits) - 1
    out, todo = k.astype(np.int64).copy(), np.arange(len(k))
    while len(todo):
        left, right = out[todo] >> bits[todo], out[todo] & mask[todo]
        for i in range(ROUNDS):
            x = (right * 69621 + key[todo] * 16807 + i * 7919) % PRIME
            for _ in range(2):
                x = (x * x % PRIME * 40692 + x * 30269 + 104729) % PRIME
            left, right = right, left ^ (x & mask[todo])
        out[todo] = (left << bits[todo]) | right
        todo = todo[out[todo] >= n[todo]]
    return out


def pass_key(rank: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    return (rank * 48271 + epoch * 7853 + seed * 104723) % PRIME


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size`` (words) of every row."""
    words = F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                       F.coalesce(words, F.lit(0)).alias("size"))


def placed(sized: DataFrame) -> DataFrame:
    """``doc_id, source, size``, a number ``row`` per document and ``start``, the words before it in its source."""
    order = ["source", F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "size", "_mid"]
    rows = sized.withColumn("_mid", F.monotonically_increasing_id()).orderBy(*order)
    rows = materialize(rows.select("doc_id", "source", "size", F.monotonically_increasing_id().alias("row")))
    rows = rows.withColumn("_task", F.shiftright("row", 33))
    # One row per sort task and source of it: as many as tasks and sources together.
    sums = rows.groupBy("source", "_task").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_task").alias("_t"), F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_task").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_task") == F.col("_t")))
    return rows.select("doc_id", "source", "size", "row", (F.col("_before") + F.col("_in")).alias("start"))


def targets(rows: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``source, rank, source_size, target``: shares by weight of all words, none above ``most`` times its own."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = with_ordinal(sums, [F.asc_nulls_last("source")], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sums = materialize(sums.withColumn("weight", weight))
    words, heft = sums.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total * words / heft if heft else 0.0), -1
    cap = F.col("source_size") * float(most)
    while True:
        above = cap <= F.col("weight") * level
        now, capped, rest = sums.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if now == full or not rest:
            break
        full, level = now, (total * words - (capped or 0.0)) / rest
    target = F.when(above, cap).otherwise(F.col("weight") * level)
    return sums.select("source", "rank", "source_size", target.alias("target"))


def quotas(aims: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Adds ``blocks`` of the source, ``quota`` of blocks to draw and ``last``, the words taken of the last one drawn."""
    def count(batches):
        for batch in batches:
            rank, size, target = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rank", "source_size", "target"))
            words = np.floor(target + 0.5).astype(np.int64)
            blocks = -(-size // block_words)
            passes, rest = np.where(size > 0, words // np.maximum(size, 1), 0), np.where(size > 0, words % np.maximum(size, 1), 0)
            short = size - (blocks - 1) * block_words
            at = permuted(np.maximum(blocks - 1, 0), np.maximum(blocks, 1), pass_key(rank, passes, seed))
            before = at * block_words  # words drawn before the short block
            late = rest > before
            drawn = np.where(late, -(-np.maximum(rest - before - short, 0) // block_words) + at + 1, -(-rest // block_words))
            held = np.where(late & (drawn == at + 1), before, np.where(late, before + short + (drawn - at - 2) * block_words, (drawn - 1) * block_words))
            last = np.where(rest > 0, rest - held, block_words)
            out = {"blocks": blocks, "quota": passes * blocks + drawn, "last": last}
            for name, column in out.items():
                batch = batch.append_column(name, pa.array(column, pa.int64()))
            yield batch

    return aims.mapInArrow(count, "source string, rank long, source_size long, target double, blocks long, quota long, last long")


def split(low: int, high: int, ranks: np.ndarray, quota: np.ndarray, start: np.ndarray, shard_blocks: int, total: int, seed: int):
    """Both halves of a node ``[low, high)`` of shards."""
    middle = (low + high) // 2
    held = min(middle * shard_blocks, total) - low * shard_blocks
    drawn = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(quota, held, method="marginals")
    left, right = drawn > 0, quota > drawn
    yield low, middle, ranks[left], drawn[left], start[left]
    yield middle, high, ranks[right], (quota - drawn)[right], (start + drawn)[right]


def shard_plan(drawn: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """``shard, rank, start, count``: the range of a source's permuted blocks that a shard owns."""
    total = drawn.agg(F.sum("quota")).first()[0] or 0
    if total >= MOST_BLOCKS:
        raise ValueError(f"{total} blocks to draw, at most {MOST_BLOCKS - 1}: enlarge block_words")
    shards = -(-total // shard_blocks)
    node = "low long, high long, ranks array<long>, quota array<long>, start array<long>"
    some = drawn.where(F.col("quota") > 0)
    root = some.agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("s")).select(
        F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), F.col("s.rank").alias("ranks"), F.col("s.quota").alias("quota"),
        F.transform("s", lambda s: F.lit(0).cast("long")).alias("start"))

    def down(batches, width):
        """Splits nodes until they have ``width`` shards or fewer."""
        for batch in batches:
            for row in batch.to_pylist():
                stack = [(row["low"], row["high"], *(np.array(row[c], np.int64) for c in ("ranks", "quota", "start")))]
                while stack:
                    at = stack.pop()
                    if at[1] - at[0] > width:
                        stack.extend(split(*at, shard_blocks, total, seed))
                    elif at[1] > at[0]:
                        yield at

    width = max(1, -(-shards // SUBTREES))

    def top(batches):
        for low, high, *vectors in down(batches, width):
            yield pa.RecordBatch.from_pydict({"low": [low], "high": [high]} | {c: pa.array([v], pa.list_(pa.int64())) for c, v in zip(("ranks", "quota", "start"), vectors)})

    def leaves(batches):
        for low, _, ranks, quota, start in down(batches, 1):
            yield pa.RecordBatch.from_pydict({"shard": np.full(len(ranks), low, np.int64), "rank": ranks, "start": start, "count": quota})

    return root.mapInArrow(top, node).repartition("low").mapInArrow(leaves, "shard long, rank long, start long, count long")


def mix(sized: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, block_words: int = BLOCK_WORDS,
        shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, pieces) of a mix.

    Documents: ``doc_id, source, size, row, start``; sources: ``source, rank, source_size, target``
    and quotas; pieces: ``shard, position`` (the order within the shard), ``doc_id, row, rank, pass, block, first_word,
    n_words`` (words of the document, from 0).
    """
    rows = materialize(placed(materialize(sized)))
    drawn = materialize(quotas(targets(rows, weights, total, most), block_words, seed))

    def draw(batches):
        for batch in batches:
            doc_id, row, start, size, rank, blocks, quota, last = (batch.column(c).to_numpy(zero_copy_only=False) for c in (
                "doc_id", "row", "start", "size", "rank", "blocks", "quota", "last"))
            first = start // block_words
            spans = np.where(size > 0, (start + size - 1) // block_words - first + 1, 0)
            passes = np.where(spans > 0, -(-quota // np.maximum(blocks, 1)), 0)
            at = np.repeat(np.arange(len(row)), spans * passes)
            step = np.arange(len(at)) - np.repeat(np.cumsum(spans * passes) - spans * passes, spans * passes)
            epoch, block = step // spans[at], first[at] + step % spans[at]
            t = epoch * blocks[at] + permuted(block, blocks[at], pass_key(rank[at], epoch, seed))
            begin = np.maximum(start[at], block * block_words)
            end = np.minimum(start[at] + size[at], block * block_words + np.where(t == quota[at] - 1, last[at], block_words))
            keep = (t < quota[at]) & (end > begin)
            at = at[keep]
            columns = {"doc_id": batch.column("doc_id").take(pa.array(at)), "row": row[at], "rank": rank[at], "pass": epoch[keep], "block": block[keep], "t": t[keep],
                       "first_word": (begin[keep] - start[at]), "n_words": (end - begin)[keep]}
            yield pa.RecordBatch.from_pydict(columns)

    known = drawn.select(F.col("source").alias("_s"), "rank", "blocks", "quota", "last")
    pieces = rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "row", "start", "size", "rank", "blocks", "quota", "last").mapInArrow(
        draw, "doc_id long, row long, rank long, pass long, block long, t long, first_word long, n_words long")
    owned = shard_plan(drawn, shard_blocks, seed).select("shard", "rank", F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("t"))
    pieces = pieces.join(owned, ["rank", "t"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64("rank", "t", "row", F.lit(seed)), "rank", "t", "row")
    pieces = pieces.withColumn("position", F.row_number().over(local) - 1)
    return rows, drawn, pieces.select("shard", "position", "doc_id", "row", "rank", "pass", "block", "first_word", "n_words")


def taken(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document of a mix of ``docs``."""
    rows, drawn, pieces = mix(sizes(docs), **settings)
    sums = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"))
    aims = drawn.select(F.col("source").alias("_s"), "source_size", "target")
    return rows.join(aims, F.col("source").eqNullSafe(F.col("_s"))).join(sums, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
