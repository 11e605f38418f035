"""Language-model scores by a probabilistic suffix tree, beside a unigram base.

A text is its words (A-Z in lower case) joined by one space, and an end. The tree's
symbols are the bytes of that sequence; contexts reach up to ``DEPTH`` bytes back,
over the start of the text as well.

* Counting: one pass over the training documents counts words and runs of
  ``DEPTH + 1`` bytes per task, exactly; both are summed by key in one shuffle. Counts
  of shorter runs are sums of these.
* The tree: a context is retained if its next-symbol distribution diverges from that of
  its longest proper suffix, by at least ``LEAST_DIVERGENCE`` nats a position and
  ``LEAST_EVIDENCE`` nats in all, or if it is the suffix of a retained one. It lists all
  symbols seen after it. So what is retained depends on evidence, not on the size of the
  corpus, and the tree grows with it. The runs are shuffled once by the last two bytes of
  their contexts, and every such subtree is grown whole in a group. Where more than
  ``GROUP_RUNS`` distinct runs share those bytes, they are split by one byte more, and so on.
  Only the top above the groups passes through the driver (``Top``).
* Smoothing: a context with ``n`` positions and ``d`` different next symbols gives
  ``(count + d p) / (n + d)``, ``p`` being its suffix's probability; symbols it does not
  list share the rest in proportion to ``p``. The root adds one to every byte.
* Scoring: every byte is predicted in the longest retained suffix of what stands before
  it. Documents are dealt to blocks of bounded size and sent there once, compressed; the distinct
  runs of every block go packed to the groups in which the subtrees are grown, and the logs go back
  packed: in the order of their suffixes, runs predicted alike stand together and are sent once.

The base needs a count for every word of every document. Words with a share of at
least ``WORD_SHARE`` of the training tokens, at most ``1 / WORD_SHARE`` of them, are
broadcast; the rest of each document's words is joined with the counts by word. Words
are compared by 64-bit hashes.

Defined cases: a null or empty text is the end alone; a null id counts as the empty text
where ids are dealt out; repeated ids are kept as rows, and all of them are learned
from or none; without training documents every byte has the probability 1/256 and the base score
is 0; an empty table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import id_and_text
from formline.llm.minhash import normal, word_hashes
from formline.llm.units import text_slices, worker_store
from formline.session import materialize

DEPTH, END = 6, 10
#: Nothing is left out for its share of the corpus; a caller who wants a smaller tree may raise the first two.
CONTEXT_SHARE, SYMBOL_SHARE, WORD_SHARE = 0.0, 0.0, 2e-7
LEAST_DIVERGENCE, LEAST_EVIDENCE = 0.02, 8.0
FOLDS, HELD_OUT = 7, 2
WORD, RUN = 0, 1
END_KEY = np.uint64(0x656E64)
MERGE_AT, SEND_AT, CACHE_BITS = 1_500_000, 1_200_000, 21
#: Bytes of text that are scored together, and bytes of all text for a bucket of keys.
BLOCK_BYTES, BUCKET_PLACES = 24_000_000, 4_000_000
#: Distinct training runs under one suffix that are taken together.
GROUP_RUNS = 2_000_000
U = np.uint64


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The runs that end at each byte and at the end of each text, and their number per text."""
    pad = bytes([END]) * DEPTH
    data = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    run = np.zeros(max(0, len(data) - DEPTH), U)
    for k in range(DEPTH + 1):
        run = (run << U(8)) | data[k:len(data) - DEPTH + k].astype(U)
    first = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return run[at], sizes


def edges(ordered: np.ndarray) -> np.ndarray:
    """Where a new value starts."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Different keys in order; sorting is many times faster here than the hash table behind ``np.unique``."""
    keys = np.sort(keys)
    return keys[edges(keys)]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    edge = edges(keys)
    return keys[edge], np.diff(np.append(edge, len(keys)))


def tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = edges(keys)
    return keys[edge], np.add.reduceat(counts, edge)


def bucket(key):
    """A number that spreads runs, of an array or of a column of them."""
    shift, xor = (F.shiftright, Column.bitwiseXOR) if isinstance(key, Column) else (np.right_shift, np.bitwise_xor)
    return xor(xor(key, shift(key, 21)), shift(key, 39))


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, all first bytes before all second ones and so on: the high bytes of sorted runs repeat."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def text_size(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]


def buckets_of(size: int) -> int:
    """Buckets for keys, in proportion to all text."""
    return max(64, math.ceil(size / BUCKET_PLACES)) | 1


def merged(group: pa.Table) -> pa.Table:
    keys, n = tally([tuple(np.concatenate([unpacked(x) for x in group[c].to_pylist()]) for c in ("key", "n"))])
    return pa.table({"kind": pa.array(np.full(len(keys), group["kind"][0].as_py(), np.int32)), "key": keys, "n": n})


def count(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``kind, key, n``: counts of words and of runs of bytes."""
    buckets = buckets or buckets_of(text_size(docs))

    def sent(kind: int, parts: list[tuple[np.ndarray, np.ndarray]]):
        keys, n = tally(parts)
        place = (bucket(keys.view(np.int64)) % buckets).astype(np.int64)
        order = np.argsort(place, kind="stable")
        keys, n, place = keys[order], n[order].astype(np.int64), place[order]
        first = edges(place)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(first), kind, np.int32)), pa.array(place[first]),
             *(pa.array([packed(x) for x in np.split(values, first[1:])], pa.binary()) for values in (keys, n))],
            ["kind", "bucket", "key", "n"])

    def run(batches):
        worker_store()
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        size = [0, 0]
        for batch in batches:
            for a, b, texts in text_slices(batch.column(0)):
                words = [normal(t) for t in texts]
                hashes = np.concatenate([word_hashes(words)[0], np.full(b - a, END_KEY, U)])
                for kind, keys in ((WORD, hashes), (RUN, runs_of(words)[0])):
                    held[kind].append(counted(keys))
                    size[kind] += len(held[kind][-1][0])
                    if size[kind] > MERGE_AT:
                        held[kind] = [tally(held[kind])]
                        size[kind] = len(held[kind][0][0])
                        if size[kind] > SEND_AT:  # what a task holds is bounded; its counts go on in parts
                            yield from sent(kind, held[kind])
                            held[kind], size[kind] = [], 0
        for kind in (WORD, RUN):
            if held[kind]:
                yield from sent(kind, held[kind])

    parts = docs.select("text").mapInArrow(run, "kind int, bucket long, key binary, n binary")
    return parts.groupBy("kind", "bucket").applyInArrow(merged, "kind int, key long, n long")


@dataclass
class Level:
    """Retained contexts of one length with the log10 share left to their suffix, and their listed symbols."""

    contexts: np.ndarray
    left: np.ndarray
    keys: np.ndarray
    logs: np.ndarray


@dataclass
class Words:
    """What the base needs of the training documents: the frequent words, and the numbers of tokens and of words."""

    words: np.ndarray
    counts: np.ndarray
    tokens: int
    kinds: int

    @property
    def denominator(self) -> int:
        return self.tokens + self.kinds + 1


@dataclass
class Model(Words):
    top: Top
    tree: DataFrame

    @cached_property
    def levels(self) -> list[Level]:
        """The whole tree in memory: for small corpora only; scoring does not use it."""
        root = self.top.levels[0]
        out = [Level(np.zeros(1, U), np.zeros(1), root.keys, np.log10(root.p))]
        rows = pa.concat_tables([self.tree.toArrow(), retained_rows(dict(enumerate(self.top.levels[1:], 1)))]).sort_by("key")
        level, key, p, rest = (rows[c].to_numpy() for c in ("level", "key", "p", "rest"))
        for k in range(1, DEPTH + 1):
            keys = key[level == k].view(U)
            context, first = np.unique(keys >> U(8), return_index=True)
            out.append(Level(context, np.log10(rest[level == k][first]), keys, np.log10(p[level == k])))
        return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def mask(size: int) -> int:
    return (1 << 8 * size) - 1


class Rows:
    """Counts of the symbols after the contexts of one length: sorted keys (context and symbol) and sums by context."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = tally([(keys, n)])
        context = self.keys >> U(8)
        self.first = edges(context)
        self.context = context[self.first]
        self.which = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.keys))))
        self.total, self.kinds = self.sums(self.n), self.sums((self.n > 0).astype(np.int64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first)

    def shares(self) -> np.ndarray:
        return self.n / np.maximum(self.total, 1)[self.which]

    def test(self, share: np.ndarray, places: int) -> None:
        """Which symbols are listed, and which contexts diverge from their suffix, where the symbols have ``share``."""
        total = self.total[self.which]
        self.listed = (self.n > 0) & (self.n >= SYMBOL_SHARE * places) & (total >= CONTEXT_SHARE * places)
        n = np.where(self.listed, self.n, 0)
        ratio = np.divide(self.n, total * share, out=np.ones(len(n)), where=self.listed)
        evidence = self.sums(n * np.log(ratio))
        self.retained = (evidence >= LEAST_EVIDENCE) & (evidence >= LEAST_DIVERGENCE * self.sums(n))

    def retain(self, contexts: np.ndarray) -> None:
        self.retained[np.searchsorted(self.context, contexts)] = True

    def smooth(self, up: np.ndarray) -> None:
        """Probabilities from those of the suffix."""
        self.own = self.retained[self.which] & self.listed
        kinds = self.kinds[self.which]
        p = (self.n + kinds * up) / np.maximum(self.total[self.which] + kinds, 1)
        others, others_up = (np.maximum(1 - self.sums(np.where(self.own, x, 0.0)), 1e-12) for x in (p, up))
        self.rest = np.where(self.retained, others / others_up, 1.0)
        self.p = np.where(self.own, p, self.rest[self.which] * up)


@dataclass
class Top:
    """The root, the contexts of one byte, and longer ones under which there are too many runs for one group.

    Every context has all 256 symbols. There are at most 256 contexts of one byte and, of every other
    length, at most one for ``GROUP_RUNS`` distinct runs.
    """

    places: int
    levels: list[Rows]

    def above(self, length: int, keys: np.ndarray) -> np.ndarray:
        """Where the keys stand, without their oldest byte, in the rows of the length before."""
        return np.searchsorted(self.levels[length - 1].keys, keys & U(mask(length)))

    def shares(self, length: int) -> np.ndarray:
        rows = self.levels[length]
        return rows.shares() if length else rows.p

    def suffixes(self, contexts: np.ndarray, length: int) -> None:
        """Retain all suffixes of retained contexts of this length."""
        for k in range(1, length):
            self.levels[k].retain(contexts & U(mask(k)))


def suffix(size: int) -> Column:
    """The last bytes of the context of a run."""
    return F.shiftright("key", 8).bitwiseAND(F.lit(mask(size)))


def owner(top: Top) -> Column:
    """The group of a run: the shortest suffix of its context that is not in ``top``, with its length in the byte above."""
    of = lambda k: suffix(k).bitwiseOR(F.lit(k << 8 * DEPTH))
    group = of(len(top.levels))
    for k in range(len(top.levels) - 1, 1, -1):
        group = F.when(suffix(k).isin(top.levels[k].context.tolist()), group).otherwise(of(k))
    return group.alias("group")


def subtree(group: pa.Table, length: int, top: Top) -> dict[int, Rows]:
    """All contexts of a group with their tests."""
    levels = {DEPTH: Rows(group["key"].to_numpy().view(U), group["n"].to_numpy())}
    for k in range(DEPTH - 1, length - 1, -1):
        levels[k] = Rows(levels[k + 1].keys & U(mask(k + 1)), levels[k + 1].n)
    share = top.shares(length - 1)[top.above(length, levels[length].keys)]
    for k in range(length, DEPTH + 1):
        levels[k].test(share, top.places)
        if k < DEPTH:
            share = levels[k].shares()[np.searchsorted(levels[k].keys, levels[k + 1].keys & U(mask(k + 1)))]
    for k in range(DEPTH, length, -1):
        levels[k - 1].retain(levels[k].context[levels[k].retained] & U(mask(k - 1)))
    return levels


def grown(group: pa.Table, length: int, top: Top) -> dict[int, Rows]:
    """All contexts of a group with their probabilities."""
    levels = subtree(group, length, top)
    up = top.levels[length - 1].p[top.above(length, levels[length].keys)]
    for k in range(length, DEPTH + 1):
        levels[k].smooth(up)
        if k < DEPTH:
            up = levels[k].p[np.searchsorted(levels[k].keys, levels[k + 1].keys & U(mask(k + 1)))]
    return levels


def top_of(runs: DataFrame) -> Top:
    """The top of the tree from ``key, n`` of the runs of the training documents."""

    def collected(rows: DataFrame, length: int, contexts) -> Rows:
        told = rows.groupBy(F.col("key").bitwiseAND(F.lit(mask(length + 1))).alias("key")).agg(F.sum("n").alias("n")).toArrow()
        every = ((np.array(contexts, U) << U(8))[:, None] | np.arange(256, dtype=U)).ravel()
        return Rows(np.concatenate([every, told["key"].to_numpy().view(U)]),
                    np.concatenate([np.zeros(len(every), np.int64), told["n"].to_numpy()]))

    levels = [Rows(np.arange(256, dtype=U), np.zeros(256, np.int64)), collected(runs, 1, range(256))]
    levels[0].n = levels[1].n.reshape(256, 256).sum(axis=0)
    inside = runs
    for k in range(2, DEPTH):
        large = [r[0] for r in inside.groupBy(suffix(k).alias("suffix")).count().where(F.col("count") > GROUP_RUNS).select("suffix").collect()]
        if not large:
            break
        inside = inside.where(suffix(k).isin(large))
        levels.append(collected(inside, k, large))
    top = Top(int(levels[0].n.sum()), levels)
    levels[0].p = (levels[0].n + 1) / (top.places + 256)
    for k in range(1, len(levels)):
        levels[k].test(top.shares(k - 1)[top.above(k, levels[k].keys)], top.places)
    for k in range(len(levels) - 1, 1, -1):
        top.suffixes(levels[k].context[levels[k].retained], k)
    # Contexts that do not diverge themselves are retained for a longer one that does.
    open_ = [suffix(k).isin(levels[k].context[~levels[k].retained].tolist()) for k in range(1, len(levels))]
    sent = runs.sparkSession.sparkContext.broadcast(top)

    def telling(key, group):
        length = key[0].as_py() >> 8 * DEPTH
        kept = bool(subtree(group, length, sent.value)[length].retained.any())
        return pa.table({"group": pa.array([key[0].as_py()] * kept, pa.int64())})

    asked = runs.where(reduce(Column.__or__, open_)).select("key", "n", owner(top))
    for group, in asked.groupBy("group").applyInArrow(telling, "group long").collect():  # at most one for every group
        top.suffixes(np.array([group & mask(DEPTH)], U), group >> 8 * DEPTH)
    for k in range(1, len(levels)):
        levels[k].smooth(levels[k - 1].p[top.above(k, levels[k].keys)])
    return top


def grow(runs: DataFrame, top: Top, rows_of, ddl: str) -> DataFrame:
    """Every subtree below ``top`` is grown in a group of its own, from ``key, n`` of runs of bytes (``n`` is 0
    for runs that are only to be scored); ``rows_of`` makes a table of its levels."""
    sent = runs.sparkSession.sparkContext.broadcast(top)

    def made(key, group):
        return rows_of(grown(group, key[0].as_py() >> 8 * DEPTH, sent.value))

    return runs.select("key", "n", owner(top)).groupBy("group").applyInArrow(made, ddl)


def retained_rows(levels: dict[int, Rows]) -> pa.Table:
    """``level, key, p, rest`` of what the retained contexts list."""
    parts = [(np.full(int(r.own.sum()), k, np.int32), r.keys[r.own].view(np.int64), r.p[r.own], r.rest[r.which[r.own]]) for k, r in levels.items()]
    return pa.table(dict(zip(("level", "key", "p", "rest"), map(np.concatenate, zip(*parts)))))


def frequent(counts: DataFrame) -> Words:
    """The base from the counts of the training documents."""
    words = counts.where(F.col("kind") == WORD)
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rows = words.where(F.col("n") >= WORD_SHARE * tokens).select("key", "n").toArrow()  # at most 1 / WORD_SHARE rows
    key, n = rows["key"].to_numpy().view(U), rows["n"].to_numpy()
    order = np.argsort(key)
    return Words(key[order], n[order], tokens, kinds)


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """The model from the counts of the training documents."""
    words, runs = frequent(counts), counts.where(F.col("kind") == RUN).select("key", "n")
    top = top_of(runs)
    tree = grow(runs, top, retained_rows, "level int, key long, p double, rest double")
    return Model(words.words, words.counts, words.tokens, words.kinds, top, tree)


def run_logs(levels: list[Level], runs: np.ndarray) -> np.ndarray:
    """log10 of the probability of the last byte of each run after the bytes before it."""
    out, open_ = np.zeros(len(runs)), np.ones(len(runs), bool)
    inside = np.zeros(len(runs), bool)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        key = runs & U((1 << 8 * (k + 1)) - 1)
        context, retained = find(level.contexts, key >> U(8))
        inside |= retained
        at, listed = find(level.keys, key)
        hit = open_ & inside & listed
        out[hit] += level.logs[at[hit]]
        open_ &= ~hit
        passed = open_ & retained
        out[passed] += level.left[context[passed]]
    return out


def base(model: Words, texts: list[bytes]):
    """Per text: tokens, tokens known so far, sum of log10(c + 1) so far; and the words still to be counted."""
    hashes, counts = word_hashes(texts)
    which = np.repeat(np.arange(len(texts)), counts)
    at, there = find(model.words, hashes)
    logs = np.where(there, np.log10(model.counts[at] + 1.0), 0.0) if len(model.words) else np.zeros(len(hashes))
    end_at, end_there = find(model.words, np.array([END_KEY], U))
    end_count = int(model.counts[end_at[0]]) if end_there[0] else 0
    known = np.bincount(which, there, len(texts)).astype(np.int64) + (end_count > 0)
    total = np.bincount(which, logs, len(texts)) + np.log10(end_count + 1.0)
    return counts + 1, known, total, hashes[~there], which[~there]


def turned(runs: np.ndarray) -> np.ndarray:
    """Runs with the last two bytes of the context first, then the symbol, then the other bytes backwards: in this order
    runs that are predicted in the same suffix stand together, and groups come in parts."""
    return ((runs >> U(8) & U(mask(2))) << U(48)) | ((runs & U(255)) << U(40)) | (runs.byteswap() & U(mask(5)))


def turned_back(runs: np.ndarray) -> np.ndarray:
    return (runs & U(mask(5))).byteswap() | (runs >> U(48) << U(8)) | (runs >> U(40) & U(255))


def owners(runs: np.ndarray, top: Top) -> np.ndarray:
    """``owner`` of an array of runs."""
    context = runs >> U(8)
    of = lambda k: (context & U(mask(k))) | U(k << 8 * DEPTH)
    group = of(2)
    for k in range(2, len(top.levels)):
        group = np.where(find(top.levels[k].context, context & U(mask(k)))[1], of(k + 1), group)
    return group.view(np.int64)


def sealed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def parts(docs: DataFrame, words: Words, blocks: int) -> DataFrame:
    """``block, data``: slices of the documents, compressed, with what the base knows of each, dealt to the blocks in turn."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        worker_store()
        block = TaskContext.get().partitionId() * 7919 % blocks
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                normals = [normal(t) for t in texts]
                tokens, known, total, rare, which = base(sent.value, normals)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=b - a))]).astype(np.int32)
                data = sealed(pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a), "held_out": batch.column("held_out").slice(a, b - a),
                    "n_tokens": pa.array(tokens.astype(np.int64)), "known": pa.array(known), "total": pa.array(total),
                    "rare": pa.ListArray.from_arrays(pa.array(offsets), pa.array(rare.view(np.int64))), "text": pa.array(normals, pa.binary())}))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary())})
                block = (block + 1) % blocks

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "block long, data binary")


def runs_of_block(group: pa.Table) -> np.ndarray:
    """The distinct runs of a block, turned."""
    held, n_held = [np.empty(0, U)], 0
    for data in group["data"]:
        for _, _, part in text_slices(opened(data.as_buffer())["text"].combine_chunks()):
            held.append(distinct(turned(runs_of(part)[0])))
            n_held += len(held[-1])
            if n_held > MERGE_AT:
                held, n_held = [distinct(np.concatenate(held))], 0
    return distinct(np.concatenate(held))


def by_owner(runs: np.ndarray, top: Top) -> tuple[np.ndarray, np.ndarray]:
    """The order of turned runs by their group, and the groups in that order."""
    group = owners(turned_back(runs), top)
    order = np.argsort(group, kind="stable")
    return order, group[order]


def asked_by(block: int, group: pa.Table, top: Top) -> pa.Table:
    """The distinct runs of a block by group."""
    keys = runs_of_block(group)
    order, group_of = by_owner(keys, top)
    first = edges(group_of)
    asked = [packed(x) for x in np.split(keys[order], first[1:])]
    return pa.table({"block": np.full(len(asked), block, np.int64), "group": group_of[first], "runs": pa.array(asked, pa.binary())})


def answered(group: int, asked: pa.Table, runs: pa.Table, top: Top) -> pa.Table:
    """The logs of the runs that the blocks ask for in one group, in their order: every change and how often it holds.

    The asked runs are unpacked block by block.
    """
    pieces, wanted, n_wanted = asked["runs"].to_pylist(), [np.empty(0, U)], 0
    for piece in pieces:
        wanted.append(unpacked(piece).view(U))
        n_wanted += len(wanted[-1])
        if n_wanted > MERGE_AT:
            wanted, n_wanted = [distinct(np.concatenate(wanted))], 0
    logs, times = [], []
    if pieces:
        keys = turned_back(distinct(np.concatenate(wanted)))
        whole = pa.table({"key": np.concatenate([runs["key"].to_numpy(), keys.view(np.int64)]),
                          "n": np.concatenate([runs["n"].to_numpy(), np.zeros(len(keys), np.int64)])})
        rows = grown(whole, group >> 8 * DEPTH, top)[DEPTH]
        log = np.log10(rows.p)
        for piece in pieces:
            found = log[np.searchsorted(rows.keys, turned_back(unpacked(piece).view(U)))]
            first = edges(found)
            logs.append(packed(found[first].view(np.int64)))
            times.append(packed(np.diff(np.append(first, len(found)))))
    return pa.table({"block": asked["block"], "group": pa.array(np.full(len(pieces), group, np.int64)),
                     "logs": pa.array(logs, pa.binary()), "times": pa.array(times, pa.binary())})


SCORED = "doc_id long, held_out boolean, n_tokens long, known long, total double, rare array<long>, score double"


def block_scores(docs: pa.Table, told: pa.Table, top: Top) -> pa.Table:
    """The documents of one block with the sums of their runs' logs; its distinct runs are found as they were for asking."""
    keys = runs_of_block(docs)
    order, _ = by_owner(keys, top)
    told = told.sort_by("group")
    answers = [np.repeat(unpacked(x).view(np.float64), unpacked(n)) for x, n in zip(told["logs"].to_pylist(), told["times"].to_pylist())]
    logs = np.empty(len(keys))
    logs[order] = np.concatenate(answers)  # fails if not every run was answered
    slot = lambda runs: ((runs * U(0x9E3779B97F4A7C15)) >> U(64 - CACHE_BITS)).astype(np.int64)
    quick = np.zeros(1 << CACHE_BITS, np.int64)  # a place to look at before searching
    quick[slot(keys)] = np.arange(len(keys))
    out = []
    for data in docs["data"]:
        part, scores = opened(data.as_buffer()), []
        for _, _, texts in text_slices(part["text"].combine_chunks()):
            runs, sizes = runs_of(texts)
            runs = turned(runs)
            at = quick[slot(runs)]
            miss = np.flatnonzero(keys[at] != runs)
            at[miss] = np.searchsorted(keys, runs[miss])
            scores.append(np.add.reduceat(logs[at], np.cumsum(sizes) - sizes))
        out.append(part.drop_columns(["text"]).append_column("score", pa.array(np.concatenate(scores))))
    return pa.concat_tables(out)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row per row of ``docs``."""
    docs = id_and_text(docs, id_col, text_col).withColumn("held_out", held_out())
    size = text_size(docs)
    counts = materialize(count(docs.where(~F.col("held_out")), buckets_of(size)))
    model = frequent(counts)
    runs = counts.where(F.col("kind") == RUN).select("key", "n")
    top = top_of(runs)
    sent = docs.sparkSession.sparkContext.broadcast(top)
    blocks = parts(docs, model, max(1, math.ceil(size / BLOCK_BYTES))).groupBy("block")
    asked = blocks.applyInArrow(lambda key, group: asked_by(key[0].as_py(), group, sent.value), "block long, group long, runs binary")
    told = asked.groupBy("group").cogroup(runs.select("key", "n", owner(top)).groupBy("group")).applyInArrow(
        lambda key, asked, runs: answered(key[0].as_py(), asked, runs, sent.value), "block long, group long, logs binary, times binary")
    found = blocks.cogroup(told.groupBy("block")).applyInArrow(lambda docs, told: block_scores(docs, told, sent.value), SCORED)
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()))
    rare = found.select("row", F.explode("rare").alias("key")).join(
        counts.where((F.col("kind") == WORD) & (F.col("n") < WORD_SHARE * model.tokens)).select("key", "n"), "key")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("added"))
    out = found.drop("rare").join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("total") + F.coalesce("added", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(model.denominator)))).alias("base_score"),
        "score")
