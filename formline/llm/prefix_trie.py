"""Prefix trie of conversations, finished in sorted shards around a broadcast skeleton.

Every conversation is rebuilt from its group of ``BASE`` ids: the first ``h`` turns of the
group's first conversation, then its own turns after its first ``h``, with ``h`` a hash of its
id. Its path is the chain of its turns' digests (16 bytes of SHA-256 over role and text each),
so paths in byte order keep every subtree together.

- A bounded sample of paths gives the splitters of a range partition by (path, conv_id); equal
  paths are split by id. The trie of the splitter paths, the skeleton, is broadcast. Its size is
  checked: with long paths fewer splitters are drawn, so that sampled paths never pass
  ``SKELETON_BYTES``.
- A node that is no prefix of a splitter has all its members in one shard. Shards are sorted and
  streamed through a stack of open nodes, which finishes all such nodes on the spot.
- Skeleton nodes leave one partial aggregate per shard; these are reduced by key, and one pass
  over the bounded skeleton adds up its subtrees. Ids that end at a skeleton node travel as
  packed chunks of decimal text, in order, and are hashed as a stream: SHA-256 takes its bytes in
  turn, so a node that ends a third of all conversations costs one task the bytes of its ids, but
  never holds them.

Result, one row per node (see ``nodes``); a conversation is one record of 24 bytes a turn.

Defined cases: turns in order of turn (null first), ties by role, then by the first 32
characters of the text, then by digest; null role or text is empty; rows that repeat are turns
of their own; rows without conv_id take no part; negative ids group by the remainder that
truncates toward zero; conversations without turns are members of the root; an empty table has
no nodes; texts may be of any length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import materialize

DIGEST = 16
BASE, HEAD = 5, 9
#: Bounds: bytes of sampled splitter paths, conversations and bytes of paths a shard is meant to hold.
SKELETON_BYTES, SHARD_ROWS, SHARD_BYTES = 1 << 24, 50_000, 1 << 24
SAMPLES_PER_SHARD = 20
CHUNK = 1 << 14
ROWS_OUT = 4096

_OUT = ("kind int, conv_id long, depth long, up long, up_skeleton boolean, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string, last_bytes long, skeleton long, shard int, seq long, chunk binary")
_NODE, _PARTIAL, _CHUNK = 0, 1, 2


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path binary, sizes array<long>`` (bytes of the texts) of every rebuilt conversation.

    One shuffle by group of ids; only digests travel.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    rows = conversations.select(
        F.col("`conv_id`").cast("long").alias("conv_id"),
        F.struct(F.col("`turn`").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, 32).alias("start"),
                 digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"),
    ).where(F.col("conv_id").isNotNull()).withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE)
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = own.select("base", "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("t"))
    group = own.groupBy("base").agg(
        F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("t", 1, HEAD - 1)), ignorenulls=True).alias("head"),
        F.collect_list(F.struct("conv_id", "t")).alias("own"))
    each = group.select("head", F.explode("own").alias("own")).select("head", "own.*")
    h = F.crc32(F.col("conv_id").cast("string")) % HEAD
    each = each.withColumn("h", h.cast("int"))
    kept = F.slice(F.col("t"), F.col("h") + 1, F.size("t"))
    turns = F.when(F.col("head").isNull(), kept).otherwise(F.concat(F.slice(F.col("head"), F.lit(1), F.col("h")), kept))
    each = each.select("conv_id", turns.alias("turns"))
    return each.select("conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("path"), F.col("turns.size").alias("sizes"))


def splitters(paths: DataFrame, n_rows: int, n_bytes: int, longest: int) -> list[tuple[bytes, int]]:
    """Sorted (path, conv_id) borders of shards, from a bounded sample of the keys by hash of the id."""
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(n_rows, max(tasks, -(-n_rows // SHARD_ROWS), -(-n_bytes // SHARD_BYTES)))
    k = max(1, min(SAMPLES_PER_SHARD * wanted, SKELETON_BYTES // (longest + 8)))
    share = min(1.0, 1.5 * k / n_rows + 1e-4)
    rank = F.xxhash64("conv_id")
    picked = paths.where(F.pmod(rank, F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    sample = sorted((bytes(r["path"]), r["conv_id"]) for r in picked.orderBy(rank, "conv_id").limit(k).select("path", "conv_id").toLocalIterator())
    weights = [64 + 3 * len(p) // 2 for p, _ in sample]
    total, held, found = sum(weights), 0, []
    wanted = max(1, min(wanted, len(sample) // 4))
    for key, weight in zip(sample, weights):
        if held * wanted >= (len(found) + 1) * total:
            found.append(key)
        held += weight
    return found


class Skeleton:
    """Trie of the splitter paths; node 0 is the root and parents come before children."""

    def __init__(self, paths: list[bytes]):
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.depth = [-1], [0]
        for path in paths:
            at = 0
            for i in range(0, len(path), DIGEST):
                at = self._child(at, path[i:i + DIGEST])

    def _child(self, at: int, digest: bytes) -> int:
        found = self.children[at].get(digest)
        if found is None:
            found = self.children[at][digest] = len(self.parent)
            self.children.append({})
            self.parent.append(at)
            self.depth.append(self.depth[at] + 1)
        return found


class _Node:
    __slots__ = ("skeleton", "size", "least", "n", "children", "leaves", "saved", "ends", "seq", "waiting")

    def __init__(self, skeleton: int, size: int):
        self.skeleton, self.size = skeleton, size
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.seq, self.waiting = None, 0, []


class _Walk:
    """The open nodes of one shard; ``rows`` fills with finished rows."""

    def __init__(self, skeleton: Skeleton, shard: int, rows: list):
        self.skeleton, self.shard, self.rows = skeleton, shard, rows
        self.path, self.stack = b"", [_Node(0, 0)]

    def add(self, path: bytes, conv_id: int, sizes: list[int]) -> None:
        same, most = 0, min(len(path), len(self.path))
        if path[:most] == self.path[:most]:
            same = most
        else:
            while path[same:same + DIGEST] == self.path[same:same + DIGEST]:
                same += DIGEST
        while len(self.stack) - 1 > same // DIGEST:
            self._close()
        for i in range(same, len(path), DIGEST):
            above = self.stack[-1].skeleton
            at = self.skeleton.children[above].get(path[i:i + DIGEST], -1) if above >= 0 else -1
            self.stack.append(_Node(at, sizes[i // DIGEST]))
        self.path, top = path, self.stack[-1]
        top.n += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        text = b"%d" % conv_id
        if top.skeleton >= 0:
            top.ends = text if top.ends is None else top.ends + b"," + text
            if len(top.ends) >= CHUNK:
                self._send(top)
        elif top.ends is None:
            top.ends = hashlib.sha256(text)
        else:
            top.ends.update(b"," + text)

    def _send(self, node: _Node) -> None:
        self.rows.append((_CHUNK, *(None,) * 10, node.skeleton, self.shard, node.seq, node.ends))
        node.ends, node.seq = None, node.seq + 1

    def _close(self) -> None:
        node = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        if up:
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
        if node.skeleton >= 0:
            if node.ends is not None:
                self._send(node)
            self.rows.append((_PARTIAL, node.least, None, None, None, node.n, node.children, node.leaves, node.saved, None,
                              node.size, node.skeleton, self.shard, None, None))
            return
        self.rows.extend((*r[:3], node.least, False, *r[5:]) for r in node.waiting)
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        ends = node.ends.hexdigest() if node.ends else None
        row = (_NODE, node.least, len(self.stack), up.skeleton, True, node.n, node.children, leaves, saved, ends, *(None,) * 5)
        if up.skeleton >= 0:
            self.rows.append(row)
        else:
            up.waiting.append(row)

    def end(self) -> None:
        while self.stack:
            self._close()


def _shards(paths: DataFrame, borders: list[tuple[bytes, int]]) -> DataFrame:
    """Finished nodes, partial aggregates and chunks of ends of all shards."""
    spark = paths.sparkSession
    keys = spark.sparkContext.broadcast(borders)
    shared = spark.sparkContext.broadcast(Skeleton([p for p, _ in borders]))
    schema = pa.schema([("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("up", pa.int64()), ("up_skeleton", pa.bool_()),
                        ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                        ("ends_sha256", pa.string()), ("last_bytes", pa.int64()), ("skeleton", pa.int64()), ("shard", pa.int32()),
                        ("seq", pa.int64()), ("chunk", pa.binary())])

    def deal(batches):
        for batch in batches:
            at = [bisect_right(keys.value, key) for key in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield batch.append_column("shard", pa.array(at, pa.int32()))

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def finish(batches):
        walk, rows = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "path", "conv_id", "sizes")]
            for i in range(len(batch)):
                shard, path, conv_id, sizes = (c[i].as_py() for c in columns)
                if walk is None or walk.shard != shard:
                    if walk:
                        walk.end()
                    walk = _Walk(shared.value, shard, rows)
                walk.add(path, conv_id, sizes)
                if len(rows) >= ROWS_OUT:
                    yield packed(rows)
                    rows.clear()
        if walk:
            walk.end()
        if rows:
            yield packed(rows)

    dealt = paths.mapInArrow(deal, "conv_id long, path binary, sizes array<long>, shard int")
    dealt = dealt.repartitionById(len(borders) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    return dealt.mapInArrow(finish, _OUT)


def _ends(chunks: DataFrame) -> DataFrame:
    """``skeleton, ends_sha256``: chunks hashed in order, one at a time."""
    def digest(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for key, chunk in zip(batch.column("skeleton").to_pylist(), batch.column("chunk")):
                if key != at:
                    if state:
                        done.append((at, state.hexdigest()))
                    at, state = key, hashlib.sha256(chunk.as_py())
                else:
                    state.update(b"," + chunk.as_py())
            yield pa.RecordBatch.from_pydict({"skeleton": pa.array([d[0] for d in done], pa.int64()), "ends_sha256": pa.array([d[1] for d in done], pa.string())})
        if state:
            yield pa.RecordBatch.from_pydict({"skeleton": pa.array([at], pa.int64()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})

    rows = chunks.select("skeleton", "shard", "seq", "chunk").repartition("skeleton").sortWithinPartitions("skeleton", "shard", "seq")
    return rows.mapInArrow(digest, "skeleton long, ends_sha256 string")


NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations.

    ``conv_id`` is the smallest member, ``depth`` the number of turns, ``parent_conv_id`` the smallest
    member of the parent (root: null), ``n_convs`` members, ``n_children`` children, ``n_leaves``
    childless nodes of the subtree, ``saved_tokens`` bytes of last texts not stored again in the
    subtree, ``ends_sha256`` hash of the ids of the members that end here.
    """
    spark = conversations.sparkSession
    paths = materialize(rebuilt_paths(conversations))
    length = F.length("path")
    n_rows, n_bytes, longest = paths.agg(F.count(F.lit(1)), F.sum(length), F.max(length)).first()
    if not n_rows:
        return spark.createDataFrame([], NODES)
    borders = splitters(paths, n_rows, n_bytes, longest)
    skeleton = Skeleton([p for p, _ in borders])
    parts = materialize(_shards(paths, borders))
    # At most one row per node of the skeleton, which SKELETON_BYTES bounds.
    sums = parts.where(F.col("kind") == _PARTIAL).groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("last_bytes").alias("last_bytes")).collect()
    by_node = {r["skeleton"]: r for r in sums}
    size = len(skeleton.parent)
    leaves = [by_node[s]["n_leaves"] for s in range(size)]
    saved = [by_node[s]["saved_tokens"] + (by_node[s]["n_convs"] - 1) * by_node[s]["last_bytes"] for s in range(size)]
    below = [by_node[s]["n_children"] + len(skeleton.children[s]) for s in range(size)]
    for s in range(size - 1, -1, -1):
        leaves[s] = leaves[s] or 1
        if s:
            leaves[skeleton.parent[s]] += leaves[s]
            saved[skeleton.parent[s]] += saved[s]
    kept = pa.table({
        "skeleton": pa.array(range(size), pa.int64()), "conv_id": pa.array([by_node[s]["conv_id"] for s in range(size)], pa.int64()),
        "depth": pa.array(skeleton.depth, pa.int64()),
        "parent_conv_id": pa.array([by_node[p]["conv_id"] if p >= 0 else None for p in skeleton.parent], pa.int64()),
        "n_convs": pa.array([by_node[s]["n_convs"] for s in range(size)], pa.int64()), "n_children": pa.array(below, pa.int64()),
        "n_leaves": pa.array(leaves, pa.int64()), "saved_tokens": pa.array(saved, pa.int64())})
    kept = spark.createDataFrame(kept)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    names = [f.split()[0] for f in NODES.split(", ")]
    top = kept.join(_ends(parts.where(F.col("kind") == _CHUNK)), "skeleton", "left")
    above = kept.select(F.col("skeleton").alias("up"), F.lit(True).alias("up_skeleton"), F.col("conv_id").alias("above"))
    rest = parts.where(F.col("kind") == _NODE).join(F.broadcast(above), ["up", "up_skeleton"], "left")  # bounded as the skeleton
    rest = rest.withColumn("parent_conv_id", F.when(F.col("up_skeleton"), F.col("above")).otherwise(F.col("up")))
    return top.select(names).unionByName(rest.select(names)).withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))


#: CRC-32 is spelled out, bit by bit for its table and byte by byte for the ids: the engine has no such function.
ORACLE = """
WITH RECURSIVE steps AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT i, v FROM steps WHERE k = 8),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, sha256(strlen(role)::VARCHAR || ':' || role || text)[:32] AS digest, strlen(text) AS size,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text[:32], digest) AS k FROM t),
digits AS (SELECT DISTINCT conv_id, unnest(string_split(conv_id::VARCHAR, '')) AS c, generate_subscripts(string_split(conv_id::VARCHAR, ''), 1) AS j FROM (SELECT DISTINCT conv_id FROM t)),
walk AS (SELECT conv_id, 0::BIGINT AS j, 4294967295::BIGINT AS v FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL SELECT w.conv_id, w.j + 1, xor(crc.v, w.v >> 8) FROM walk w JOIN digits d ON d.conv_id = w.conv_id AND d.j = w.j + 1
  JOIN crc ON crc.i = xor(w.v, ord(d.c)::BIGINT) & 255),
ids AS (SELECT conv_id, xor(4294967295, arg_max(v, j)) % 9 AS h FROM walk GROUP BY conv_id),
turns AS (SELECT ids.conv_id, 0 AS part, k, digest, size FROM ids JOIN own ON own.conv_id = ids.conv_id - ids.conv_id % 5 AND k <= h
  UNION ALL SELECT ids.conv_id, 1, k, digest, size FROM ids JOIN own ON own.conv_id = ids.conv_id AND k > h),
paths AS (SELECT conv_id, list(digest ORDER BY part, k) FILTER (digest IS NOT NULL) AS p, list(size ORDER BY part, k) FILTER (digest IS NOT NULL) AS s FROM ids LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
full_paths AS (SELECT conv_id, coalesce(p, []) AS p, coalesce(s, []) AS s, len(coalesce(p, [])) AS n FROM paths),
members AS (SELECT conv_id, p[:d] AS node, d, p[:d - 1] AS up, CASE WHEN d = 0 THEN 0 ELSE s[d] END AS size, d = n AS ends
  FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM full_paths)),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, any_value(up) AS up,
  sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM members GROUP BY node, d),
linked AS (SELECT n.*, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.node = n.up),
children AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up),
counted AS (SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c USING (node)),
subtree AS (SELECT node[:a] AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY 1)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN subtree USING (node)
"""
