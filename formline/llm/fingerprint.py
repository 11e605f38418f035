"""Homomorphic multiset fingerprints of documents, in built-in functions only.

The fingerprint of a text is the sum, modulo 2^32 per lane, of the wide vectors of
its paragraphs (the text split at line feeds). The vector of a paragraph has

* 8 lanes of 32 bits from the SHA-256 of the paragraph, for equality;
* one lane with its number of runs, a run being four words in a row, counted from
  the start of the paragraph (the last run may be shorter);
* 128 lanes that count, over its runs, the bits set in the run's MD5, for likeness.

Being a sum, it does not depend on the order of paragraphs; adding or subtracting
the vector of one paragraph inserts or deletes it (``insert``, ``delete``). With
signs (set bits count +1, others -1), the inner product of two fingerprints estimates
how many runs two texts share, and their likeness is 2ab / (aa + bb) within [0, 1];
its standard error is below 0.09.

The edited text replaces the last ``floor(n / 2)`` code points of a text by the first
as many of the next document in ascending id (after the last: the first). Ids and
lengths alone are ordered; texts are shuffled once, and the prefix that the document
before needs once more. Counts are added up where that shuffle left the document.

Defined cases: a null text is empty (one empty paragraph, no runs); two texts without
runs are alike (1) only if their fingerprints are equal, else 0; a null id sorts
first; where an id repeats, the row whose text has the least hash is the "next
document" of the id before it, and every row is returned; a table of one document
is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import NULL_ID, id_and_text
from formline.session import materialize

WIDE, WORDS, LANE = 8, 4, 2 ** 32
#: Ids are ordered within this many ranges, so no task orders all of them.
RANGES = 4096
RUN = r"[^ \t\r\f\x0B]+(?:[ \t\r\f\x0B]+[^ \t\r\f\x0B]+){0,3}"


def hex_word(text: Column, i: int) -> Column:
    """The ``i``-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(text, 1 + 8 * i, 8), 16, 10).cast("long")


def neighbours(docs: DataFrame) -> DataFrame:
    """Per id: ``next_id``, ``prev_id``, ``need`` (code points the previous one takes) and ``least`` (hash)."""
    ids = docs.groupBy("id").agg(F.max(F.length("text")).alias("n"), F.min(F.xxhash64("text")).alias("least"))
    edge = docs.agg(F.min("id").alias("low"), F.max("id").alias("high"))
    span = F.col("high").cast("double") - F.col("low").cast("double") + 1
    # One row, so the broadcast has a fixed size.
    ids = ids.join(F.broadcast(edge)).withColumn(
        "range", F.least(F.lit(RANGES - 1), F.floor((F.col("id").cast("double") - F.col("low").cast("double")) / span * RANGES)))
    heads = ids.groupBy("range", "low", "high").agg(F.min("id").alias("first"), F.max_by("id", "id").alias("last"),
                                                    F.max_by("n", "id").alias("last_n"))
    over = Window.orderBy("range")  # at most RANGES rows
    everything = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        "range", F.coalesce(F.lead("first").over(over), F.col("low")).alias("after"),
        F.coalesce(F.lag("last").over(over), F.col("high")).alias("before"),
        F.coalesce(F.lag("last_n").over(over), F.last("last_n").over(everything)).alias("before_n"))
    inside = Window.partitionBy("range").orderBy("id")
    return ids.join(F.broadcast(heads), "range").select(
        "id", "least", F.coalesce(F.lead("id").over(inside), F.col("after")).alias("next_id"),
        F.coalesce(F.lag("id").over(inside), F.col("before")).alias("prev_id"),
        F.floor(F.coalesce(F.lag("n").over(inside), F.col("before_n")) / 2).cast("int").alias("need"))


def with_edited(docs: DataFrame) -> DataFrame:
    """``id, doc_id, text, n_chars, edited, next_id, prev_id, stands`` (for its id), a row per row."""
    # Both uses of the shuffled texts read the same two columns, so that shuffle is made once.
    docs = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text")
    linked = docs.join(materialize(neighbours(docs)), "id").withColumn("stands", F.xxhash64("text") == F.col("least"))
    prefix = F.when(F.col("stands"), F.left(F.col("text"), F.col("need")))  # a filter would become a join key
    first = linked.groupBy(F.col("prev_id").alias("id")).agg(F.min(prefix).alias("first"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    return linked.join(first, "id").select(
        "id", F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "text", n.cast("long").alias("n_chars"), "next_id", "prev_id", "stands",
        F.concat(F.left(F.col("text"), n - half), F.left(F.col("first"), half)).alias("edited"))


def fingerprints(texts: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """``keys``, ``rows`` (how many share them) and ``lanes``, an array of longs below 2^32.

    ``keys`` must determine the text.
    """
    paragraphs = texts.select(*keys, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("nth", "p")).select(
        *keys, "nth", F.sha2("p", 256).alias("sha"), F.regexp_extract_all("p", F.lit(RUN), F.lit(0)).alias("runs"))
    runs = paragraphs.select(*keys, "nth", "sha", F.posexplode_outer("runs").alias("at", "run"))
    start = F.coalesce(F.col("at"), F.lit(0)) == 0
    runs = runs.select(*keys, "sha", "run", start.alias("start"), (start & (F.col("nth") == 0)).cast("long").alias("row"),
                       F.md5("run").alias("md5"))
    words = [hex_word(F.col("md5"), j) for j in range(WORDS)]
    # Two lanes share a long: bit i of the low half, and bit i of the high half moved to bit 32 + i.
    words = [w.bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.shiftleft(w.bitwiseAND(F.lit(0xFFFF0000)), 16)).alias(f"w{j}")
             for j, w in enumerate(words)]
    runs = runs.select(*keys, "sha", "run", "start", "row", *words)
    both = F.lit(0x0000000100000001)
    sums = [F.sum(F.when(F.col("start"), hex_word(F.col("sha"), i))).alias(f"s{i}") for i in range(WIDE)]
    bits = [F.coalesce(F.sum(F.shiftright(F.col(f"w{j}"), i).bitwiseAND(both)), F.lit(0)).alias(f"b{j}_{i}")
            for j in range(WORDS) for i in range(16)]
    added = runs.groupBy(*keys).agg(F.sum("row").alias("rows"), F.count("run").alias("n"), *sums, *bits)
    lanes = [F.col(f"s{i}") for i in range(WIDE)] + [F.col("n")]
    for j in range(WORDS):
        lanes += [F.col(f"b{j}_{i}").bitwiseAND(F.lit(LANE - 1)) for i in range(16)]
        lanes += [F.shiftright(F.col(f"b{j}_{i}"), 32) for i in range(16)]
    return added.select(*keys, "rows", F.array(*lanes).alias("sums")).select(
        *keys, "rows", F.expr(f"transform(sums, x -> pmod(x div rows, {LANE}L))").alias("lanes"))


COUNTS = 1 + 32 * WORDS  # runs, and set bits per place


def packed(lanes: str) -> Column:
    """The lanes in fewer longs, if all counts are below 2^16; as they are, otherwise."""
    pair = f"shiftleft({lanes}[2 * k], 32) | {lanes}[2 * k + 1]"
    four = " | ".join(f"shiftleft(coalesce(get({lanes}, {WIDE + j} + 4 * k), 0L), {16 * j})" for j in range(4))
    return F.expr(f"""CASE WHEN exists(slice({lanes}, {WIDE + 1}, {COUNTS}), x -> x >= 65536) THEN {lanes} ELSE
        concat(transform(sequence(0, {WIDE // 2 - 1}), k -> {pair}), transform(sequence(0, {COUNTS // 4}), k -> {four})) END""")


def unpacked(p: str) -> Column:
    wide = f"shiftrightunsigned({p}[CAST(k div 2 AS INT)], 32 - 32 * (k % 2)) & {LANE - 1}L"
    count = f"shiftright({p}[{WIDE // 2} + CAST(k div 4 AS INT)], 16 * (k % 4)) & 65535L"
    return F.expr(f"""CASE WHEN size({p}) = {WIDE + COUNTS} THEN {p} ELSE
        concat(transform(sequence(0, {WIDE - 1}), k -> {wide}), transform(sequence(0, {COUNTS - 1}), k -> {count})) END""")


def insert(lanes: Column, paragraph: Column) -> Column:
    """Lanes of the text with one more paragraph, given that paragraph's lanes."""
    return F.zip_with(lanes, paragraph, lambda a, b: F.pmod(a + b, F.lit(LANE)))


def delete(lanes: Column, paragraph: Column) -> Column:
    """Lanes of the text without one of its paragraphs."""
    return F.zip_with(lanes, paragraph, lambda a, b: F.pmod(a - b, F.lit(LANE)))


def as_text(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common runs of two fingerprints, within [0, 1]."""
    def signed(lanes: Column) -> Column:
        n = lanes[WIDE].cast("double")
        return F.transform(F.slice(lanes, WIDE + 2, 32 * WORDS), lambda c: 2 * c.cast("double") - n)

    def inner(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(signed(x), signed(y), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    total = inner(a, a) + inner(b, b)
    estimate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * inner(a, b) / total))
    return F.when(a == b, F.lit(1.0)).when(total > 0, estimate).otherwise(F.lit(0.0))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next text."""
    rows = with_edited(id_and_text(docs, id_col, text_col))
    keys = ["id", "doc_id", "n_chars", "edited_sha256", "next_id", "prev_id", "stands", "k1", "k2"]
    rows = rows.select("text", "edited", *keys[:3], F.sha2("edited", 256).alias("edited_sha256"), *keys[4:7],
                       F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    texts = rows.select(*keys, F.explode(F.array(F.struct(F.lit(False).alias("of_edited"), F.col("text")),
                                                 F.struct(F.lit(True).alias("of_edited"), F.coalesce("edited", F.lit("")).alias("text")))).alias("t"))
    texts = texts.select(*keys, "t.of_edited", "t.text")
    each = fingerprints(texts, "text", [*keys, "of_edited"])
    pair = each.groupBy(*keys).agg(
        F.first("rows").alias("rows"), *(F.max(F.when(F.col("of_edited") == flag, F.col("lanes"))).alias(name)
                                         for name, flag in (("lanes", False), ("edited_lanes", True))))
    pair = materialize(pair.withColumns({c: packed(c) for c in ("lanes", "edited_lanes")}).drop("next_id", "k1", "k2"))
    after = pair.where("stands").select(F.col("prev_id").alias("id"), F.col("lanes").alias("next_lanes"))
    both = pair.drop("prev_id", "stands").join(after, "id")
    out = both.withColumns({c: unpacked(c) for c in ("lanes", "edited_lanes", "next_lanes")}).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"), "rows")
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows")


def _oracle() -> str:
    wide = ", ".join(f"sum(('0x' || substr(sha256(p), {1 + 8 * i}, 8))::BIGINT) % {LANE} AS s{i}" for i in range(WIDE))
    bits = ", ".join(f"sum((('0x' || substr(m, {1 + 8 * j}, 8))::BIGINT >> {i}) & 1) AS b{j}_{i}"
                     for j in range(WORDS) for i in range(32))
    bit_list = ", ".join(f"coalesce(b{j}_{i}, 0)" for j in range(WORDS) for i in range(32))
    wide_list = ", ".join(f"s{i}" for i in range(WIDE))
    run = RUN.replace("\\x0B", "\\v")

    def inner(a: str, b: str) -> str:
        x, y = (f"list_transform({v}[{WIDE + 2}:], lambda c: 2 * c::DOUBLE - {v}[{WIDE + 1}]::DOUBLE)" for v in (a, b))
        return f"list_inner_product({x}, {y})"

    def like(a: str, b: str) -> str:
        total = f"({inner(a, a)} + {inner(b, b)})"
        return (f"CASE WHEN {a} = {b} THEN 1.0 WHEN {total} > 0 THEN "
                f"greatest(0.0, least(1.0, 2 * {inner(a, b)} / {total})) ELSE 0.0 END")

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx,
        coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
e AS (SELECT *, left(t, n - n // 2) || left(nx, n // 2) AS e FROM o),
u AS (SELECT doc_id, false AS ed, t AS x FROM e UNION ALL SELECT doc_id, true, e FROM e),
p AS (SELECT doc_id, ed, unnest(string_split(x, chr(10))) AS p FROM u),
w AS (SELECT doc_id, ed, {wide} FROM p GROUP BY doc_id, ed),
r AS (SELECT doc_id, ed, md5(unnest(regexp_extract_all(p, '{run}'))) AS m FROM p),
b AS (SELECT doc_id, ed, count(*) AS c, {bits} FROM r GROUP BY doc_id, ed),
l AS (SELECT w.doc_id, w.ed, list_transform([{wide_list}, coalesce(c, 0), {bit_list}], lambda z: z::BIGINT) AS v
      FROM w LEFT JOIN b ON w.doc_id = b.doc_id AND w.ed = b.ed),
f AS (SELECT *, array_to_string(list_transform(v, lambda z: lpad(lower(to_hex(z)), 8, '0')), '') AS s FROM l)
SELECT e.doc_id, e.n AS n_chars, sha256(e.e) AS edited_sha256, a.s AS fingerprint, b.s AS edited_fingerprint,
  {like('a.v', 'b.v')} AS near_edited, {like('a.v', 'c.v')} AS near_next
FROM e JOIN f a ON a.doc_id = e.doc_id AND NOT a.ed JOIN f b ON b.doc_id = e.doc_id AND b.ed
JOIN f c ON c.doc_id = e.next_id AND NOT c.ed
"""


ORACLE = _oracle()
