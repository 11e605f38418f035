"""Secrets in documents: patterns, and sliding-window entropy, in built-in functions only.

Base patterns are matched leftmost and without overlap, one kind after the other:
assignments to password-like names, access keys, and long lower-case hexadecimal.
The places of matches follow from the lengths of the text between them, so a text is
only walked by the pattern itself, and everything happens within its row.

The method adds candidates: runs of ``[A-Za-z0-9+/_=-]`` of at least 20 characters.
Each has a class by its characters (hexadecimal, letters and digits, base 64), and a
window of 20 characters slides over it. The counts of the characters in the window
change by one in and one out at each step, and with them the sum of c log2 c, kept
as whole millionths; the entropy is log2 20 less a twentieth of that sum. A candidate
is a secret if any window reaches the threshold of its class, unless the allow-list
takes it out: words and joined words, numbers, UUIDs, paths, place holders, and what
already lies within a base span.

Defined cases: a null or empty text has no spans; spans are in code points, end
exclusive, sorted by start, then kind as listed; kinds may overlap each other; null and
repeated ids are kept as rows; an empty table gives an empty result; columns that are
not named are ignored unless carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import carried, id_and_text

# The base patterns and their least lengths.
NAMES = "password|passwd|secret|token|api_?key"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"


def either_case(names: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names)


ASSIGN = rf"({either_case(NAMES)})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
WINDOW, UNIT = 20, 1_000_000
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Entropy in bits that a window must reach, by class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.8, "base64": 3.9}
#: What a candidate of a class looks like, the first that fits.
CLASSES = {"hex": "^([0-9a-f]+|[0-9A-F]+)$", "alnum": "^[A-Za-z0-9]+$", "base64": "^.*$"}
#: Candidates that are no secrets.
ALLOWED = ("^[^0-9]*$", "^[0-9_=+/-]+$", "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
           "^/?([a-z]+[0-9]*[/_=-]+)+[a-z]*[0-9]*$", "^[a-z]+[0-9]{1,4}$", "^[A-Z]+[0-9]{1,4}$",
           "[eE][xX][aA][mM][pP][lL][eE]", "(xxxx|XXXX|----|====|____)")
#: The same as one of these for Java's matcher, which recurses into repeated groups: words of letters then digits
#: between separators, digits alone only at the end.
WITHOUT_REPEATED_GROUPS = {
    "^/?([a-z]+[0-9]*[/_=-]+)+[a-z]*[0-9]*$":
        "^(?!.*[0-9][a-z])(?!.*[/_=-][0-9]+[/_=-])/?[a-z]+[0-9]*[/_=-][a-z0-9/_=-]*$",
}


def weight(count: int) -> int:
    """``c log2 c`` in millionths."""
    return round(UNIT * count * math.log2(count)) if count else 0


def most(bits: float) -> int:
    """The largest sum of weights of a window whose entropy is at least ``bits``."""
    return math.floor(UNIT * WINDOW * (math.log2(WINDOW) - bits))


def found(pattern: str, keep: str = "true") -> str:
    """SQL for the spans of a pattern in ``text`` whose match ``m`` meets ``keep``."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"""CASE WHEN text RLIKE {p} THEN aggregate(
        zip_with(regexp_extract_all(text, {p}, 0), split(text, {p}, -1), (m, gap) -> struct(m AS m, gap AS gap)),
        CAST(struct(0 AS at, array() AS spans) AS STRUCT<at: INT, spans: ARRAY<STRUCT<start: INT, end: INT, match: STRING>>>),
        (acc, x) -> CASE WHEN x.m IS NULL THEN acc ELSE struct(
            acc.at + length(x.gap) + length(x.m) AS at,
            CASE WHEN {keep.replace('$m', 'x.m')} THEN concat(acc.spans, array(struct(
                acc.at + length(x.gap) AS start, acc.at + length(x.gap) + length(x.m) AS end, x.m AS match)))
            ELSE acc.spans END AS spans) END,
        acc -> acc.spans) END"""


def least_weight(candidate: str) -> str:
    """SQL for the least sum of weights of all windows of a candidate, by incremental counts."""
    table = "array(" + ", ".join(f"{weight(c)}L" for c in range(WINDOW + 1)) + ")"
    return f"""transform(array(transform(split({candidate}, ''), c -> instr('{ALPHABET}', c) - 1)), places -> aggregate(sequence(0, size(places) - 1),
        CAST(struct(array_repeat(0, {len(ALPHABET)}) AS counts, 0L AS total, {2 ** 40}L AS least)
             AS STRUCT<counts: ARRAY<INT>, total: BIGINT, least: BIGINT>),
        (acc, i) -> transform(array(struct(places[i] AS new, CASE WHEN i >= {WINDOW} THEN places[i - {WINDOW}] ELSE -1 END AS old)),
            e -> CASE WHEN e.new = e.old THEN acc ELSE transform(array(
                acc.total + {table}[acc.counts[e.new] + 1] - {table}[acc.counts[e.new]]
                + CASE WHEN e.old >= 0 THEN {table}[acc.counts[e.old] - 1] - {table}[acc.counts[e.old]] ELSE 0L END),
                total -> struct(
                    transform(acc.counts, (c, k) -> c + CASE WHEN k = e.new THEN 1 WHEN k = e.old THEN -1 ELSE 0 END) AS counts,
                    total AS total, CASE WHEN i >= {WINDOW - 1} THEN least(acc.least, total) ELSE acc.least END AS least))[0] END)[0],
        acc -> acc.least))[0]"""


def is_random(candidate: str) -> str:
    """SQL for whether a candidate's entropy makes it a secret."""
    limit = "CASE " + " ".join(f"WHEN {candidate} RLIKE '{CLASSES[c]}' THEN {most(bits)}L" for c, bits in THRESHOLDS.items()) + " END"
    allowed = " OR ".join(f"{candidate} RLIKE '{WITHOUT_REPEATED_GROUPS.get(p, p)}'" for p in ALLOWED)
    return f"NOT ({allowed}) AND {least_weight(candidate)} <= {limit}"


def ranked(spans: str, rank: int) -> str:
    return (f"coalesce(transform({spans}, s -> struct(s.start AS start, {rank} AS rank, s.end AS end)), "
            "CAST(array() AS ARRAY<STRUCT<start: INT, rank: INT, end: INT>>))")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry=()) -> DataFrame:
    """``doc_id, text, base, spans`` (arrays of start, rank of kind, end) and ``carried``, a row per row of ``docs``."""
    docs = id_and_text(docs, id_col, text_col, carry)
    keep = ["doc_id", "text", *carried(docs)]
    long_value = f"length(regexp_extract($m, '{ASSIGN}', 2)) >= {ASSIGN_VALUE}".replace("\\", "\\\\").replace("\"']?", "\"\\']?")
    docs = docs.select(*keep, F.expr(found(ASSIGN, long_value)).alias("s0"), F.expr(found(ACCESS)).alias("s1"),
                       F.expr(found(HEX)).alias("s2"), F.expr(found(CANDIDATE, is_random("$m"))).alias("s3"))
    base = F.array_sort(F.concat(*(F.expr(ranked(f"s{i}", i)) for i in range(3))))
    docs = docs.select(*keep, base.alias("base"), F.expr(ranked("s3", 3)).alias("more"))
    more = F.filter("more", lambda s: ~F.exists("base", lambda b: (b.start <= s.start) & (b["end"] >= s["end"])))
    return docs.select(*keep, "base", F.array_sort(F.concat(F.col("base"), more)).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(names[s.rank], F.lit(":"), s.start, F.lit(":"), s["end"])), ",")


def redacted(text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> Column:
    """The text with every stretch covered by spans replaced by ``mark``."""
    return F.expr(f"""CASE WHEN size({spans}) = 0 THEN {text} ELSE aggregate({spans}, struct(0 AS at, '' AS out),
        (acc, s) -> CASE WHEN s.start >= acc.at
            THEN struct(s.end AS at, concat(acc.out, substr({text}, acc.at + 1, s.start - acc.at), '{mark}') AS out)
            ELSE struct(greatest(acc.at, s.end) AS at, acc.out AS out) END,
        acc -> concat(acc.out, substr({text}, acc.at + 1))) END""")


def digest(docs: DataFrame) -> DataFrame:
    out = find_secrets(docs)
    counts = [F.expr(f"CAST(size(filter(base, s -> s.rank = {k})) AS BIGINT)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                      written(F.col("spans")).alias("spans"))


def _oracle() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for rank, (pattern, rule) in enumerate([
            (ASSIGN, f"length(regexp_extract(m, {q('^' + ASSIGN + '$')}, 2)) >= {ASSIGN_VALUE}"), (ACCESS, "true"), (HEX, "true"),
            (CANDIDATE, "NOT (" + " OR ".join(f"regexp_matches(m, {q(p)})" for p in ALLOWED) + ")")]):
        parts.append(f"""SELECT r, doc_id, {rank} AS rank, m,
            list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS s
            FROM (SELECT r, doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m FROM
                (SELECT r, doc_id, regexp_extract_all(t, {q(pattern)}) AS ms, string_split_regex(t, {q(pattern)}) AS gaps FROM d)) WHERE {rule}""")
    table = "[" + ", ".join(str(weight(c)) for c in range(WINDOW + 1)) + "]"
    limit = "CASE " + " ".join(f"WHEN regexp_matches(m, {q(CLASSES[c])}) THEN {most(b)}" for c, b in THRESHOLDS.items()) + " END"
    names = "[" + ", ".join(q(k) for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS ({' UNION ALL '.join(parts[:3])}), c AS ({parts[3]}),
w AS (SELECT r, doc_id, s, m, unnest(range(1, length(m) - {WINDOW - 2})) AS i FROM c),
h AS (SELECT r, doc_id, s, m, i, list_sum(list_transform(map_values(list_histogram(string_split(substr(m, i, {WINDOW}), ''))),
        lambda n: list_extract({table}, n::BIGINT + 1))) AS total FROM w),
e AS (SELECT r, doc_id, 3 AS rank, m, s FROM h GROUP BY r, doc_id, s, m HAVING min(total) <= any_value({limit})),
x AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = e.r AND b.s <= e.s AND b.s + length(b.m) >= e.s + length(e.m))),
o AS (SELECT r, rank, s::BIGINT AS s, {names}[rank + 1] || ':' || s::BIGINT || ':' || (s + length(m))::BIGINT AS w FROM (FROM b UNION ALL FROM x))
SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(w, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(w, ',' ORDER BY s, rank), '') AS spans
FROM d LEFT JOIN o USING (r) GROUP BY d.r, doc_id
"""


ORACLE = _oracle()
