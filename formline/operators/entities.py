"""Entity resolution: glossary lookups, containment matches, audits.

Everything is an equi-join. Spark broadcasts a glossary when its measured size
allows, and otherwise shuffles and splits skewed names at run time. Costly
matches reduce their input to distinct names first, so a name held by a third of
the rows is matched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import text as T
from formline.operators.similarity import nearest_targets
from formline.session import materialize


def _by_name(df: DataFrame, resolved: DataFrame, column: str, out: str, default) -> DataFrame:
    """Join answers keyed by raw name back to all rows."""
    answers = resolved.select(F.col("_name").alias("_key"), F.col("_answer"))
    kept = [c for c in df.columns if c != out]
    return (df.join(answers, F.col(column).eqNullSafe(F.col("_key")), "left")
            .select(*kept, F.coalesce(F.col("_answer"), default).alias(out)))


def normalize_names(df: DataFrame, column: str, out: str, glossary: DataFrame | None = None) -> DataFrame:
    """Canonical spelling, then the user glossary, then the built-in aliases."""
    name = T.canonical(F.col(column))
    if glossary is None:
        return df.withColumn(out, F.coalesce(T.builtin_club(name), name))
    keys = glossary.select(F.col("variant").alias("_variant"), F.col("target").alias("_target"))
    df = df.withColumn("_canon", name).join(keys, F.col("_canon") == F.col("_variant"), "left")
    answer = F.coalesce("_target", T.builtin_club(F.col("_canon")), "_canon")
    return df.withColumn(out, answer).drop("_canon", "_variant", "_target")


GRAM = 3


def _grams(text: Column, q: int) -> Column:
    """All distinct pieces of ``q`` characters of a text."""
    def pieces(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(chars) - q)
        return F.array_distinct(F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(q)])))

    # The characters are bound once, so a long text is walked once.
    bound = F.transform(F.array(F.split(text, "")), pieces)
    return F.when(F.length(text) >= q, F.get(bound, F.lit(0)))


def contained_in(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """``pattern, text`` of all pairs where the pattern occurs in the text; both sides distinct.

    A pattern is looked up by one anchor, its piece of up to three characters that the fewest texts have; texts are
    indexed by all their pieces. Pairs that meet are verified. Work grows with the characters of the texts and
    the pairs that share a rare piece, never with pairs of all.
    """
    patterns = materialize(patterns.where(F.length("pattern") > 0))
    # Three values at most.
    widths = [r["q"] for r in patterns.select(F.least(F.length("pattern"), F.lit(GRAM)).alias("q")).distinct().collect()]
    out = None
    for q in sorted(widths):
        mine = patterns.where(F.length("pattern") == q if q < GRAM else F.length("pattern") >= q)
        index = materialize(texts.select("text", F.explode(_grams(F.col("text"), q)).alias("gram")))
        counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        anchors = mine.select("pattern", F.explode(_grams(F.col("pattern"), q)).alias("gram"))
        # A piece that no text has proves that its pattern occurs nowhere.
        anchors = anchors.join(counts, "gram", "left").groupBy("pattern").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
        anchors = anchors.where(F.col("best.n") > 0).select("pattern", F.col("best.gram").alias("gram"))
        met = anchors.join(index, "gram").where(F.contains("text", "pattern")).select("pattern", "text")
        out = met if out is None else out.unionByName(met)
    return patterns.select("pattern", F.lit("").alias("text")).limit(0) if out is None else out


def match_partial(df: DataFrame, column: str, glossary: DataFrame, out: str) -> DataFrame:
    """Exact glossary hit, else the first entry (file order) whose key contains
    the name or is contained in it, else the upper-cased name."""
    names = df.select(F.col(column).alias("_name")).filter(F.length(F.trim(column)) > 0).distinct()
    names = materialize(names.withColumn("_up", T.upper(F.trim("_name"))))
    keys = materialize(glossary.select("variant", "target", "ord").filter(F.length("variant") > 0))
    distinct_names, distinct_keys = names.select("_up").distinct(), keys.select("variant").distinct()
    exact = names.join(keys, F.col("_up") == F.col("variant")).select(
        "_name", F.lit(0).alias("_rank"), "ord", "target")
    inside = contained_in(distinct_keys.select(F.col("variant").alias("pattern")), distinct_names.select(F.col("_up").alias("text")))
    around = contained_in(distinct_names.select(F.col("_up").alias("pattern")), distinct_keys.select(F.col("variant").alias("text")))
    pairs = inside.select(F.col("text").alias("_up"), F.col("pattern").alias("variant")).unionByName(
        around.select(F.col("pattern").alias("_up"), F.col("text").alias("variant")))
    first = pairs.join(keys, "variant").groupBy("_up").agg(F.min(F.struct("ord", "target")).alias("_hit"))
    near = names.join(first, "_up").select("_name", F.lit(1).alias("_rank"), "_hit.ord", "_hit.target")
    best = (exact.unionByName(near)
            .groupBy("_name").agg(F.min(F.struct("_rank", "ord", "target")).alias("_best"))
            .select("_name", F.col("_best.target").alias("_answer")))
    return _by_name(df, best, column, out, T.upper(F.trim(F.col(column))))


def match_feed_label(df: DataFrame, column: str, out: str) -> DataFrame:
    """First fixed feed label contained in the name."""
    return df.withColumn(out, T.feed_club(F.col(column)))


CUTOFF = 0.4
SUGGESTIONS = 3


def audit_names(names: DataFrame, column: str, glossary: DataFrame, raw_targets: DataFrame, measure: str = "blocks") -> DataFrame:
    """Distinct names that resolve to no known target, each with its three
    closest targets (similarity at least 0.4, see ``similarity.MEASURES``)."""
    clean = (names.select(F.trim(column).alias("name"))
             .filter((F.col("name") != "") & ~F.col("name").startswith("#")).distinct())
    glossary = materialize(glossary)
    norm = normalize_names(clean, "name", "normalized", glossary)
    targets = materialize(raw_targets.select(F.col("target")).filter(F.col("target").isNotNull()).distinct())
    known = (targets.select(F.col("target").alias("_known"))
             .unionByName(glossary.select(F.col("target").alias("_known"))).distinct())
    canon = targets.select(T.canonical(F.col("target")).alias("_canon")).distinct()
    unmapped = materialize(norm.join(known, F.col("normalized") == F.col("_known"), "left_anti")
                           .withColumn("_canon", T.canonical(F.col("name")))
                           .join(canon, "_canon", "left_anti").select("name", "normalized"))
    hits = nearest_targets(unmapped, targets.filter(F.col("target") != ""), CUTOFF, SUGGESTIONS, measure)
    top = hits.groupBy("name").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda x: x["target"]).alias("suggestions"))
    return unmapped.join(top, "name", "left").withColumn(
        "suggestions", F.coalesce("suggestions", F.array().cast("array<string>")))


def unknown_teams(fixtures: DataFrame, history: DataFrame) -> DataFrame:
    """Teams in fixtures that never occur in the history."""
    def teams(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array("home", "away")).alias("team")).filter(F.col("team").isNotNull()).distinct()
    return teams(fixtures).join(teams(history), "team", "left_anti")


def map_headers(headers: DataFrame, column: str = "header") -> DataFrame:
    """Standard name of every raw header (null when unknown)."""
    return headers.withColumn("canonical", T.header_name(F.col(column)))


def apply_headers(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rename known columns; also the names left as they were."""
    from formline.constants import HEADER_NAMES
    spelled = {c: _plan_canonical(c) for c in df.columns}
    known = {c: HEADER_NAMES[s] for c, s in spelled.items() if s in HEADER_NAMES}
    return df.withColumnsRenamed(known), [c for c in df.columns if c not in known]


def _plan_canonical(name: str) -> str:
    """Canonical spelling of a column name, at plan time."""
    table = str.maketrans("-–—ÁÉÍÓÚÜÑ", "   AEIOUUN", ".")
    return " ".join(name.upper().translate(table).split())
