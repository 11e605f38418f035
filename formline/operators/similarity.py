"""Nearest targets of names by a prefix-filtered similarity join.

A name is the set of its (character, occurrence) tokens, so the overlap of two sets is the number
of characters they share. Both measures here are at most the Dice ratio of these sets, so only
pairs of a high enough ratio are scored. Tokens are put in one order, rarest first: two sets of
ratio ``t`` or more share a token among the first ``size - ceil(size t/(2-t)) + 1`` of each, and
what they share there bounds the overlap. Names meet targets by an equi-join
on these prefixes, band by band from high ratios to low: a name with enough targets scored at a
band's ratio or better needs no lower band, whatever it does not meet scores less.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from formline.session import materialize

#: Ratios where bands end; the cutoff is the last.
BANDS = (0.6,)
#: Tokens that prefixes are longer than they must be.
EXTRA = 2
_ROUNDING = 1e-9


def edit_score(name: Column, target: Column) -> Column:
    """One minus the edits from one text to the other per character of the longer."""
    return F.lit(1.0) - F.levenshtein(name, target) / F.greatest(F.length(name), F.length(target))


@F.pandas_udf(DoubleType())
def block_score(names: pd.Series, targets: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, as the standard library's sequence matcher counts them."""
    matcher, last, out = difflib.SequenceMatcher(), None, []
    for name, target in zip(names, targets):
        if name != last:
            matcher.set_seq2(name)
            last = name
        matcher.set_seq1(target)
        out.append(matcher.ratio())
    return pd.Series(out, dtype=float)


MEASURES = {"edits": edit_score, "blocks": block_score}


def token_rows(texts: DataFrame) -> DataFrame:
    """``id, size, token`` of ``id, text``: one row per character, numbered among its like."""
    chars = texts.where(F.col("text") != "").select("id", F.length("text").alias("size"), F.explode(F.split("text", "")).alias("char"))
    counts = chars.groupBy("id", "size", "char").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counts.select("id", "size", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("n")), lambda i: F.concat_ws("\x00", "char", i.cast("string")))).alias("token"))


def rarest_first(tokens: DataFrame, frequency: DataFrame) -> DataFrame:
    """Adds ``key``, which sorts tokens rarest first, and ``place`` (from 1) in that order of its own text."""
    order = Window.partitionBy("id").orderBy("key")
    keyed = tokens.join(frequency, "token").withColumn("key", F.struct("freq", "token"))
    return keyed.withColumn("place", F.row_number().over(order)).select("id", "size", "token", "key", "place")


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``id, other`` of the pairs whose sets may have a Dice ratio of ``least`` or more: all that have, and few more.

    What two sets share beyond their prefixes follows the prefix that ends first, so shared tokens met and
    the rest of that set bound the overlap; ``EXTRA`` tokens longer prefixes make the bound sharper.
    """
    def prefix(rows: DataFrame) -> DataFrame:
        need = F.ceil(F.col("size") * (least / (2 - least)) - _ROUNDING)
        cut = F.least(F.col("size"), F.col("size") - need + 1 + EXTRA)
        return (rows.withColumn("cut", cut).where(F.col("place") <= F.col("cut"))
                .withColumn("end", F.max("key").over(Window.partitionBy("id"))))

    other = prefix(right).select("token", F.col("id").alias("other"), F.col("size").alias("size2"), F.col("cut").alias("cut2"), F.col("end").alias("end2"))
    fits = (F.col("size2") >= F.col("size") * (least / (2 - least)) - _ROUNDING) & (F.col("size2") <= F.col("size") * ((2 - least) / least) + _ROUNDING)
    met = prefix(left).join(other, "token").where(fits)
    rest = F.when(F.col("end") < F.col("end2"), F.col("size") - F.col("cut")).otherwise(F.col("size2") - F.col("cut2"))
    shared = met.groupBy("id", "other").agg(F.count(F.lit(1)).alias("met"), F.first(rest).alias("rest"), F.first(F.col("size") + F.col("size2")).alias("sizes"))
    return shared.where(F.col("met") + F.col("rest") >= F.col("sizes") * (least / 2) - _ROUNDING).select("id", "other")


def nearest_targets(names: DataFrame, targets: DataFrame, cutoff: float = 0.4, k: int = 3, measure: str = "edits") -> DataFrame:
    """``name, target, score, rank``: the ``k`` best targets of every name, scored ``cutoff`` or more.

    ``names`` (column ``name``) and ``targets`` (column ``target``) should be distinct and not empty.
    Ties go to the target last in code point order.
    """
    left = materialize(names.select("name").withColumn("id", F.monotonically_increasing_id()))
    right = materialize(targets.select("target").withColumn("id", F.monotonically_increasing_id()))
    raw = [token_rows(rows.select("id", F.col(c).alias("text"))) for rows, c in ((left, "name"), (right, "target"))]
    raw = [materialize(r) for r in raw]
    frequency = raw[0].select("token").unionByName(raw[1].select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    frequency = materialize(frequency)
    pending, index = (materialize(rarest_first(r, frequency)) for r in raw)
    named, aimed = left.select("id", "name"), right.select(F.col("id").alias("other"), "target")
    score, order = MEASURES[measure], Window.partitionBy("id").orderBy(F.desc("score"), F.desc("target"))
    out = None
    for least in [b for b in BANDS if b > cutoff] + [cutoff]:
        pairs = candidates(pending, index, least).join(named, "id").join(aimed, "other")
        pairs = pairs.withColumn("score", score(F.col("name"), F.col("target"))).where(F.col("score") >= cutoff)
        best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = materialize(best.select("id", "name", "target", "score", "rank"))
        if least > cutoff:
            settled = best.where((F.col("rank") == k) & (F.col("score") >= least)).select("id")
            pending = materialize(pending.join(settled, "id", "left_anti"))
            best = best.join(settled, "id", "left_semi")
        out = best if out is None else out.unionByName(best)
    return out.select("name", "target", "score", "rank")
