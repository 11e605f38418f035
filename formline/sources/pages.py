"""Scores mentioned in web pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from formline import constants as K
from formline.functions import text as T
from formline.operators.entities import normalize_names

# --- Fixed values: match containers and score mentions -------------------------
CONTAINER_TAGS = {"div", "article", "section"}
CONTAINER_CLASS = r"(?i)match|partido|fixture|result"
#: White space of any script, where ``\\s`` alone means ASCII.
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
MENTION = rf"(.+?){SPACE}+(\d+){SPACE}*[-:]{SPACE}*(\d+){SPACE}+(.+)"
HINT = r"\s\d+\s*[-:]\s*\d+\s"
MIN_NAME = 3
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT_TAGS = {"script", "style", "template"}


class _Texts(HTMLParser):
    """Texts of match containers (nested ones too) and all single text nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.boxes, self.nodes, self.pending = [], [], [], []

    def _flush(self):
        node, self.pending = "".join(self.pending), []
        if not node:
            return
        self.nodes.append(node)
        if node.strip() and not any(tag in SILENT_TAGS for tag, _ in self.open):
            for _, box in self.open:
                if box is not None:
                    self.boxes[box].append(node.strip())

    def handle_starttag(self, tag, attrs):
        self._flush()
        box = None
        if tag in CONTAINER_TAGS and re.search(CONTAINER_CLASS, dict(attrs).get("class") or ""):
            box = len(self.boxes)
            self.boxes.append([])
        if tag not in VOID_TAGS:
            self.open.append((tag, box))

    def handle_startendtag(self, tag, attrs):
        self._flush()

    def handle_endtag(self, tag):
        self._flush()
        at = max((i for i, (t, _) in enumerate(self.open) if t == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()
        self.nodes.append(data)

    def texts(self, html: str) -> dict:
        self.feed(html)
        self.close()
        self._flush()
        return {"boxes": [" ".join(b) for b in self.boxes], "nodes": [n for n in self.nodes if re.search(HINT, n)]}


_TEXTS = T_.StructType([T_.StructField(n, T_.ArrayType(T_.StringType())) for n in ("boxes", "nodes")])


@F.pandas_udf(_TEXTS)
def _page_texts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_Texts().texts(h) for h in html], columns=["boxes", "nodes"])


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def page_scores(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Score mentions per page: those in match containers, or, where a page has
    none, those in its text nodes without a skip word.

    Every page is read as markup: tags, references and stray signs may stand between
    the parts of a score, so no test of the raw text is free of losses. Both passes
    stay inside the page's row, so the fallback needs no join.
    """
    texts = pages.filter(F.col(html).isNotNull()).select(key, _page_texts(html).alias("_p"))

    def parts(text: Column, boxed: bool) -> Column:
        def name(group: int) -> Column:
            found = _strip(F.regexp_extract(text, MENTION, group))
            return F.regexp_replace(found, rf"{SPACE}*\(.*?\){SPACE}*$", "") if boxed else found
        return F.struct(
            name(1).alias("Home"), name(4).alias("Away"),
            F.regexp_extract(text, MENTION, 2).try_cast("int").alias("Home_Score"),
            F.regexp_extract(text, MENTION, 3).try_cast("int").alias("Away_Score"),
            F.lit("container" if boxed else "text").alias("source"))

    def named(hit: Column) -> Column:
        return (F.length(hit["Home"]) >= MIN_NAME) & (F.length(hit["Away"]) >= MIN_NAME)

    def clean(hit: Column) -> Column:
        return named(hit) & ~T.has_any(hit["Home"], K.SCORE_SKIP_WORDS) & ~T.has_any(hit["Away"], K.SCORE_SKIP_WORDS)

    def mentions(field: str, boxed: bool, keep) -> Column:
        scored = F.filter(F.col("_p")[field], lambda x: x.rlike(MENTION))
        return F.filter(F.transform(scored, lambda x: parts(x, boxed)), keep)

    hits = texts.select(key, mentions("boxes", True, named).alias("_boxed"), mentions("nodes", False, clean).alias("_loose"))
    return hits.select(key, F.inline_outer(F.when(F.size("_boxed") > 0, F.col("_boxed")).otherwise(F.col("_loose")))
                       ).filter(F.col("source").isNotNull())


def with_teams(scored: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Add ``Home_Team`` and ``Away_Team``: the names as a history spells them, by the glossary and the built-in aliases."""
    for side in ("Home", "Away"):
        scored = normalize_names(scored, side, f"{side}_Team", glossary)
    return scored


def blocked_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Per host: pages and those showing an access challenge."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1))
    return (pages.select(host.alias("host"), T.blocked_page(F.col(html)).alias("blocked"))
            .groupBy("host").agg(F.count(F.lit(1)).alias("pages"),
                                 F.sum(F.col("blocked").cast("long")).alias("blocked_pages")))
