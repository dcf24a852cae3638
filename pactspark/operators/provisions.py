"""Provisions inside a clause, and their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.functions import text as T
from pactspark.functions.text import bind, match_spans

# Fixed values.
MARKER = r"(?i)(?:Section|Sec\.|Article|Clause)\s+(?:\d+(?:\.\d+)*|[IVXLCDM]+)"
CITED_BEFORE = (
    r"(?i)(?:this|that|these|those|such|said|in|under|of|to|per|see|with|within|pursuant|herein|hereunder|hereof|hereto|and|or|preceding|foregoing|"
    r"including|provided|except|under\s+this|of\s+this)\s*$"
)
CITED_AFTER = r"(?i)^\s*(?:\[[^\]]*\]\s*)?(?:hereof|hereto|herein|above|below|and\b|or\b|through\b|of\s+this|,)"
CUE_WIDTH, SHORTEST_BODY, LEAST_INTRO, LEAST_PIECE = 48, 200, 5, 40
MARKER_HEAD = r"(?i)^((?:Section|Sec\.|Article|Clause)\s+(?:\d+(?:\.\d+)*|[IVXLCDM]+))\s*(?:\[([^\]]*)\])?\.?\s*"
TITLE = r"^([A-Z][^.\n]{0,60}?)\."
# End of the fixed values.


def _part(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def is_provision_start(body: Column, start: Column, end: Column) -> Column:
    """Whether a marker at [start, end) opens a provision and isn't a citation."""
    before = _part(body, F.greatest(start - CUE_WIDTH, F.lit(0)), start)
    after = F.substring(body, end + 1, F.lit(CUE_WIDTH))
    return ~before.rlike(CITED_BEFORE) & ~after.rlike(CITED_AFTER)


def carve_heading(text: Column) -> Column:
    """``Section 3.01 — Title`` of a text that begins with a marker: the title in brackets, else a short phrase up to a full stop, else the marker alone; null without a marker."""
    marker, bracket = (F.regexp_extract(text, MARKER_HEAD, i) for i in (1, 2))
    rest = F.substring(text, F.length(F.regexp_extract(text, MARKER_HEAD, 0)) + 1, F.length(text))
    title = F.regexp_extract(rest, TITLE, 1)
    named = lambda x: F.concat(F.trim(marker), F.lit(" — "), F.trim(x))
    return F.when(marker != "", F.when(F.trim(bracket) != "", named(bracket)).when((title != "") & (F.size(T.words(title)) <= 9), named(title)).otherwise(F.trim(marker)))


def provisions(heading: Column, body: Column) -> Column:
    """array<struct<heading, body>> of a clause: one for each provision if two or more markers open one, else null.

    An introduction of five words or more keeps the clause's heading; pieces under 40 characters join the piece before.
    """
    kind = "array<struct<heading: string, body: string>>"

    def pieces(text: Column, starts: Column) -> Column:
        bounds = F.concat(starts, F.array(F.length(text)))
        cut = bind(bounds, lambda at: F.transform(F.sequence(F.lit(1), F.size(starts)), lambda i: F.trim(_part(text, F.get(at, i - 1), F.get(at, i)))))
        made = F.transform(F.filter(cut, lambda x: x != ""), lambda x: F.struct(F.coalesce(carve_heading(x), heading).alias("heading"), x.alias("body")))
        intro = F.filter(F.array(F.trim(_part(text, F.lit(0), F.get(starts, 0)))), lambda x: F.size(T.words(x)) >= LEAST_INTRO)
        return F.concat(F.transform(intro, lambda x: F.struct(heading.alias("heading"), x.alias("body"))), made)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["heading"].alias("heading"), F.concat_ws(" ", last["body"], x["body"]).alias("body"))
        return F.when((F.size(acc) > 0) & (F.length(x["body"]) < LEAST_PIECE), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x))).cast(kind)

    def split(text: Column, starts: Column) -> Column:
        merged = F.aggregate(pieces(text, starts), F.array().cast(kind), step)
        return F.when(F.size(starts) >= 2, bind(merged, lambda m: F.when(F.size(m) >= 2, m)))

    def of(text: Column) -> Column:
        starts = F.transform(F.filter(match_spans(text, MARKER), lambda m: is_provision_start(text, m["start"], m["end"])), lambda m: m["start"])
        return F.when(F.length(text) >= SHORTEST_BODY, bind(starts, lambda at: split(text, at)))

    return bind(body, of)


def split_provisions(clauses: DataFrame) -> DataFrame:
    """Clauses (chunk_type, heading, body, level, ...) with those of several provisions replaced by one row for each, a level below.

    ``piece`` numbers a clause's rows from 0. Only rows of type CLAUSE are split; a null body stays as it is. No exchange.
    """
    found = F.when(F.col("chunk_type") == "CLAUSE", provisions(F.col("heading"), F.col("body")))
    below = lambda parts, levels: F.transform(parts, lambda p: F.struct(p["heading"].alias("heading"), p["body"].alias("body"), F.lit(levels).alias("below")))
    whole = F.array(F.struct(F.col("heading").alias("heading"), F.col("body").alias("body")))
    parts = bind(found, lambda f: F.when(f.isNotNull(), below(f, 1)).otherwise(below(whole, 0)))
    keep = [c for c in clauses.columns if c not in ("heading", "body", "level")]
    # There is always a part: the outer form only keeps Spark from filtering by, and so computing, the parts twice more.
    each = clauses.select(*keep, "level", F.posexplode_outer(parts).alias("piece", "part"))
    return each.select(*keep, F.col("part.heading").alias("heading"), F.col("part.body").alias("body"), (F.col("level") + F.col("part.below")).alias("level"), "piece")
