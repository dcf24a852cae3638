"""Entities by rule: amounts, dates, percentages and durations by pattern, known names by a phrase ruler, relations by modal.

A model's entities go through the same shapes (text, label, start, end, source); these are the defaults where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.functions import labels as L
from pactspark.functions.text import match_spans

#: Patterns by label.
RULES = {
    "MONEY": r"(?i)(?:\$|USD|EUR|GBP)\s?\d[\d,]*(?:\.\d+)?(?:\s(?:million|billion))?",
    "PERCENTAGE": r"\d+(?:\.\d+)?\s?(?:%|percent\b)",
    "DATE": r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}|\b\d{4}-\d{2}-\d{2}\b",
    "DURATION": r"(?i)\b(?:\d+|[a-z]+(?:-[a-z]+)?\s\(\d+\))\s(?:business\s)?(?:days?|weeks?|months?|years?)\b",
}
_KIND = "array<struct<text: string, label: string, start: int, `end`: int, source: string>>"
RELATION = r"(?i)^(.*?)\b(shall not|must not|may not|shall|must|will|may)\s+([a-z]+)\s+([^.;]+)"


def _named(text: Column, spans: Column, label: str | Column, source: str) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.transform(spans, lambda s: F.struct(F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), label.alias("label"), s["start"].alias("start"), s["end"].alias("end"), F.lit(source).alias("source"))).cast(_KIND)


def rule_entities(text: Column) -> Column:
    """array<struct<text, label, start, end, source>> of all matches of ``RULES``, by start and label; noise (see labels.entity_is_noise) is left out. Null text has none."""
    every = F.concat(*[_named(text, match_spans(text, p), label, "rule") for label, p in RULES.items()])
    kept = F.filter(every, lambda e: ~L.entity_is_noise(e["text"], e["label"]))
    ordered = F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["start"].alias("a"), e["label"].alias("b"), e.alias("e")))), lambda x: x["e"])
    return F.coalesce(ordered, F.array().cast(_KIND))


def phrase_entities(text: Column, names: Column, label: str = "PARTY") -> Column:
    """All places of known names in a text, whatever the case, longest name first; places inside a longer name's are left out."""
    kind = "array<struct<start: int, `end`: int>>"
    low = F.lower(text)
    ranked = F.array_sort(F.transform(F.array_distinct(F.filter(names, lambda n: n != "")), lambda n: F.struct((-F.length(n)).alias("minus"), F.lower(n).alias("n"))))

    def places(name: Column) -> Column:
        gaps = F.split(low, F.concat(F.lit(r"\Q"), name, F.lit(r"\E")), F.lit(-1))
        ends = F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda g, i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)) + i * F.length(name))
        return F.transform(ends, lambda s: F.struct(s.alias("start"), (s + F.length(name)).alias("end"))).cast(kind)

    def step(taken: Column, x: Column) -> Column:
        free = F.filter(places(x["n"]), lambda p: ~F.exists(taken, lambda q: (p["start"] < q["end"]) & (q["start"] < p["end"])))
        return F.concat(taken, free).cast(kind)

    found = F.array_sort(F.aggregate(ranked, F.array().cast(kind), step))
    return F.coalesce(_named(text, found, label, "ruler"), F.array().cast(_KIND))


def merge_entities(found: Column, ruled: Column) -> Column:
    """Ruled entities, and the found ones that overlap none of them, by start and end."""
    free = F.filter(found, lambda e: ~F.exists(ruled, lambda r: (e["start"] < r["end"]) & (r["start"] < e["end"])))
    both = F.concat(ruled, free)
    return F.transform(F.array_sort(F.transform(both, lambda e: F.struct(e["start"].alias("a"), e["end"].alias("b"), e["label"].alias("c"), e.alias("e")))), lambda x: x["e"])


def relations(sentences: DataFrame) -> DataFrame:
    """(id, subject, modal, verb, object) of sentences (id, text, entities): the last entity before the first modal, its verb, and what follows up to a stop. Sentences without a modal or such an entity have none."""
    before, modal, verb, rest = (F.regexp_extract("text", RELATION, i) for i in (1, 2, 3, 4))
    subject = F.try_element_at(F.filter("entities", lambda e: (e["end"] <= F.length(before)) & e["label"].isin("PARTY", "ORG")), F.lit(-1))["text"]
    return sentences.select("id", subject.alias("subject"), F.lower(modal).alias("modal"), F.lower(verb).alias("verb"), F.trim(rest).alias("object")).where((F.col("modal") != "") & F.col("subject").isNotNull())


def summary(entities: DataFrame) -> DataFrame:
    """(doc_id, label, names): distinct names of entities (doc_id, label, text, start) in the order of their first places; names that differ in case only count once."""
    first = entities.groupBy("doc_id", "label", F.lower(F.trim("text")).alias("_key")).agg(F.min(F.struct("start", F.trim("text").alias("text"))).alias("x"))
    return first.groupBy("doc_id", "label").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]).alias("names"))
