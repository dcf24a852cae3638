"""Clause segmentation and the joins between spans of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactspark.functions import parties as P
from pactspark.functions import text as T


def segment_items(items: DataFrame) -> DataFrame:
    """Fold layout items (doc_id, item_idx, label, text, page_no) into clauses (doc_id, clause_index, chunk_type, heading, body, start_page, end_page, token_count).

    A heading opens a clause; "11. Title. Body ..." in one item is a heading and its body; bodies before any heading are the
    preamble; bodies join with a blank. A table is a chunk of its own and doesn't close the clause around it.
    The running count of headings is the clause's number, so one exchange by document is all; clauses are numbered
    from 0, a table before the clause that it stands in if it comes first.
    """
    table = F.coalesce(F.lower("label").contains("table"), F.lit(False))
    inline = F.when(~table, P.inline_heading(F.col("text"), 1))
    heading = F.lower("label").contains("section_header") | (F.lower("label") == "title") | T.is_missed_heading(F.col("text"))
    head = ~table & (inline.isNotNull() | F.coalesce(heading, F.lit(False)))
    order = W.partitionBy("doc_id").orderBy("item_idx").rowsBetween(W.unboundedPreceding, 0)
    marked = items.withColumns({"is_table": table, "inline": inline, "is_head": head}).withColumn("grp", F.sum(F.col("is_head").cast("long")).over(order))
    body = F.when(F.col("inline").isNotNull(), P.inline_heading(F.col("text"), 2)).when(~F.col("is_head"), F.col("text"))
    marked = marked.withColumns({"part": body, "own": F.when(F.col("is_table"), F.col("item_idx")).otherwise(-1)})
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("item_idx", "part")))), lambda x: x["part"])
    out = marked.groupBy("doc_id", "grp", "own").agg(
        F.max(F.when(F.col("is_head"), F.coalesce("inline", "text"))).alias("heading"),
        F.array_join(parts, " ").alias("body"),
        F.min("page_no").alias("start_page"),
        F.max("page_no").alias("end_page"),
        F.min("item_idx").alias("first"),
    )
    is_table = F.col("own") >= 0
    out = out.withColumns({"chunk_type": F.when(is_table, "TABLE").otherwise("CLAUSE"), "heading": F.when(~is_table, F.coalesce("heading", F.lit("PREAMBLE")))})
    out = out.withColumn("token_count", T.token_count(F.concat_ws(" ", "heading", "body")))
    return out.withColumn("clause_index", (F.row_number().over(W.partitionBy("doc_id").orderBy("first")) - 1).cast("int")).drop("grp", "own", "first")


def merge_orphans(clauses: DataFrame) -> DataFrame:
    """Tiny clauses (under 15 tokens and 10 characters) join the clause before them."""
    tiny = (F.col("token_count") < 15) & (F.length("body") < 10) & (F.col("clause_index") > 0)
    order = W.partitionBy("doc_id").orderBy("clause_index").rowsBetween(W.unboundedPreceding, 0)
    grouped = clauses.withColumn("grp", F.sum((~tiny).cast("long")).over(order))
    joined = F.transform(F.sort_array(F.collect_list(F.struct("clause_index", "heading", "body"))), lambda x: F.trim(F.concat_ws(" ", x["heading"], x["body"])))
    return grouped.groupBy("doc_id", "grp").agg(F.min("clause_index").alias("clause_index"), F.array_join(joined, " ").alias("text"), F.max("end_page").alias("end_page")).drop("grp")


def split_oversized(df: DataFrame, text: str = "text", most: int = 480, carry: int = 50) -> DataFrame:
    """Add ``sub_chunks``: sentences packed up to ``most`` tokens, with up to ``carry`` tokens of the end repeated."""
    cut = F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.struct(s.alias("s"), T.token_count(s).alias("n")))
    sentences = F.filter(cut, lambda x: x["s"] != "")
    kind = "array<struct<s: string, n: bigint>>"
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(kind).alias("now"))
    size = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["s"]), " ")

    def tail(xs):
        keep = F.aggregate(F.reverse(xs), F.struct(F.array().cast(kind).alias("k"), F.lit(False).alias("full")), lambda a, x: F.when(a["full"] | (size(a["k"]) + x["n"] > carry), F.struct(a["k"].alias("k"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(F.array(x), a["k"]).alias("k"), F.lit(False).alias("full"))))
        return keep["k"]

    def step(acc, x):
        over = (F.size(acc["now"]) > 0) & (size(acc["now"]) + x["n"] > most)
        return F.when(over, F.struct(F.concat(acc["done"], F.array(joined(acc["now"]))).alias("done"), F.concat(tail(acc["now"]), F.array(x)).alias("now"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(x)).alias("now")))

    done = F.aggregate(sentences, empty, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(joined(a["now"])))).otherwise(a["done"]))
    return df.withColumn("sub_chunks", done)


def overlap_anti(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Spans (key, start, end) of ``left`` that overlap no span of ``right`` with the same key."""
    r = right.select(F.col(key), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return left.join(r, (left[key] == r[key]) & (left["start"] < r["_e"]) & (r["_s"] < left["end"]), "left_anti")


def longest_spans(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Of overlapping spans (start, end) in an array the longest stays, the earlier on ties."""
    by = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    kind = dict(df.dtypes)[spans]

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        return F.when((F.size(acc) == 0) | (x["start"] >= last["end"]), F.concat(acc, F.array(x))).when(
            x["end"] - x["start"] > last["end"] - last["start"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))
        ).otherwise(acc)

    return df.withColumn(spans, F.aggregate(by, F.array().cast(kind), step))


def carry_forward(clauses: DataFrame) -> DataFrame:
    """A clause of a bare structural label lends its heading to the next clause and goes."""
    label = F.col("heading").rlike(r"(?i)^(SCHEDULE|EXHIBIT|ANNEX|APPENDIX|PART)\b") & (F.length("body") < 5)
    order = W.partitionBy("doc_id").orderBy("clause_index")
    before = F.when(F.lag(label).over(order), F.lag("heading").over(order))
    return clauses.withColumn("_label", label).withColumn("heading", F.concat_ws(" — ", before, "heading")).where(~F.col("_label")).drop("_label")


def alias_antecedent(triggers: DataFrame, entities: DataFrame, within: int = 200) -> DataFrame:
    """Triggers (doc_id, pos) with the entity (doc_id, start, end, name) that ends last before each.

    It ends ``within`` characters before the trigger at most, with no other trigger between.
    Of entities with one end the first to start wins. Positions are integers; one
    exchange by document and no pairs: the nearest entity is the only one that can pass.
    """
    events = triggers.select("doc_id", "pos", F.lit(None).cast("struct<end: bigint, back: bigint, name: string>").alias("entity")).unionByName(
        entities.select("doc_id", F.col("end").alias("pos"), F.struct(F.col("end").cast("long").alias("end"), (-F.col("start")).cast("long").alias("back"), "name").alias("entity"))
    )
    order = W.partitionBy("doc_id").orderBy("pos")
    nearest = F.max("entity").over(order.rangeBetween(W.unboundedPreceding, 0))
    before = F.max(F.when(F.col("entity").isNull(), F.col("pos"))).over(order.rangeBetween(W.unboundedPreceding, -1))
    seen = events.withColumn("nearest", nearest).withColumn("before", before).where("entity IS NULL")
    free = (F.col("pos") - F.col("nearest.end") <= within) & (F.col("before").isNull() | (F.col("before") < F.col("nearest.end")))
    return seen.select("doc_id", "pos", F.when(free, F.col("nearest.name")).alias("name"))


def drop_noise(clauses: DataFrame) -> DataFrame:
    """Clauses without those of a heading only (body under 5 characters, under 15 tokens); structural labels stay."""
    label = F.col("heading").rlike(r"(?i)^(SCHEDULE|EXHIBIT|ANNEX|APPENDIX|PART)\b")
    empty = (F.length("body") < 5) & (T.token_count(F.concat_ws(" ", "heading", "body")) < 15)
    return clauses.where(~empty | label)


def merge_rule_entities(found: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Spans (key, start, end, ...) of ``found`` and those of ``rules`` that overlap none of them."""
    return found.unionByName(overlap_anti(rules, found, key))


def definition_groups(clauses: DataFrame) -> DataFrame:
    """(doc_id, chunk_type, terms) of chunks (doc_id, heading, bodies): under a heading of definitions each body is an item; unparsed ones go where one parsed."""
    parsed = F.filter(F.transform("bodies", lambda b: T.parse_definition(b, 1)), lambda t: t != "")
    is_group = F.col("heading").rlike(r"(?i)\bDEFINITIONS?\b") & (F.size(parsed) > 0)
    return clauses.select("doc_id", F.when(is_group, "DEFINITION_GROUP").otherwise("CLAUSE").alias("chunk_type"), F.when(is_group, parsed).otherwise(F.array().cast("array<string>")).alias("terms"))


# Fixed values.
FURNITURE = ("page_header", "page_footer", "footnote", "picture", "figure", "chart", "formula", "code", "checkbox", "empty_value")


def filter_item_labels(items: DataFrame) -> DataFrame:
    """Layout items whose label holds no name of page furniture; a null label stays."""
    return items.where(~F.coalesce(F.lower("label").rlike("|".join(FURNITURE)), F.lit(False)))
