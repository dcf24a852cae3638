"""Obligations: who must do what by when. Duty tables, governing agents, party names, deadlines.

Known parties are an array column. Everything is a Column expression but for the state that
runs through a clause's sentences, which is one window by clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactspark.functions import parties as P
from pactspark.functions import text as T

# Fixed values.
DUTY_HEADER = r"(?i)\b(dut(?:y|ies)|responsibilit|obligation|deliverable|scope|task|commitment|role|service)s?\b"
ORGANISATION = r"(?i)\b(?:inc|llc|ltd|corp|corporation|company|gmbh|co|plc|lp)\b\.?"
TABLE_ROLES = (
    "member", "members", "licensee", "licensor", "party", "parties", "company", "venture", "vendor", "supplier", "contractor", "consultant", "buyer",
    "seller", "tenant", "landlord", "lessee", "lessor", "employer", "employee",
)
KNOWN_ROLES = (
    "party", "parties", "licensor", "licensee", "seller", "buyer", "vendor", "purchaser", "employer", "employee", "contractor",
    "consultant", "lessor", "lessee", "landlord", "tenant", "borrower", "lender", "company", "corporation", "talent", "artist", "provider", "recipient", "owner",
    "member", "members", "manager", "partner", "partners", "agent", "principal", "guarantor", "surety", "affiliate", "affiliates", "subsidiary", "subsidiaries",
)
INANIMATE = (
    "purpose", "term", "duration", "funds", "contributions", "matters", "vote", "meetings", "interest", "majeure", "nothing", "everything",
    "anything", "something", "provisions", "rights", "duties", "obligations", "amounts", "payments", "costs", "expenses", "property", "assets",
    "agreement", "contract", "notice", "consent", "business", "venture", "account", "capital", "value", "membership", "information",
)
DETERMINERS = ("the", "all", "any", "no", "each", "every", "such")
ONE_PARTY = ("each party", "either party", "any party", "a party")
ALL_PARTIES = ("the parties", "both parties", "all parties")
LEAD_IN = r"(?i)\b(?:shall|will|agrees?\s+to|covenants?\s+to|undertakes?\s+to)\b[^.]*?\bas\s+follows\b"
SUBJECT = r"(?is)^(.*?)\b(?:shall|will|agrees?\s+to|covenants?\s+to|undertakes?\s+to)\b"
PASSIVE = r"(?is)^(.*?)\b(?:will|shall)\s+be\s+([a-z]+)\b\s*(.*)$"
KNOWN_BODY = r"(?i)\b(?:company|venture|corporation|llc|inc|ltd)\b"
DATE_RANK = ("ABSOLUTE", "RELATIVE", "RECURRING", "CONDITIONAL")
NEAREST, SENTENCE_RADIUS = 350, 400
# End of the fixed values.


def _first(xs: Column) -> Column:
    return F.get(xs, 0)


def _word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def strip_item(text: Column) -> Column:
    """A list item without its bullet and number."""
    return F.trim(F.regexp_replace(text, P.ITEM_PREFIX, ""))


# --- duty tables -------------------------------------------------------------------------------


def _rows(text: Column) -> Column:
    """array<array<string>>: the cells of each line with two pipes or more, without separators and empty rows."""
    piped = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.size(F.split(x, r"\|", F.lit(-1))) >= 3)
    cells = F.transform(piped, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|", F.lit(-1)), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")))
    return F.filter(cells, lambda row: ~F.forall(row, lambda c: (c == "") | c.rlike(r"^:?-{2,}:?$")))


def is_table(text: Column) -> Column:
    """Whether two lines or more have two pipes or more."""
    return F.size(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.size(F.split(x, r"\|", F.lit(-1))) >= 3)) >= 2


def table_party(cell: Column, known: Column) -> Column:
    """The party that a table's cell names: a known one (equal, or longer than three letters and either holds the other), an organisation of up to eight words, a role; else null."""
    bare = F.regexp_replace(cell, r"^[ *\t]+|[ *\t]+$", "")
    low = F.lower(bare)
    fits = F.filter(known, lambda p: (p != "") & ((low == F.lower(p)) | ((F.length(p) > 3) & (low.contains(F.lower(p)) | F.lower(p).contains(low)))))
    role = F.regexp_replace(low, r"^[ .:-]+|[ .:-]+$", "").isin(*TABLE_ROLES)
    return F.when(bare != "", F.coalesce(_first(fits), F.when(low.rlike(ORGANISATION) & (_word_count(bare) <= 8), bare), F.when(role, F.initcap(bare))))


def duty_table(text: Column, known: Column) -> Column:
    """array<struct<text, party, duty>> of a table whose header names duties: a row for each whose first cell is a party and whose others are a duty of eight characters or more."""
    rows = _rows(text)
    kind = "array<struct<text: string, party: string, duty: string>>"

    def one(cells: Column) -> Column:
        party = table_party(F.get(cells, 0), known)
        duty = F.regexp_replace(F.array_join(F.filter(F.slice(cells, F.lit(2), F.size(cells)), lambda c: c != ""), " "), r"^[ *\t]+|[ *\t]+$", "")
        said = F.concat(party, F.lit(" shall "), F.lower(F.left(duty, F.lit(1))), F.substring(duty, F.lit(2), F.length(duty)))
        return F.struct(said.alias("text"), party.alias("party"), duty.alias("duty"))

    body = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.size(r) >= 2)
    made = F.filter(F.transform(body, one), lambda x: x["party"].isNotNull() & (F.length(x["duty"]) >= 8))
    is_duties = is_table(text) & (F.size(rows) >= 2) & F.array_join(_first(rows), " ").rlike(DUTY_HEADER)
    return F.when(is_duties, made).otherwise(F.array().cast(kind))


# --- parties -----------------------------------------------------------------------------------


def resolve_generic(name: Column, known: Column) -> Column:
    """"each party" and the like become the first known party, "both parties" the first two; other names stay."""
    parties = F.coalesce(known, F.array().cast("array<string>"))
    one = F.lower(name).isin(*ONE_PARTY) & (F.size(parties) > 0)
    both = F.lower(name).isin(*ALL_PARTIES) & (F.size(parties) > 0)
    return F.when(one, _first(parties)).when(both, F.array_join(F.slice(parties, 1, 2), " and ")).otherwise(name)


def validate_party(name: Column, known: Column) -> Column:
    """A candidate as a party's name, or null.

    Up to 50 characters and six words: a role in title case; else a known party that equals or holds it, or that
    it holds; else a capitalised name whose last word isn't a thing and that isn't a bare determiner.
    """
    bare = F.regexp_replace(name, r"^\s+|\s+$", "")
    low = F.lower(bare)
    parties = F.coalesce(known, F.array().cast("array<string>"))
    match = _first(F.filter(parties, lambda p: F.lower(p).contains(low) | low.contains(F.lower(p))))
    words = F.split(bare, r"\s+")
    capital = lambda w: F.left(w, F.lit(1)).rlike(r"^\p{Lu}")
    bare_determiner = F.lower(F.get(words, 0)).isin(*DETERMINERS) & ((F.size(words) < 2) | ~capital(F.get(words, 1)))
    proper = capital(bare) & ~F.lower(F.element_at(words, -1)).isin(*INANIMATE) & ~bare_determiner
    named = F.when(low == F.lower(match), bare).otherwise(match)
    return F.when((bare != "") & (F.length(bare) <= 50) & (F.size(words) <= 6), F.when(low.isin(*KNOWN_ROLES), F.initcap(bare)).when(match.isNotNull(), named).when(proper, bare))


def leading_party(item: Column, known: Column) -> Column:
    """struct<party, rest> of an item that begins with a known party, the longest such, and goes on after it; else null."""
    fits = F.filter(known, lambda p: (p != "") & F.lower(item).startswith(F.lower(p)))
    ranked = F.array_sort(F.transform(fits, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p"), strip_item(F.substring(item, F.length(p) + 1, F.length(item))).alias("rest"))))
    ok = _first(F.filter(ranked, lambda x: (x["rest"] != "") & (x["rest"] != item)))
    return F.when(ok.isNotNull(), F.struct(ok["p"].alias("party"), ok["rest"].alias("rest")))


def directive(item: Column) -> Column:
    """What follows "shall" for an item without a modal: an infinitive without its "to", or an item that begins with an imperative verb; null otherwise, and under eight characters."""
    infinitive = F.regexp_extract(item, r"(?i)^to\s+([a-z].+)$", 1)
    verb = F.lower(F.regexp_replace(F.get(F.split(item, r"\s+"), 0), "[^a-zA-Z]", ""))
    small = F.concat(F.lower(F.left(item, F.lit(1))), F.substring(item, F.lit(2), F.length(item)))
    return F.when(F.length(item) >= 8, F.when(infinitive != "", F.trim(infinitive)).when(verb.isin(*P.IMPERATIVE_VERBS), small))


def passive_rewrite(text: Column, heading_agent: Column, known: Column) -> Column:
    """struct<text, agent> of "records shall be kept ..." as "<agent> shall keep records ..."; null if it isn't of that form or has no agent.

    The agent is the heading's party, else an operating body named in the sentence, else a known organisation.
    """
    verb = P.passive_verb(text)
    insent = F.nullif(F.regexp_extract(text, P.OPERATING_BODY, 0), F.lit(""))
    agent = F.coalesce(heading_agent, insent, _first(F.filter(known, lambda p: p.rlike(KNOWN_BODY))))
    before, rest = (F.regexp_extract(text, PASSIVE, i) for i in (1, 3))
    subject = F.trim(F.regexp_replace(strip_item(before), r",\s*$", ""))
    said = F.concat_ws(" ", agent, F.lit("shall"), verb, F.nullif(subject, F.lit("")), F.nullif(F.trim(rest), F.lit("")))
    return F.when(verb.isNotNull() & agent.isNotNull(), F.struct(said.alias("text"), agent.alias("agent")))


# --- governing agent ---------------------------------------------------------------------------


def candidates(sentences: DataFrame) -> DataFrame:
    """(clause_id, sent_idx, text, hint, original, review) of (clause_id, sent_idx, text, heading, parties): what goes to the models.

    Sentences with a modal pass; passive ones are rewritten and flagged. Items without one become "<agent> shall ..."
    with the agent that governs there: a party the item begins with, else the last one that an "as follows" lead-in, a
    bare sub-header or such an item set before, else the heading's. Sentences under ten characters are left out.
    """
    raw = F.trim("text")
    item = strip_item(F.col("raw"))
    lead_in = F.col("raw").rlike(LEAD_IN)
    subject = strip_item(F.trim(F.regexp_extract("raw", SUBJECT, 1)))
    subject = F.when((subject != "") & (_word_count(subject) <= 6), subject)
    bare = F.regexp_replace(F.lower(F.col("item")), r"^[ .:-]+|[ .:-]+$", "")
    header = F.when((F.col("item") != "") & (_word_count(F.col("item")) <= 4), _first(F.filter("parties", lambda p: (p != "") & (F.lower(p) == bare))))
    step = sentences.withColumn("raw", raw).where(F.length("raw") >= 10).withColumn("item", item)
    step = step.withColumn("kind", F.when(lead_in, "lead_in").when(header.isNotNull(), "header").when(F.col("raw").rlike(T.ANY_MODAL), "modal").otherwise("item"))
    step = step.withColumn("lead", F.when(F.col("kind") == "item", leading_party(F.col("item"), F.col("parties"))))
    step = step.withColumn("sets", F.when(F.col("kind") == "lead_in", subject).when(F.col("kind") == "header", header).otherwise(F.col("lead.party")))
    order = W.partitionBy("clause_id").orderBy("sent_idx").rowsBetween(W.unboundedPreceding, 0)
    heading_agent = P.heading_party(F.regexp_replace("heading", r"[ .:-]+$", ""))
    step = step.withColumn("governing", heading_agent).withColumn("agent", F.coalesce(F.last("sets", ignorenulls=True).over(order), "governing"))
    source = F.coalesce(F.col("lead.rest"), F.col("item"))
    passive = passive_rewrite(F.col("raw"), F.col("governing"), F.col("parties"))
    step = step.withColumn("passive", F.when(F.col("kind") == "modal", passive)).withColumn("action", F.when(F.col("kind") == "item", directive(source))).withColumn("source", source)
    said = F.when(F.col("kind") == "lead_in", F.col("raw")).when(F.col("kind") == "modal", F.coalesce("passive.text", "raw")).when(F.col("kind") == "item", F.concat("agent", F.lit(" shall "), "action"))
    hint = F.when(F.col("kind") == "modal", F.col("passive.agent")).when(F.col("kind") == "item", F.col("agent"))
    original = F.when(F.col("kind") == "item", F.col("source")).otherwise(F.col("raw"))
    return step.select("clause_id", "sent_idx", said.alias("text"), hint.alias("hint"), original.alias("original"), F.col("passive").isNotNull().alias("review")).where("text IS NOT NULL")


# --- deadlines ---------------------------------------------------------------------------------


def sentence_bounds(text: Column, at: Column) -> tuple[Column, Column]:
    """Start and end (offsets from 0) of the sentence around a place, at most ``SENTENCE_RADIUS`` characters to either side."""
    head = F.left(text, at)
    back, ahead = F.instr(F.reverse(head), " ."), F.position(F.lit(". "), text, at + 1)
    start = F.when(back == 0, 0).otherwise(F.length(head) - back + 1)
    end = F.when(ahead == 0, F.length(text)).otherwise(ahead)
    return F.greatest(start, at - SENTENCE_RADIUS), F.least(end, at + SENTENCE_RADIUS)


def associate(clauses: DataFrame, obligations: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Obligations (clause_id, ord, action, party) with ``deadline``, the raw text of the one of (clause_id, ord, raw, date_type) that belongs to each, or null.

    Clauses are (clause_id, body). An obligation stands where its action (over three characters) or else its party first
    occurs in the body; one that occurs nowhere gets a deadline only if the clause has just one. Of the deadlines
    whose text is in the obligation's sentence the most specific type wins, then the first; without any, the
    nearest one within ``NEAREST`` characters. A clause's deadlines travel as one array (they are parts of one text), so no pairs are made.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in DATE_RANK]), F.col("date_type")), F.lit(0)), F.lit(99))
    listed = deadlines.groupBy("clause_id").agg(F.array_sort(F.collect_list(F.struct("ord", rank.alias("rank"), "raw"))).alias("deadlines"))
    both = obligations.join(clauses.select("clause_id", "body").join(listed, "clause_id"), "clause_id", "left")
    action, party = (F.trim(F.coalesce(c, F.lit(""))) for c in ("action", "party"))
    spot = F.coalesce(F.when(F.length(action) > 3, F.nullif(F.instr("body", action), F.lit(0))), F.when(party != "", F.nullif(F.instr("body", party), F.lit(0)))) - 1
    both = both.withColumn("at", spot)
    start, end = sentence_bounds(F.col("body"), F.col("at"))
    sentence = F.substring(F.col("body"), start + 1, end - start)
    given = F.filter("deadlines", lambda d: d["raw"] != "")
    inside = F.array_min(F.transform(F.filter(given, lambda d: F.instr(sentence, d["raw"]) > 0), lambda d: F.struct(d["rank"].alias("rank"), d["ord"].alias("ord"), d["raw"].alias("raw"))))
    found = F.filter(F.transform(given, lambda d: F.struct(F.abs(F.instr(F.col("body"), d["raw"]) - 1 - F.col("at")).alias("far"), d["ord"].alias("ord"), d["raw"].alias("raw"), (F.instr(F.col("body"), d["raw"]) > 0).alias("there"))), lambda d: d["there"])
    near = F.array_min(found)
    lone = F.when(F.size("deadlines") == 1, F.get("deadlines", 0)["raw"])
    chosen = F.when(F.col("at").isNull(), lone).otherwise(F.coalesce(inside["raw"], F.when(near["far"] <= NEAREST, near["raw"])))
    return both.withColumn("deadline", chosen).select(*obligations.columns, "deadline")
