"""Functions on parties, aliases, directives and spans, as Column expressions.

A null input gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactspark.functions import text as T

# Fixed values.
ROLE_WORDS = (
    "licensor", "licensee", "vendor", "buyer", "seller", "franchisor", "franchisee", "employer", "employee", "consultant", "client",
    "service provider", "customer", "contractor", "developer", "company", "counterparty", "distributor", "agent", "borrower", "lender",
)
ALIAS_STOPWORDS = ("agreement", "document", "schedule", "exhibit", "annex", "appendix", "section", "article", "clause", "party", "parties", "effective date", "term", "initial term", "renewal term")
CONCEPT_ROOTS = (
    "period", "date", "revenue", "fee", "content", "program", "product", "technology", "mark", "work", "material", "payment", "rate", "amount", "cost", "price",
    "territory", "placement", "service", "media", "software", "platform", "communication", "session", "attribute", "website", "deliverable", "output",
    "indemnity", "warranty", "obligation", "property",
)
COMPANY_SUFFIXES = ("inc", "corp", "llc", "ltd", "gmbh", "ag", "plc", "co")
LEGAL_NOUNS = ("term", "grant", "retail", "basic", "master", "notice", "shares", "stock", "equity", "option", "schedule", "exhibit", "annex", "appendix", "letter", "order")
STATIVE_VERBS = ("have", "be", "include", "contain", "mean", "define", "refer")
LAW_SIGNALS = ("governed by", "laws of", "jurisdiction of", "courts of", "applicable law", "construed in accordance", "exclusive jurisdiction", "venue", "subject to the laws of")
HEADING_PARTY = r"(?i)\bOBLIGATIONS?\s+OF\s+(?:THE\s+)?([A-Z][\w&.\- ]{1,40}?)\s*$"
INLINE_HEADING = r"(?s)^(\d+(?:\.\d+)*\.?\s+[A-Z][^.]{2,60})\.\s+([A-Z].+)$"
ITEM_PREFIX = r"^[\s•●▪‣*-]*(?:\d+(?:\.\d+)*\.?\s*)?[\s•●▪‣*-]*"
IMPERATIVE_VERBS = (
    "assign", "provide", "maintain", "arrange", "make", "complete", "direct", "grow", "promote", "issue", "purchase", "remunerate", "deliver", "ensure",
    "prepare", "keep", "submit", "pay", "indemnify", "notify", "furnish", "supply", "perform", "execute", "comply", "cooperate", "contribute",
    "develop", "construct", "establish", "manage", "operate", "distribute", "market", "sell", "report", "obtain", "procure", "reimburse", "return",
)
PARTICIPLES = {
    "kept": "keep", "held": "hold", "made": "make", "placed": "place", "maintained": "maintain", "prepared": "prepare", "paid": "pay", "delivered": "deliver",
    "provided": "provide", "distributed": "distribute", "insured": "insure", "remitted": "remit", "conducted": "conduct", "submitted": "submit", "filed": "file",
    "retained": "retain", "performed": "perform", "completed": "complete", "executed": "execute",
}
OPERATIONAL = r"(?i)\b(?:records?|books?|funds?|accounts?|statements?|minutes|meetings?|reports?|payments?|distributions?|insurance|notices?|filings?|returns?|audits?)\b"
OPERATING_BODY = r"(?i)\bthe\s+(?:Joint\s+Venture|Venture|Company|Corporation|Partnership)\b"
# End of the fixed values.


def stem(word: Column) -> Column:
    """A plural's singular: -ies, then -es (or -s, where that gives a concept root), then -s."""
    w = F.regexp_replace(F.lower(word), r"\.+$", "")
    cut = lambda n: F.left(w, F.length(w) - n)
    return (
        F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("es") & (F.length(w) > 3), F.when(~cut(2).isin(*CONCEPT_ROOTS) & cut(1).isin(*CONCEPT_ROOTS), cut(1)).otherwise(cut(2)))
        .when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), cut(1))
        .otherwise(w)
    )


def is_party_alias(alias: Column) -> Column:
    """Whether a quoted alias names a party and not a defined term. The first test that applies decides."""
    a = F.regexp_replace(F.trim(alias), r"^[.:]+|[.:]+$", "")
    low, parts = F.lower(a), F.split(a, r"\s+")
    concept = F.exists(parts, lambda w: stem(w).isin(*CONCEPT_ROOTS))
    capital = F.forall(parts, lambda w: w.rlike(r"^[A-Z][^A-Z]*$"))
    return (
        F.when(low.isin(*ALIAS_STOPWORDS), False)
        .when(low.isin(*ROLE_WORDS), True)
        .when(a.rlike("[A-Z]") & (a == F.upper(a)) & F.length(a).between(2, 12), True)
        .when(F.regexp_replace(F.element_at(F.split(low, r"\s+"), -1), r"[.,]", "").isin(*COMPANY_SUFFIXES), True)
        .when(concept, False)
        .when((F.size(parts) > 1) & capital, True)
        .otherwise((F.size(parts) == 1) & F.length(a).between(3, 20) & a.rlike("^[A-Z]") & ~low.isin(*LEGAL_NOUNS))
    )


def is_antecedent(name: Column) -> Column:
    """Whether an entity's text can stand behind an alias: 5 characters or more, and two words or capitals."""
    n = F.trim(name)
    return (F.length(n) >= 5) & (n.rlike(r"\S\s+\S") | ((n == F.upper(n)) & n.rlike("[A-Z]")))


def is_jurisdiction(body: Column, start: Column, end: Column, around: int = 60) -> Column:
    """Whether words of governing law stand within ``around`` characters of the place at [start, end)."""
    first = F.greatest(start - around, F.lit(0))
    return F.lower(F.substring(body, first + 1, end + around - first)).rlike("|".join(LAW_SIGNALS))


def entity_label(label: Column, body: Column, start: Column, end: Column) -> Column:
    """Our label of a found entity: persons are parties, PERCENT is PERCENTAGE, places only where the text around speaks of law; other labels than ours give null."""
    kind = F.upper(label)
    return F.when(kind.isin("PERSON", "PARTY"), "PARTY").when(kind == "PERCENT", "PERCENTAGE").when(kind.isin("ORG", "MONEY", "DATE"), kind).when((kind == "GPE") & is_jurisdiction(body, start, end), "JURISDICTION")


def heading_party(heading: Column) -> Column:
    """The party of "OBLIGATIONS OF (THE) X", six words at most, else null."""
    found = F.regexp_extract(heading, HEADING_PARTY, 1)
    return F.when((found != "") & (F.size(F.split(found, r"\s+")) <= 6), found)


def inline_heading(text: Column, part: int) -> Column:
    """Part 1 (heading) or 2 (body) of "11. Title Words. Body ..."; null where the text isn't of that form."""
    t = F.trim(text)
    heading, body = F.regexp_extract(t, INLINE_HEADING, 1), F.regexp_extract(t, INLINE_HEADING, 2)
    bare = F.regexp_replace(heading, r"^\d+(?:\.\d+)*\.?\s+", "")
    fits = (heading != "") & (F.size(F.split(heading, r"\s+")) <= 8) & (F.size(F.split(body, r"\s+")) >= 3) & T.is_title_like(bare)
    return F.when(fits, F.concat(F.trim(heading), F.lit(".")) if part == 1 else F.trim(body))


def as_directive(item: Column) -> Column:
    """A list item's action without its bullet and "to", first letter small; null for what isn't a directive."""
    bare = F.trim(F.regexp_replace(item, ITEM_PREFIX, ""))
    infinitive = F.regexp_extract(bare, r"(?i)^to\s+([a-z].+)$", 1)
    verb = F.lower(F.regexp_extract(bare, r"^([A-Za-z]+)", 1))
    action = F.when(infinitive != "", infinitive).when(verb.isin(*IMPERATIVE_VERBS), bare)
    return F.when(F.length(bare) >= 8, F.concat(F.lower(F.left(action, F.lit(1))), F.substring(action, 2, 1 << 30)))


def passive_verb(text: Column) -> Column:
    """The base verb of "will/shall be <participle>" after an operational subject, else null."""
    pattern = r"(?is)^(.*?)\b(?:will|shall)\s+be\s+([a-z]+)\b"
    pairs = F.create_map(*[F.lit(x) for kv in PARTICIPLES.items() for x in kv])
    return F.when(F.regexp_extract(text, pattern, 1).rlike(OPERATIONAL), F.try_element_at(pairs, F.lower(F.regexp_extract(text, pattern, 2))))


def passive_agent(text: Column, heading: Column, known: Column) -> Column:
    """Who does it: the heading's party, else the operating body in the sentence, else the known one."""
    return F.coalesce(heading_party(heading), F.nullif(F.regexp_extract(text, OPERATING_BODY, 0), F.lit("")), known)


def span_near(text: Column, span: Column, anchor: Column) -> Column:
    """0-based start of the last occurrence that ends at or before the anchor, else of the first from it on; null if neither or empty."""
    before = F.left(text, anchor)
    back = F.position(F.reverse(span), F.reverse(before))
    ahead = F.position(span, text, anchor + 1)
    return F.when(F.length(span) > 0, F.when(back > 0, F.length(before) - back - F.length(span) + 1).when(ahead > 0, ahead - 1))


def decode_answer(starts: Column, ends: Column, n_best: int = 20, longest: int = 80) -> Column:
    """struct(first, last, score): best pair of the ``n_best`` starts and ends with first <= last, ``longest`` tokens at most.

    Ties go to the better start, then the better end, then the smaller index. Null without a pair.
    """
    best = lambda xs: F.slice(F.array_sort(F.transform(xs, lambda x, i: F.struct((-x).alias("a"), i.alias("i")))), 1, n_best)
    pairs = F.flatten(F.transform(best(starts), lambda s: F.transform(best(ends), lambda e: F.struct((s["a"] + e["a"]).alias("a"), s["a"].alias("sa"), s["i"].alias("first"), e["a"].alias("ea"), e["i"].alias("last")))))
    top = F.array_min(F.filter(pairs, lambda p: (p["last"] >= p["first"]) & (p["last"] - p["first"] < longest)))
    return F.when(top.isNotNull(), F.struct(top["first"].alias("first"), top["last"].alias("last"), (-top["a"]).alias("score")))


def description(parts: list[Column]) -> Column:
    """The parts that aren't null, a line each."""
    return F.concat_ws("\n", *parts)

