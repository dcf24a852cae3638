"""Clause labels: the collapse of fine labels to categories, predictions from probability vectors, BIO tags.

A null input gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.functions import text as T

# Fixed values.
#: The first category with a keyword in the label wins.
CATEGORY_KEYWORDS = {
    "PAYMENT": ["payment", "fee", "price", "cost", "royalt", "compensat", "expense", "reimburse", "invoice", "billing", "tax", "purchase price"],
    "TERMINATION": ["terminat", "expir", "cancel"],
    "CONFIDENTIALITY": ["confidential", "non-disclosure", "nda", "secrecy", "proprietary information"],
    "GOVERNING_LAW": ["governing law", "choice of law", "jurisdiction", "applicable law"],
    "INDEMNIFICATION": ["indemnif", "hold harmless"],
    "LIABILITY_LIMITATION": ["limitation of liability", "liability limit", "cap on damages", "consequential damage"],
    "RENEWAL": ["renewal", "extension", "successor", "option to extend"],
    "IP_OWNERSHIP": ["intellectual property", "patent", "copyright", "trademark", "license grant", "ip right", "ip ownership"],
    "DISPUTE_RESOLUTION": ["dispute", "arbitrat", "mediat"],
    "NON_COMPETE": ["non-compet", "non compet", "restrictive covenant", "non-solicit", "non solicit"],
    "ASSIGNMENT": ["assignment", "transfer of right", "successors and assigns"],
    "FORCE_MAJEURE": ["force majeure", "act of god", "unforeseeable"],
    "WARRANTIES": ["warrant", "represent", "guarantee", "covenant"],
    "DEFINITIONS": ["definition", "defined term", "interpretation"],
    "NOTICES": ["notice", "notification", "communication"],
    "DELIVERY_OBLIGATIONS": ["deliver", "performance", "service level", "milestone", "obligation"],
    "PENALTIES": ["penalt", "liquidated damage", "late fee", "interest rate", "default"],
    "DATA_PROTECTION": ["data protection", "privacy", "personal data", "gdpr"],
    "ENTIRE_AGREEMENT": ["entire agreement", "integration", "severab", "amendment", "waiver", "counterpart", "miscellaneous", "general provision", "survival", "headings"],
    "REPORTING_AUDIT": ["audit", "report", "record", "inspect", "accounting", "book and record", "financial statement"],
}
DEFAULT_CATEGORY = "ENTIRE_AGREEMENT"
CONFIDENCE_HIGH, CONFIDENCE_LOW = 0.75, 0.45
DATE_NOISE = ("monthly", "quarterly", "annual", "annually", "weekly", "daily", "consecutive", "subsequent", "previous", "prior", "current", "fiscal")
# End of the fixed values.

#: Categories in order of their names: a position in this list is a label's id.
CATEGORIES = sorted(CATEGORY_KEYWORDS)


def collapse_label(name: Column) -> Column:
    """The category of a fine label; underscores and hyphens count as blanks. Labels without a keyword are general provisions."""
    low = F.translate(F.lower(name), "_-", "  ")
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for category, keywords in CATEGORY_KEYWORDS.items():
        out = out.when(T.any_of([low.contains(k) for k in keywords]), category)
    return out.otherwise(DEFAULT_CATEGORY)


def entity_is_noise(text: Column, label: Column) -> Column:
    """Whether a found entity is to go: dates that are adverbs or one word without a digit, parties that name the agreement, money without a digit."""
    bare = F.lower(F.trim(text))
    digit = text.rlike("[0-9]")
    return F.coalesce(
        F.when(label == "DATE", bare.isin(*DATE_NOISE) | ((F.size(T.words(text)) == 1) & ~digit))
        .when(label == "PARTY", bare.contains("agreement") | bare.contains("between"))
        .when(label == "MONEY", ~digit),
        F.lit(False),
    )


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, probs, n): the element-wise mean of each key's vectors, in one aggregation by key and place."""
    each = df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "p"))
    means = each.groupBy(key, "pos").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"])
    return means.groupBy(key).agg(ordered.alias("probs"), F.max("n").alias("n"))


def predict(df: DataFrame, probs: str = "probs", body: str | None = None, labels: list[str] = CATEGORIES) -> DataFrame:
    """Add clause_type, confidence, needs_review and alternatives of a probability vector.

    The first of equal maxima wins. A review is due under ``CONFIDENCE_HIGH``, and for a sure RENEWAL whose
    body (if given) shows no renewal mechanics; only then there are alternatives, the three likeliest.
    """
    ranked = F.array_sort(F.transform(F.col(probs), lambda p, i: F.struct((-p).alias("minus"), i.alias("i"))))
    name = lambda i: F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), i), F.lit("UNKNOWN"))
    top = F.get(ranked, 0)
    review = -top["minus"] < CONFIDENCE_HIGH
    if body:
        review = review | ((name(top["i"]) == "RENEWAL") & ~F.coalesce(T.renewal_signal(F.col(body)), F.lit(False)))
    listed = F.transform(F.slice(ranked, 1, 3), lambda x: F.struct(name(x["i"]).alias("label"), (-x["minus"]).alias("prob")))
    none = F.array().cast("array<struct<label: string, prob: double>>")
    return df.withColumns({"clause_type": name(top["i"]), "confidence": -top["minus"], "needs_review": review, "alternatives": F.when(review, listed).otherwise(none)})


def bio_tags(text: Column, agent: Column, action: Column) -> Column:
    """array<struct<token, tag>> of a text's words: those that overlap the first place of the agent, then of the action, are tagged.

    Places are found in small letters; a tagged word isn't tagged again, and the first word that a span tags begins it.
    """
    def place(span: Column) -> Column:
        given = span.isNotNull() & (span != "") & (F.lower(span) != "null")
        return F.when(given, F.instr(F.lower(text), F.lower(span)) - 1).otherwise(F.lit(-1))

    def tagged(taken: Column, span: Column, label: str) -> Column:
        """Tags so far (null: none) with those of one more span."""
        bounds = T.bind(place(span), lambda at: F.struct(at.alias("first"), (at + F.length(span)).alias("last")))

        def of(known: Column, own: Column) -> Column:
            mine = F.transform(known, lambda t: t["tag"].isNull() & (own["first"] >= 0) & (t["stop"] > own["first"]) & (t["start"] < own["last"]))
            tag = lambda t, mine, first: F.when(mine, F.when(first, F.lit(f"B-{label}")).otherwise(F.lit(f"I-{label}"))).otherwise(t["tag"])
            each = lambda flags, first: F.transform(known, lambda t, i: F.struct(t["token"].alias("token"), t["start"].alias("start"), t["stop"].alias("stop"), tag(t, F.get(flags, i), i + 1 == first).alias("tag")))
            return T.bind(mine, lambda flags: T.bind(F.array_position(flags, True), lambda first: each(flags, first)))

        return T.bind(taken, lambda known: T.bind(bounds, lambda own: of(known, own)))

    tokens = F.zip_with(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), T.match_spans(text, r"\S+"), lambda x, at: F.struct(x.alias("token"), at["start"].alias("start"), at["end"].alias("stop"), F.lit(None).cast("string").alias("tag")))
    both = tagged(tagged(tokens, agent, "AGENT"), action, "ACTION")
    return F.transform(both, lambda t: F.struct(t["token"].alias("token"), F.coalesce(t["tag"], F.lit("O")).alias("tag")))


def strided_windows(tokens: Column, size: int = 384, stride: int = 128) -> Column:
    """array<struct<first, tokens>>: windows of at most ``size`` tokens, each ``stride`` of them shared with the one before, until one reaches the end."""
    n = F.size(tokens)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(size - stride)) + 1).cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * (size - stride))
    return F.when(tokens.isNotNull(), F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice(tokens, s + 1, F.lit(size)).alias("tokens"))))
