"""Deadlines: labels, kinds, resolution, priority and reminders. ``today`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactspark.functions.numbers import parse_number, parse_unit

# Fixed values.
RECURRING = (
    r"(?i)\b(?:(?:each|every)\s+(?:calendar\s+)?(?:month|quarter|year|week)|quarterly|monthly|annually|weekly|semi-?annually|"
    r"the\s+\d+(?:st|nd|rd|th)\s+day\s+of\s+each|fiscal\s+year|each\s+fiscal|each\s+subsequent\s+quarter)\b"
)
CONDITIONAL_DATE = (
    r"(?i)\b(?:upon\s+(?:the\s+)?(?:occurrence|completion|termination|expiration|receipt|delivery)|when\s+(?:the|such|any)|upon\s+(?:written\s+)?(?:notice|demand|request)|"
    r"the\s+date\s+(?:on\s+which|upon\s+which|when)|the\s+(?:closing|effective)\s+date|the\s+day\s+and\s+year\s+first|the\s+date\s+first\s+above)\b"
)
LABELS = {
    "Cure Period": "cure|remedy|correct|fail|breach",
    "Payment Due": "pay|payment|remit|remunerat|invoice",
    "Notice Period": r"notice|notify|written\s+notice",
    "Termination Window": "termina|cancel|expir",
    "Renewal Deadline": "renewal|renew|auto-?renew|extend",
    "Delivery Due": "deliver|provide|submit|furnish",
    "Report Due": "report|statement|audit|financial",
    "Confidentiality Period": "confidential|non-?disclosure|secre",
    "Record Retention": r"retain|preserv|maintain\s+record|keep\s+record",
    "Exclusivity Period": "exclusive|exclusivity|non-?compete",
    "Dispute Resolution": "dispute|arbitrat|media",
}
LABEL_OF_TYPE = {
    "PAYMENT": "Payment Due", "TERMINATION": "Termination Window", "RENEWAL": "Renewal Deadline", "DELIVERY_OBLIGATIONS": "Delivery Due",
    "REPORTING_AUDIT": "Report Due", "CONFIDENTIALITY": "Confidentiality Period", "INDEMNIFICATION": "Indemnification", "DISPUTE_RESOLUTION": "Dispute Resolution",
}
EVENT_TRIGGERS = [
    r"of\s+(?:\w+\s+){0,2}(?:notice|demand|request)\b",
    r"of\s+(?:\w+\s+){0,2}(?:termination|expiration|cancellation)\b",
    r"of\s+(?:\w+\s+){0,2}(?:receipt|delivery|completion|acceptance)\b",
    r"of\s+(?:\w+\s+){0,2}(?:breach|default|failure)\b",
    r"after\s+(?:\w+\s+){0,2}(?:notice|demand|request|receipt|delivery)\b",
    r"after\s+having\s+\w+",
    r"after\s+(?:the\s+|any\s+|such\s+)?\w+(?:\s+\w+){0,2}\s+has\s+\w+",
    r"after\s+(?:the\s+)?\w+(?:\s+\w+){0,2}\s+(?:expresses|expressed|occurs|occurred|delivers|delivered|elects|elected)\b",
    r"after\s+(?:the\s+date\s+of\s+)?such\s+notice",
    r"after\s+(?:receiving|receipt\s+of)",
    r"following\s+(?:\w+\s+){0,2}(?:notice|notification|termination|expiration|closing|receipt|delivery)\b",
    r"from\s+(?:the\s+)?(?:date\s+of\s+)?(?:termination|expiration|notice|receipt)\b",
]
REMINDER_DAYS = (90, 30, 7, 1)
#: Free dates are read in these forms only; what matches none is null, never guessed.
DATE_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy")


def deadline_label(text: Column, clause_type: Column) -> Column:
    """First label whose words occur, else the clause type's, else a general one."""
    pairs = [F.lit(x) for kv in LABEL_OF_TYPE.items() for x in kv]
    other = F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(clause_type)), F.lit("Contractual Deadline"))

    def first(low: Column) -> Column:
        # Most texts are settled by one test of all words; only the others go through the labels in order.
        out = F.when(~F.coalesce(low.rlike(rf"\b(?:{'|'.join(LABELS.values())})\b"), F.lit(False)), other)
        for label, pattern in LABELS.items():
            out = out.when(low.rlike(rf"\b(?:{pattern})\b"), label)
        return out

    return F.get(F.transform(F.array(F.lower(text)), first), 0)


def event_relative(duration: Column, body: Column) -> Column:
    """Whether a duration counts from a later event, by the words around its first occurrence."""
    low = F.lower(body)
    at = F.position(F.lower(duration), low)
    start = F.greatest(at - 20, F.lit(1))
    context = F.when(at == 0, low).otherwise(F.substring(low, start, at + F.length(duration) + 80 - start))
    return context.rlike("|".join(EVENT_TRIGGERS))


def parse_absolute(text: Column) -> Column:
    """A calendar date; null for under four characters, recurring and conditional dates, and other forms."""
    tried = F.coalesce(*[F.try_to_date(F.trim(text), f) for f in DATE_FORMATS])
    return F.when((F.length(F.trim(text)) >= 4) & ~text.rlike(RECURRING) & ~text.rlike(CONDITIONAL_DATE), tried)


def date_kind(text: Column) -> Column:
    return F.when(text.rlike(RECURRING), "RECURRING").when(text.rlike(CONDITIONAL_DATE), "CONDITIONAL").when(parse_absolute(text).isNotNull(), "ABSOLUTE").otherwise("CONDITIONAL")


def business_days(day: Column, n: Column) -> Column:
    """n working days (Monday to Friday) later, in closed form; 0 from a weekend is Monday."""
    wd = F.weekday(day)
    base = F.when(wd >= 5, F.date_sub(day, wd - 4)).otherwise(day)
    w = F.least(wd, F.lit(4))
    r = n % 5
    ahead = F.expr("0") + F.floor(n / 5).cast("int") * 7 + r + F.when(w + r > 4, 2).otherwise(0)
    return F.when((n == 0) & (wd >= 5), F.date_add(day, 7 - wd)).otherwise(F.date_add(base, ahead))


def resolve_relative(text: Column, anchor: Column) -> Column:
    """Anchor plus the duration in the text; null without a number."""
    n, unit = parse_number(text), parse_unit(text)
    return (
        F.when(unit == "business_days", business_days(anchor, n))
        .when(unit.isin("days", "calendar_days"), F.date_add(anchor, n))
        .when(unit == "weeks", F.date_add(anchor, n * 7))
        .when(unit == "months", F.add_months(anchor, n))
        .when(unit == "years", F.add_months(anchor, n * 12))
    )


def task_priority(clause_type: Column, kind: Column, due: Column, date_type: Column, today: Column) -> Column:
    ct = F.upper(clause_type)
    paid = (ct == "PAYMENT") & (kind == "OBLIGATION") & due.isNotNull()
    return (
        F.when(kind == "PROHIBITION", "HIGH").when(kind == "PERMISSION", "LOW").when(kind == "CONDITIONAL", "MEDIUM")
        .when(paid & (F.datediff(due, today) < 30), "CRITICAL").when(paid, "HIGH")
        .when(ct.isin("TERMINATION", "RENEWAL") & (kind == "OBLIGATION"), "HIGH")
        .when((date_type == "RECURRING") | (kind == "OBLIGATION"), "MEDIUM").otherwise("LOW")
    )


def reminder_dates(due: Column, today: Column) -> Column:
    """The due date less 90, 30, 7 and 1 days, those not before today; none without a due date."""
    days = F.array(*[F.date_sub(due, d) for d in REMINDER_DAYS])
    return F.when(due.isNull(), F.array().cast("array<date>")).otherwise(F.filter(days, lambda d: d >= today))
