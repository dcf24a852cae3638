"""Numbers and durations in words and digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
VALUES = {w: i for i, w in enumerate(UNITS)} | {w: 10 * i for i, w in enumerate(TENS, 2)} | {"hundred": 100}


def _value(word: Column) -> Column:
    pairs = [F.lit(x) for kv in VALUES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), word)


def parse_number(text: Column) -> Column:
    """Digits in brackets, leading digits, tens-ones in words, first known word; else null."""
    ones = "|".join(UNITS[1:10])
    pair = rf"(?i)\b({'|'.join(TENS)})[\s-]+({ones})\b"
    digits = lambda x: F.expr("int(null)") if x is None else F.nullif(x, F.lit("")).try_cast("int")
    in_brackets = digits(F.regexp_extract(text, r"\(\s*(\d+)\s*\)", 1))
    leading = digits(F.regexp_replace(F.regexp_extract(text, r"^\s*(\d[\d,]*)", 1), ",", ""))
    both = _value(F.lower(F.nullif(F.regexp_extract(text, pair, 1), F.lit("")))) + _value(F.lower(F.nullif(F.regexp_extract(text, pair, 2), F.lit(""))))
    bare = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"^[(),.\-]+", ""), r"[(),.\-]+$", ""))
    first = _value(F.get(F.filter(bare, lambda w: w.isin([*VALUES])), F.lit(0)))
    return F.coalesce(in_brackets, leading, both, first).cast("int")


def parse_unit(text: Column) -> Column:
    """business_days, calendar_days, days, weeks, months or years; days if none is named."""
    tests = [("business_days", r"business\s+days?|working\s+days?"), ("calendar_days", r"calendar\s+days?"), ("days", "days?"), ("weeks", "weeks?"), ("months", "months?"), ("years", "years?")]
    out = F.when(text.rlike(rf"(?i)\b(?:{tests[0][1]})\b"), tests[0][0])
    for unit, pattern in tests[1:]:
        out = out.when(text.rlike(rf"(?i)\b(?:{pattern})\b"), unit)
    return out.otherwise("days")


def clamp_unit(x: Column) -> Column:
    """Into [0, 1]; null and what is no number are 0."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), 0.0).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def clamp_pct(x: Column) -> Column:
    """Integer in [0, 100], halves to even; no number 0, infinities to the bounds."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), 0).otherwise(F.bround(F.least(F.greatest(v, F.lit(0.0)), F.lit(100.0)), 0).cast("int"))


def size_kb(n: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(n / 1024.0, 0).cast("long"))
