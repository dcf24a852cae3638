"""Text functions as Column expressions. Patterns are in the syntax that Java, RE2 and Python share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
ANY_MODAL = (
    r"(?i)\b(?:shall|must|may|will|agrees?\s+to|is\s+required\s+to|covenants?\s+to|undertakes?\s+to|is\s+obligated\s+to|"
    r"is\s+entitled\s+to|has\s+the\s+right\s+to|is\s+prohibited\s+from|is\s+permitted\s+to)\b"
)
RANKED_MODALS = [r"shall", r"must", r"is\s+required\s+to", r"agrees?\s+to", r"covenants?\s+to", r"undertakes?\s+to", r"will", r"may"]
PROHIBITION = r"(?i)\b(?:shall\s+not|must\s+not|may\s+not|will\s+not|is\s+prohibited\s+from|are\s+prohibited\s+from|shall\s+in\s+no\s+event|under\s+no\s+circumstances)\b"
CONDITIONAL = (
    r"(?i)\b(?:in\s+the\s+event\s+(?:that|of)|upon\s+(?:the\s+)?(?:occurrence|completion|termination|expiration|receipt)|"
    r"if\s+(?:a|the|any|such)|provided\s+that|subject\s+to|unless)\b"
)
SKIPPED_BY_EXTRACTION = ["PREAMBLE", "DEFINITIONS", "DEFINITION_GROUP", "SIGNATURE_BLOCK", "GOVERNING_LAW", "SEVERABILITY", "COUNTERPARTS"]
SKIPPED_BY_TASKS = [*SKIPPED_BY_EXTRACTION, "NO_WAIVER", "CONSTRUCTION", "CAPTIONS", "HEADINGS", "INTERPRETATION", "CHOICE_OF_LAW", "APPLICABLE_LAW", "JURISDICTION"]
RECITAL = r"WHEREAS|RECITALS|WITNESSETH|IN WITNESS WHEREOF|NOW, THEREFORE|NOW THEREFORE"
BOILERPLATE_HEADING = r"(?i)^(?:TABLE\s+OF\s+CONTENTS|LIST\s+OF\s+(?:EXHIBITS?|SCHEDULES?|APPENDIX|APPENDICES|ANNEXES?)|INDEX|COVER\s+PAGE|SIGNATURE\s+PAGE|EXECUTION\s+PAGE)$"
PAGE_TAIL = r"\s*Page\s+\d+\s+of\s+\d+\s*$"
HEADING_NUMBER = r"(?i)^(\d+(?:\.\d+)*|[A-Z]\.|Article\s+\w+|Section\s+[\d\.]+|Clause\s+\d+)"
HEADING_PREFIX = r"(?i)^(?:(\d+(?:\.\d+)*)\.?\s+|Article\s+([IVXLCDM\d]+)\s*|Section\s+([\d\.]+)\s*|Clause\s+(\d+)\s*|([A-Z])\.\s+)"
STRUCTURAL = r"(?i)^(?:SCHEDULE|EXHIBIT|ANNEX|APPENDIX)\s+[A-Z\d]"
SMALL_WORDS = ["of", "and", "the", "in", "for", "to", "a", "an", "or", "by", "at", "on", "with", "its", "no", "nor"]
PREAMBLE_HEADINGS = ["PREAMBLE", "RECITALS", "RECITAL", "WITNESSETH", "BACKGROUND"]
LEGAL_VERBS = "shall|must|agree|covenant|warrant|may|will|obligat|terminat|indemni|pay|deliver"
CLAUSE_SIGNALS = "shall|hereby|pursuant|whereas|including|provided"
RENEWAL = (
    "automatically renew|auto-renew|shall renew|will renew|option to renew|option to extend|right of renewal|right to renew|renewal term|renewal period|"
    "renewal notice|successive term|successive one-year|successive annual|notice of non-renewal|elect to extend|shall be extended|renew for|renewed for|renew automatically"
)
MODALITY_PROHIBITION = "shall not|must not|may not|will not|cannot|neither|no party shall|not permitted|prohibited|is not allowed|shall in no event|in no case shall|shall be prohibited|not entitled"
MODALITY_PERMISSION = " may | may,|is entitled to|has the right to|is permitted|at the option of|in its sole discretion|at its election|reserves the right|shall be entitled|shall have the right|may elect|is authorized"
MODALITY_OBLIGATION = "shall |must |agrees to|covenants to|will |is required to|undertakes to|hereby agrees"
ACTION_MARKERS = [", except", ", unless", ", provided that", ", provided,", "; provided", " provided that", ", subject to", "; subject to", ", but only", ", to the extent that", ", in the event that", "; provided,"]
NON_PARTY = r"(?i)\b(?:if|when|unless|because|whereas|accesses|provided|shall|will|may)\b"
ACTION_VERBS = (
    "pay deliver provide notify terminate renew reimburse indemnify maintain submit report assign grant license disclose return remunerate purchase issue assist arrange "
    "prepare process develop establish conduct file make keep hold bear carry cease refrain ensure guarantee warrant cooperate comply perform execute fulfill cure remedy "
    "correct obtain acquire transfer convey distribute allocate publish negotiate procure handle promote advertise approve inspect audit remove place display sell market "
    "represent install equip contribute invest fund insure protect restrict prohibit forbid withhold depict exhibit accept receive"
).split()
ALIAS = r"(?i)\(\s*(?:herein(?:after)?\s+)?(?:referred\s+to\s+as\s+)?(?:meaning\s+)?(?:the\s+)?[\"'\x{201c}\x{201d}\x{2018}\x{2019}]([^\"'\x{201c}\x{201d}\x{2018}\x{2019}]{2,50})[\"'\x{201c}\x{201d}\x{2018}\x{2019}]\s*\)"
INR = r"(?i)(?:\x{20B9}|\b(?:Rs\.?|INR))\s*[\d,]+(?:\.\d{1,2})?"
DURATION = (
    r"(?i)\b(?:\d+(?:,\d{2,3})*(?:\.\d+)?|(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|"
    r"eighteen|nineteen|twenty|thirty|forty|fifty|sixty|ninety|hundred)(?:\s*\(\d+\))?)"
    r"\s+(?:business\s+days?|working\s+days?|calendar\s+days?|days?|weeks?|months?|years?)"
)


#: Elements whose offsets ``match_spans`` sums in one go; it changes the work, not the result.
BLOCK = 128


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a Column that stands in a lambda is computed anew for each element, and again wherever it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _sums_before(lengths: Column) -> Column:
    """array<int>: for each element the sum of those before it, by blocks, as appending one by one copies all that came before."""
    kind = "array<int>"

    def running(values: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(values, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def parts(each: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(each) / BLOCK).cast("int")), lambda b: F.slice(each, b * BLOCK + 1, F.lit(BLOCK)))
        return bind(blocks, lambda bs: bind(running(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0)), lambda at: F.flatten(F.zip_with(bs, at, running))))

    return bind(lengths, parts)


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of all matches, offsets from 0: running lengths of what lies between them and of themselves."""
    kind = "array<struct<start: int, `end`: int>>"
    pieces = F.zip_with(F.split(text, pattern, F.lit(-1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))

    def spans(each: Column) -> Column:
        before = _sums_before(F.transform(each, lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0))))
        found = F.zip_with(each, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["hit"]).alias("end")))
        return F.filter(found, lambda s: s["end"].isNotNull()).cast(kind)  # the last gap has no match behind it

    return bind(pieces, spans)


def words(text: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(text, r"[\s\x{00a0}\x{2002}\x{2003}\x{2009}\x{200a}]+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """1.3 tokens a word, rounded down; null counts as empty."""
    return F.floor(F.coalesce(F.size(words(text)), F.lit(0)) * F.lit(1.3)).cast("long")


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z]", "")


def is_title_like(text: Column) -> Column:
    """At most 8 words, in capitals, or every significant word capitalised."""
    ws = words(F.regexp_replace(F.trim(text), r"[.:;]+$", ""))
    alpha = _letters(text)
    cased = F.forall(
        F.transform(ws, lambda w, i: (_letters(w) == "") | (F.lower(w).isin(SMALL_WORDS) & (i > 0)) | F.substring(_letters(w), 1, 1).rlike("[A-Z]")),
        lambda ok: ok,
    )
    return F.size(ws).between(1, 8) & (((F.length(alpha) >= 3) & (alpha == F.upper(alpha))) | cased)


def is_missed_heading(text: Column) -> Column:
    """Numbered, all-capitals or structural headings of 2 to 10 words."""
    t = F.trim(text)
    prefix = F.regexp_extract(t, HEADING_PREFIX, 0)
    rest = F.trim(F.substring(t, F.length(prefix) + 1, F.length(t)))
    numbered = (prefix != "") & F.when(rest == "", True).otherwise(is_title_like(rest))
    alpha, n = _letters(t), F.size(words(t))
    capitals = (F.length(alpha) >= 8) & (alpha == F.upper(alpha)) & n.between(2, 6)
    return n.between(2, 10) & (numbered | capitals | t.rlike(STRUCTURAL))


def heading_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(text), HEADING_NUMBER, 1), F.lit(""))


def primary_modal(text: Column) -> Column:
    """The matched text of the first modal by rank; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, rf"(?i)\b({m})\b", 1), F.lit("")) for m in RANKED_MODALS])


def obligation_subtype(kind: Column, text: Column) -> Column:
    """OBLIGATION with a negated modal is PROHIBITION; both with a condition are CONDITIONAL."""
    first = F.when((kind == "OBLIGATION") & text.rlike(PROHIBITION), "PROHIBITION").otherwise(kind)
    return F.when(first.isin("OBLIGATION", "PROHIBITION") & text.rlike(CONDITIONAL), "CONDITIONAL").otherwise(first)


def first_action_verb(text: Column) -> Column:
    """The first known verb among the first 30 words of letters; null without one."""
    found = F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+)"), 1), 1, 30)
    return F.get(F.filter(found, lambda w: w.isin(ACTION_VERBS)), F.lit(0))


def is_signature_block(heading: Column, body: Column) -> Column:
    """Segmentation's test."""
    both = F.lower(F.concat_ws(" ", heading, body))
    title = both.rlike(r"\b(?:ceo|president|secretary|director|officer|chairman|managing\s+director|vice\s+president)\b")
    return both.contains("/s/") | (title & both.rlike(r"\bby:") & (F.size(words(body)) < 25))


def signature_rule2(body: Column, tokens: Column) -> Column:
    """Classification's test."""
    low = F.lower(body)
    signed = body.rlike(r"(?i)\bPer:\s*(?:Name:|_{2,})") | body.rlike(r"(?i)\bBy:\s*(?:Name:|_{2,})")
    many = (F.regexp_count(body, F.lit(r"\b(?:Name|Title|Signature):\s*")) >= 3) & ~low.rlike(CLAUSE_SIGNALS)
    return ((tokens <= 20) & ~low.rlike(LEGAL_VERBS)) | ((tokens <= 100) & (signed | many))


def is_preamble(heading: Column, body: Column, tokens: Column) -> Column:
    head = F.trim(F.regexp_replace(F.upper(F.coalesce(heading, F.lit(""))), r"^ARTICLE\s+\d+\s*[-:\x{2014}]*\s*", ""))
    text = F.upper(F.trim(F.coalesce(body, F.lit(""))))
    return head.isin(PREAMBLE_HEADINGS) | text.startswith("WHEREAS") | (text.startswith("RECITALS") & (tokens < 200))


def renewal_signal(body: Column) -> Column:
    return F.translate(F.lower(body), "     ", "     ").rlike(RENEWAL)


def estimate_modality(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike(MODALITY_PROHIBITION), "PROHIBITION").when(t.rlike(MODALITY_PERMISSION), "PERMISSION").when(t.rlike(MODALITY_OBLIGATION), "OBLIGATION").otherwise("DECLARATIVE")


def trim_action(action: Column) -> Column:
    """Cut at the first marker and after 30 words; always a prefix."""
    at = [F.nullif(F.instr(F.lower(action), m), F.lit(0)) for m in ACTION_MARKERS]
    cut = F.coalesce(F.least(*at) - 1, F.length(action))
    head = F.substring(action, F.lit(1), cut)
    head = F.regexp_extract(head, r"^\s*(?:\S+\s+){0,29}\S*", 0)
    return F.regexp_replace(head, r"[ \t\r\n,;:.\-]+$", "")


def plausible_party(party: Column) -> Column:
    p = F.trim(F.coalesce(party, F.lit("")))
    return (F.coalesce(party, F.lit("")) != "") & (F.size(words(p)) <= 8) & ~p.rlike(NON_PARTY)


def clean_party(party: Column) -> Column:
    """White space folded, quotes, brackets and stops off both ends."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(party, r"\s+", " ")), r"^[ \t\r\n.,;:\"'\[\](){}]+", ""), r"[ \t\r\n.,;:\"'\[\](){}]+$", "")
    return F.when(bare == "", F.trim(party)).otherwise(bare)


def clamp_action(action: Column, most: int = 12) -> Column:
    ws = words(action)
    return F.when(F.size(ws) <= most, action).otherwise(F.concat(F.array_join(F.slice(ws, 1, most), " "), F.lit("…")))


def task_title(party: Column, kind: Column, action: Column, due: Column) -> Column:
    """Modality phrase and due date; without an action a review title."""
    who = F.coalesce(F.nullif(clean_party(party), F.lit("")), F.lit("the party"))
    what = clamp_action(F.trim(action))
    core = F.when(kind == "PROHIBITION", F.concat(who, F.lit(" must not "), what)).when(kind == "PERMISSION", F.concat(who, F.lit(" may "), what))
    core = core.when(kind == "CONDITIONAL", F.concat(F.lit("Conditional — "), who, F.lit(" "), what)).otherwise(F.concat(who, F.lit(" shall "), what))
    tail = F.coalesce(F.concat(F.lit(" — by "), due.cast("string")), F.lit(""))
    title = F.trim(F.regexp_replace(F.concat(core, tail), r"\s+", " "))
    title = F.trim(F.regexp_replace(title, r"(?i)\s+(?:by|within|for|to|on|of|with|until|before)\s*$", ""))
    return F.when(F.trim(F.coalesce(action, F.lit(""))) == "", F.concat(F.lit("Review: "), who, F.lit(" — obligation present, action unclear"))).otherwise(title)


def format_input(heading: Column, body: Column) -> Column:
    head = F.regexp_replace(F.trim(F.regexp_replace(heading, r"^\d+(\.\d+)*\.?\s*", "")), r"\.+$", "")
    return F.when(F.coalesce(head, F.lit("")) != "", F.concat(head, F.lit(": "), body)).otherwise(body)


def parse_definition(text: Column, part: int) -> Column:
    """1: the term, 2: the definition; without a definition the term is empty and the definition is the text."""
    full = r"(?is)^[\"'\x{201c}\x{201d}]?(.+?)[\"'\x{201c}\x{201d}]?\s+(?:shall\s+)?(?:mean|means|refers?\s+to|is\s+defined\s+as)\s+(.+)$"
    short = r"(?s)^(.+?):\s+(.+)$"
    second = text.rlike(short) & (F.size(words(F.regexp_extract(text, short, 1))) <= 5)
    other = F.lit("") if part == 1 else text
    return F.when(text.rlike(full), F.trim(F.regexp_extract(text, full, part))).when(second, F.trim(F.regexp_extract(text, short, part))).otherwise(other)


def span_start(text: Column, span: Column) -> Column:
    """First occurrence, from 0; null for an empty or absent span."""
    return F.when(F.coalesce(span, F.lit("")) != "", F.nullif(F.position(span, text), F.lit(0)) - 1)


def locate_span(text: Column, span: Column) -> Column:
    """Start of the exact span, else of the first that differs in case only; null if absent."""
    return F.coalesce(span_start(text, span), span_start(F.lower(text), F.lower(span)))


def normalize_email(email: Column) -> Column:
    """Lower case without outer blanks; null without an @."""
    bare = F.lower(F.trim(email))
    return F.when(bare.contains("@"), bare)


def text_key(text: Column) -> Column:
    return F.md5(F.trim(F.lower(text)))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
