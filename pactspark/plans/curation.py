"""Training-set curation: dedupe, balance, grouped split, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactspark.functions import text as T
from pactspark.operators.relational import keep_first
from pactspark.sources.files import parse_json

MODALITIES = ("OBLIGATION", "PROHIBITION", "PERMISSION", "DECLARATIVE")


def split_of(group: Column, seed: int = 42) -> Column:
    """train, val or test (75, 12.5 and 12.5 percent) by the group's hash: a group never straddles."""
    part = F.pmod(F.conv(F.substring(F.md5(F.concat(group.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long"), F.lit(1000))
    return F.when(part < 750, "train").when(part < 875, "val").otherwise("test")


# Fixed values.
NOTICE_WORDS = ("notice", "notification", "communication", "delivery", "payment shall be made", "shall be in writing", "shall be deemed")
BOUNDARIES = (
    ", except ", ", unless ", ", provided that ", ", provided, however", "; provided ", " unless such ", " even if ", ", subject to ",
    ", in which case ", ", notwithstanding ", ", including ",
)
LONG_ACTION, SHORT_ACTION, SHORTEST_TEXT, MOST_OF_CATEGORY, RARE_PERCENT = 40, 5, 80, 25, 10
QUESTIONS = {
    "OBLIGATION": {"agent": "Who is required to act?", "action": "What must they do?"},
    "PROHIBITION": {"agent": "Who is restricted?", "action": "What are they prohibited from doing?"},
    "PERMISSION": {"agent": "Who is granted a right?", "action": "What are they permitted to do?"},
}
# End of the fixed values.


def truncate_action(action: Column) -> Column:
    """An action of over forty words up to its first exception or condition, if five words stay; others as they are."""
    low = F.lower(action)
    places = F.filter(F.array(*[F.instr(low, m) for m in BOUNDARIES]), lambda i: i > 1)
    cut = F.regexp_replace(F.left(action, F.array_min(places) - 1), "[, ;]+$", "")
    return F.when((F.size(T.words(action)) > LONG_ACTION) & (F.size(T.words(cut)) >= SHORT_ACTION), cut).otherwise(action)


def repair(rows: DataFrame) -> DataFrame:
    """Annotations (text, modality, agent, action, ...) fit for training.

    Without a modality, or under ``SHORTEST_TEXT`` characters: out. An actionable one without an agent becomes
    DECLARATIVE without an action if its text is about notices, else it is out; one with an agent and no action is out.
    Long actions are truncated. An actionable one whose action isn't in its text is out.
    """
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    known = rows.where(F.col("modality").isNotNull() & (F.length("text") >= SHORTEST_TEXT))
    acts, low = F.col("modality") != "DECLARATIVE", F.lower("text")
    lower_ = acts & ~given("agent") & T.any_of([low.contains(k) for k in NOTICE_WORDS])
    known = known.withColumn("_down", lower_).where(~acts | F.col("_down") | (given("agent") & given("action")))
    known = known.withColumns({"modality": F.when(F.col("_down"), "DECLARATIVE").otherwise(F.col("modality")), "action": F.when(~F.col("_down"), truncate_action(F.col("action")))}).drop("_down")
    return known.where((F.col("modality") == "DECLARATIVE") | (F.instr(F.lower("text"), F.lower("action")) > 0))


def curate(rows: DataFrame, most: int = MOST_OF_CATEGORY) -> DataFrame:
    """(id, category, text, modality, agent, action) to a training set with its ``split``.

    Texts with equal beginnings (150 characters) or equal digests keep the first id; then ``repair``; of a category
    (null is one) ``most`` records stay, chosen by the id's digest, so a second run keeps the same; the split goes by record.
    """
    first = keep_first(rows, [F.lower(F.substring("text", 1, 150))], ["id"])
    unique = keep_first(repair(first), [T.text_key(F.col("text"))], ["id"])
    return keep_first(unique, ["category"], [F.md5(F.col("id").cast("string")), "id"], most).withColumn("split", split_of(F.col("id")))


def clean_replies(rows: DataFrame, column: str) -> DataFrame:
    """Rows with the ``modality`` of a model's reply: code fences go; what then is no object with a known modality goes as a whole."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(column), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    return parse_json(rows.withColumn("_reply", bare), "_reply", "modality string").withColumn("modality", F.col("parsed.modality")).where(F.col("modality").isin(*MODALITIES)).drop("_reply", "parsed")


def rare_classes(rows: DataFrame, column: str = "modality") -> DataFrame:
    """(class, n, pct, rare) of a column's values; rare is under ``RARE_PERCENT`` percent. One aggregation; the total is a window over the classes."""
    n = rows.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    pct = 100.0 * F.col("n") / F.sum("n").over(W.partitionBy())
    return n.withColumn("pct", F.round(pct, 6)).withColumn("rare", pct < RARE_PERCENT)


def squad_examples(rows: DataFrame) -> DataFrame:
    """(id, place, context, modality, agent, action, source) to two question examples for each record, of the agent and of the action.

    Answers are slices of the context; an actionable record with an answer that isn't in it is out as a whole. A
    DECLARATIVE one has no answers and is asked in the framing of its place, in turn. The id's last part is the field.
    """
    context, action = F.trim("context"), T.trim_action(F.trim("action"))
    rows = rows.withColumn("context", context).where((F.length("context") > 0) & F.col("modality").isin(*MODALITIES))
    spans = rows.withColumns({"agent": F.trim("agent"), "action": action})
    spans = spans.withColumns({"agent_at": T.locate_span(F.col("context"), F.col("agent")), "action_at": T.locate_span(F.col("context"), F.col("action"))})
    none = F.col("modality") == "DECLARATIVE"
    filled = (F.length("agent") > 0) & (F.length("action") > 0)
    kept = spans.where(none | F.coalesce(filled & F.col("agent_at").isNotNull() & F.col("action_at").isNotNull(), F.lit(False)))
    frames = F.array(*[F.lit(x) for x in QUESTIONS])
    frame = F.when(none, F.get(frames, F.pmod(F.col("place"), F.lit(len(QUESTIONS))).cast("int"))).otherwise(F.col("modality"))

    def example(field: str) -> Column:
        asked = F.coalesce(*[F.when(frame == k, v[field]) for k, v in QUESTIONS.items()])
        at, answer = F.col(f"{field}_at"), F.col(field)
        return F.struct(
            F.concat(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row"), F.col("place").cast("string"))), F.lit(f"-{field}")).alias("id"), F.lit(field).alias("field"), asked.alias("question"),
            none.alias("is_impossible"), F.when(~none, at).alias("answer_start"), F.when(~none, F.substring(F.col("context"), at + 1, F.length(answer))).alias("answer"),
        )

    each = kept.select("context", "modality", F.coalesce("source", F.lit("unknown")).alias("source"), F.explode(F.array(example("agent"), example("action"))).alias("x"))
    return each.select("x.*", "context", "modality", "source")


def record_of(example_id: Column) -> Column:
    """The record that an example belongs to: its id without the last part."""
    return F.regexp_replace(example_id, "-[^-]*$", "")


def overlap_f1(pairs: DataFrame, guess: str, gold: str) -> DataFrame:
    """Add ``f1`` (token multiset overlap) and ``exact``; both empty are 1, one empty is 0."""
    p, g = (T.words(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in (guess, gold))
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda a, w: a + F.least(count(p, w), count(g, w)))
    f1 = F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(2.0 * common / (F.size(p) + F.size(g)))
    bare = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return pairs.withColumns({"f1": f1, "exact": bare(guess) == bare(gold)})
