"""Owner scope, filters, joins, aggregates and ordering over the stored tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PRIORITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
LIMITS = (1, 100)


class NotOwned(LookupError):
    """Missing and not owned are the same to a caller."""


def owned(df: DataFrame, user: int, contracts: DataFrame | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """Rows of an owner: directly, through a contract, or through a task and its contract."""
    if tasks is not None:
        ids = tasks.join(owned(contracts, user).select(F.col("id").alias("contract_id")), "contract_id", "left_semi").select(F.col("id").alias("task_id"))
        return df.join(ids, "task_id", "left_semi")
    if contracts is not None:
        return df.join(contracts.where(F.col("user_id") == user).select(F.col("id").alias("contract_id")), "contract_id", "left_semi")
    return df.where(F.col("user_id") == user)


def with_owner(df: DataFrame, contracts: DataFrame) -> DataFrame:
    """Add ``user_id`` through the contract."""
    return df.join(contracts.select(F.col("id").alias("contract_id"), "user_id"), "contract_id")


def require_owned(df: DataFrame, row_id: object, user: int, **scope: DataFrame) -> DataFrame:
    """The one row with this id, or NotOwned."""
    found = owned(df.where(F.col("id") == row_id), user, **scope)
    if found.isEmpty():
        raise NotOwned(row_id)
    return found


def tasks_filtered(tasks: DataFrame, *, priority=None, status=None, due_before=None, due_after=None, requires_review=None, contract_id=None) -> DataFrame:
    """Only the given filters, all of them; bounds are inclusive and drop rows without a date."""
    tests: list[Column] = [F.col(k) == v for k, v in (("priority", priority), ("status", status), ("requires_review", requires_review), ("contract_id", contract_id)) if v is not None]
    tests += [F.col("due_date") <= F.lit(due_before)] if due_before is not None else []
    tests += [F.col("due_date") >= F.lit(due_after)] if due_after is not None else []
    for test in tests:
        tasks = tasks.where(test)
    return tasks


def calendar(tasks: DataFrame, first: datetime.date, last: datetime.date) -> DataFrame:
    """Tasks due within inclusive bounds."""
    if first > last:
        raise ValueError("the range ends before it starts")
    return tasks.where(F.col("due_date").between(F.lit(first), F.lit(last)))


def upcoming(tasks: DataFrame, today: datetime.date, n: int = 5) -> DataFrame:
    return tasks.where(F.col("due_date") >= F.lit(today)).orderBy("due_date", "id").limit(min(max(n, 1), 50))


def deadline_first(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.asc_nulls_last("due_date"), "id")


def page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of an ordered frame; limits outside 1..100 and negative offsets are errors."""
    if not LIMITS[0] <= limit <= LIMITS[1] or offset < 0:
        raise ValueError("limit must be 1..100 and offset at least 0")
    return df.offset(offset).limit(limit)


def priority_rank(column: str = "priority") -> Column:
    out = F
    for i, p in enumerate(PRIORITIES):
        out = out.when(F.col(column) == p, i)
    return out.otherwise(99)


def counts_by_priority(tasks: DataFrame, *keys: str) -> DataFrame:
    return tasks.groupBy(*keys, F.coalesce("priority", F.lit("UNSET")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def dashboard(tasks: DataFrame, today: datetime.date, n: int = 5) -> DataFrame:
    """One row: priority and status counts as maps, the review count, the upcoming ids."""
    m = lambda df, k: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, "n")))).alias(k))
    by_priority = m(counts_by_priority(tasks), "priority")
    by_status = m(tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status")
    review = tasks.agg(F.count_if("requires_review").alias("review"))
    soon = upcoming(tasks, today, n).agg(F.transform(F.sort_array(F.collect_list(F.struct("due_date", "id"))), lambda x: x["id"]).alias("upcoming"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(by_priority).join(one(by_status), "_one").join(one(review), "_one").join(one(soon), "_one").drop("_one")


def contract_detail(contracts: DataFrame, clauses: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each contract with ordered children; children are gathered apart, so they never multiply."""
    kids = lambda df, name, *cols: df.groupBy("contract_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    out = contracts.join(kids(clauses, "clauses", "clause_index", "id"), contracts["id"] == F.col("contract_id"), "left").drop("contract_id")
    return out.join(kids(tasks, "tasks", "id"), out["id"] == F.col("contract_id"), "left").drop("contract_id")


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column], most: int = 1) -> DataFrame:
    """The first rows of each key by an explicit order (one, or a cap)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def quality_gate(tasks: DataFrame, plausible: Column, min_confidence: float = 0.55, min_agent_score: float = 4.0, review_low: bool = True) -> DataFrame:
    """Drop doubtful rows, flag those that deserve a look; 0 stands for no score."""
    kept = tasks.where((F.col("confidence") == 0) | F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    weak = F.lit(min_agent_score > 0) & F.coalesce((F.col("agent_score") != 0) & (F.col("agent_score") < min_agent_score), F.lit(False))
    kept = kept.where(~weak | (F.lit(review_low) & (F.coalesce("confidence", F.lit(0.0)) >= 0.75)))
    return kept.withColumn("requires_review", F.coalesce("requires_review", F.lit(False)) | weak | ~plausible)


def macro_f1(pairs: DataFrame, gold: str, guess: str) -> DataFrame:
    """One row: accuracy, and macro, micro and weighted F1 (a class without a hit counts 0)."""
    both = pairs.groupBy(F.col(gold).alias("g"), F.col(guess).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = both.select(F.explode(F.array(F.struct(F.col("g").alias("c"), F.col("n").alias("s"), F.lit(0).cast("long").alias("q")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("s"), F.col("n").alias("q")))).alias("x"), "g", "p", "n")
    each = sides.groupBy(F.col("x.c").alias("c")).agg(F.sum("x.s").alias("s"), F.sum("x.q").alias("q"), (F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)) / 2).alias("tp"))
    f1 = F.when(F.col("s") + F.col("q") > 0, 2 * F.col("tp") / (F.col("s") + F.col("q"))).otherwise(0.0)
    return each.agg((F.sum("tp") / F.sum("s")).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("s")) / F.sum("s")).alias("weighted_f1"))


def violations(contracts: DataFrame) -> DataFrame:
    """A row for each broken constraint; none is the expected result."""
    tests = {
        "progress in 0..100": F.col("progress_pct").between(0, 100),
        "error only if failed": (F.col("status") == "FAILED") == F.col("error_message").isNotNull(),
        "known status": F.col("status").isin("PENDING", "PROCESSING", "COMPLETE", "FAILED"),
    }
    broken = F.filter(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return contracts.select("id", F.explode(broken).alias("constraint"))


def claim(contracts: DataFrame) -> DataFrame:
    """Compare-and-set: pending and failed contracts start over, others stay as they are."""
    free = F.col("status").isin("PENDING", "FAILED")
    return contracts.withColumns({
        "claimed": free,
        "error_message": F.when(~free, F.col("error_message")),
        "progress_pct": F.when(free, 0).otherwise(F.col("progress_pct")),
        "status": F.when(free, "PROCESSING").otherwise(F.col("status")),
    })


def delete_cascade(ids: DataFrame, contracts: DataFrame, tasks: DataFrame, reminders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of contracts, tasks and reminders when the contracts ``ids`` (id) go."""
    gone = ids.select(F.col("id").alias("contract_id"))
    dead = tasks.join(gone, "contract_id", "left_semi").select(F.col("id").alias("task_id"))
    return contracts.join(ids, "id", "left_anti"), tasks.join(gone, "contract_id", "left_anti"), reminders.join(dead, "task_id", "left_anti")


def deliver_once(due: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """Due rows that weren't delivered; delivering them twice is impossible by their keys."""
    return due.dropDuplicates(keys).join(sent, keys, "left_anti")


def patch(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Audit rows (key, before, after) of effective changes; null in a change means not supplied."""
    both = rows.alias("r").join(changes.alias("c"), key)
    differs = lambda f: F.col(f"c.{f}").isNotNull() & ~F.col(f"c.{f}").eqNullSafe(F.col(f"r.{f}"))
    shown = lambda side: F.to_json(F.struct(*[F.when(differs(f), F.col(f"{side}.{f}").cast("string")).alias(f) for f in fields]))
    changed = differs(fields[0])
    for f in fields[1:]:
        changed = changed | differs(f)
    return both.where(changed).select(key, shown("r").alias("before"), shown("c").alias("after"))


def resolve(tasks: DataFrame, found: DataFrame) -> DataFrame:
    """Tasks (id, clause_id, kind, source_text) with ``found``: the text of one of their clause's (clause_id, ord, kind, found), or null.

    Those of the task's kind go first, and all others only if there is none; among them the first that stands in the
    task's source text wins, else the first that isn't empty. A clause's candidates travel as one array (they are parts of one text).
    """
    listed = found.groupBy("clause_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("kind").alias("kind"), F.trim(F.coalesce("found", F.lit(""))).alias("found")))).alias("_all"))
    both = tasks.drop("found").join(listed, "clause_id", "left")
    same = F.filter("_all", lambda x: x["kind"].eqNullSafe(F.col("kind")))
    given = F.filter(F.when(F.size(same) > 0, same).otherwise(F.col("_all")), lambda x: x["found"] != "")
    grounded = F.filter(given, lambda x: F.instr(F.col("source_text"), x["found"]) > 0)
    return both.withColumn("found", F.coalesce(F.get(grounded, 0)["found"], F.get(given, 0)["found"])).drop("_all")


def alias_map(pairs: DataFrame) -> DataFrame:
    """(alias, name) of (alias, name, place): the last name that an alias was given."""
    return pairs.groupBy("alias").agg(F.max_by("name", "place").alias("name"))


def resolve_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities (text, label, ...) with resolved_name and is_alias: parties and organisations by the alias map (alias, name), themselves if it doesn't have them; null for other labels."""
    named = F.col("label").isin("PARTY", "ORG")
    both = entities.join(aliases.select(F.col("alias").alias("text"), F.col("name").alias("_name")), "text", "left")
    return both.withColumns({"resolved_name": F.when(named, F.coalesce("_name", "text")), "is_alias": F.when(named, F.col("_name").isNotNull())}).drop("_name")


def first_overlap(tokens: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Tokens (key, id, start, end) with ``entity``, the id of the first entity (by start, end, id) of their key that overlaps each, or null. A key is a text; its entities travel as one array."""
    listed = entities.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "id"))).alias("_all"))
    hit = F.get(F.filter("_all", lambda e: (e["start"] < F.col("end")) & (F.col("start") < e["end"])), 0)["id"]
    return tokens.join(listed, key, "left").withColumn("entity", hit).drop("_all")


# Fixed values.
AUDIT_BODY, AUDIT_TINY, AUDIT_HUGE, AUDIT_NOISE = 10, 20, 1500, 30
NOISE_WORDS = ("table of contents", "exhibit", "- i -", "- ii -", "page")
# End of the fixed values.


def audit(clauses: DataFrame) -> DataFrame:
    """heading_only, tiny, huge and noise: how many clauses (heading, body, token_count) are suspect, and why. One row."""
    text = F.lower(F.concat_ws(" ", "heading", "body"))
    noisy = (F.col("token_count") < AUDIT_NOISE) & text.rlike("|".join(NOISE_WORDS))
    tests = {"heading_only": F.length(F.trim(F.coalesce("body", F.lit("")))) < AUDIT_BODY, "tiny": F.col("token_count") < AUDIT_TINY, "huge": F.col("token_count") > AUDIT_HUGE, "noise": noisy}
    return clauses.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def grounding(rows: DataFrame, key: str) -> DataFrame:
    """By ``key`` and for TOTAL: n, ungrounded (actions not in the body), fabricated (parties not in it, whatever the case), abstained (no action), mean_score (of those above 0).

    Rows have action, party, body, score; null and empty texts are none.
    """
    action, party = (F.coalesce(c, F.lit("")) for c in ("action", "party"))
    out = rows.rollup(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((action != "") & (F.instr("body", action) == 0)).alias("ungrounded"),
        F.count_if((party != "") & (F.instr(F.lower("body"), F.lower(party)) == 0)).alias("fabricated"),
        F.count_if(action == "").alias("abstained"),
        F.round(F.avg(F.when(F.col("score") > 0, F.col("score"))), 6).alias("mean_score"),
    )
    return out.withColumn(key, F.coalesce(key, F.lit("TOTAL")))
