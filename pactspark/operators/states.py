"""State changes of stored rows, as full new states and the audit rows that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactspark.functions import text as T


def error_text(kind: Column, detail: Column) -> Column:
    """``Type: detail``, or the type alone without a detail."""
    bare = F.trim(F.coalesce(detail, F.lit("")))
    return F.when(bare != "", F.concat(kind, F.lit(": "), bare)).otherwise(kind)


def fail(contracts: DataFrame, failures: DataFrame) -> DataFrame:
    """Contracts with those of (id, message) failed; an empty message becomes a general one, others lose no field."""
    told = failures.groupBy("id").agg(F.max(F.coalesce("message", F.lit(""))).alias("_told"))
    out = contracts.join(told, "id", "left")
    hit = F.col("_told").isNotNull()
    message = F.when(hit, F.when(F.col("_told") == "", "Pipeline failed").otherwise(F.col("_told"))).otherwise(F.col("error_message"))
    return out.withColumns({"status": F.when(hit, "FAILED").otherwise(F.col("status")), "error_message": message}).select(*contracts.columns)


def mark_read(notifications: DataFrame, ids: DataFrame, user: int, read: bool = True) -> DataFrame:
    """A user's notifications among (id) with their flag set or cleared; others, and those of other users, stay."""
    mine = ids.select("id").distinct().withColumn("_mine", F.lit(True))
    hit = F.col("_mine").isNotNull() & (F.col("user_id") == user)
    return notifications.join(mine, "id", "left").withColumn("read", F.when(hit, F.lit(read)).otherwise(F.col("read"))).select(*notifications.columns)


def register(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """(email, accepted) of each of ``wanted`` (email, place): the first of an address that isn't taken is accepted. Addresses are compared trimmed and in small letters; an empty one is refused."""
    bare = T.normalize_email(F.col("email"))
    asked = wanted.withColumn("email", bare).withColumn("n", F.row_number().over(W.partitionBy("email").orderBy("place")))
    taken = users.select(bare.alias("email")).distinct().withColumn("taken", F.lit(True))
    ok = F.col("taken").isNull() & (F.col("n") == 1) & (F.length("email") > 0)
    return asked.join(taken, "email", "left").select("email", "place", F.coalesce(ok, F.lit(False)).alias("accepted"))


def login(users: DataFrame, tries: DataFrame) -> DataFrame:
    """(email, ok) of tries (email, password_hash): unknown addresses and wrong passwords look the same."""
    bare = T.normalize_email(F.col("email"))
    known = users.select(bare.alias("email"), F.col("password_hash").alias("known"))
    both = tries.withColumn("email", bare).join(known, "email", "left")
    return both.select("email", F.coalesce(F.col("known") == F.col("password_hash"), F.lit(False)).alias("ok"))


def corrections(old: Column, changes: Column) -> Column:
    """Corrections by field, {field: {old, new}}: the latest change of a field replaces an earlier one. Null counts as none."""
    none = F.create_map().cast("map<string, struct<old: string, new: string>>")
    was, now = F.coalesce(old, none), F.coalesce(changes, none)
    return F.map_concat(F.map_filter(was, lambda k, v: ~F.map_contains_key(now, k)), now)


def apply_patch(rows: DataFrame, changes: DataFrame, fields: list[str], uncorrected: tuple[str, ...] = ("status",), key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(new rows, audit rows) of a patch.

    ``rows`` have ``fields`` and ``corrected`` (map of field to struct<old, new>); ``changes`` have the key and, for each
    field, a value that is null where it isn't supplied. Equal values change nothing. Changes of ``uncorrected``
    fields are audited and aren't corrections. A changed row gets one audit row (key, before, after), others none.
    """
    new = changes.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    both = rows.join(new, key, "left")
    differs = {f: F.coalesce(F.col(f"_new_{f}").isNotNull() & ~F.col(f"_new_{f}").eqNullSafe(F.col(f)), F.lit(False)) for f in fields}
    entry = lambda f: F.struct(F.lit(f).alias("key"), F.struct(F.col(f).cast("string").alias("old"), F.col(f"_new_{f}").cast("string").alias("new")).alias("value"))
    kept = [f for f in fields if f not in uncorrected]
    made = F.map_from_entries(F.filter(F.array(*[F.when(differs[f], entry(f)) for f in kept]), lambda x: x.isNotNull()))
    state = both.withColumn("corrected", corrections(F.col("corrected"), made)).withColumns({f: F.when(differs[f], F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields})
    shown = lambda side: F.to_json(F.struct(*[F.when(differs[f], F.col(f"{side}{f}").cast("string")).alias(f) for f in fields]))
    audit = both.where(T.any_of(list(differs.values()))).select(key, shown("").alias("before"), shown("_new_").alias("after"))
    return state.select(*rows.columns), audit


def cascade(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What stays of contracts, clauses, tasks, reminders and notifications when the contracts ``ids`` (id) go.

    Reminders and notifications go with their task; a notification without a task stays.
    """
    gone = ids.select(F.col("id").alias("contract_id")).distinct()
    dead = tables["tasks"].join(gone, "contract_id", "left_semi").select(F.col("id").alias("task_id"))
    out = {"contracts": tables["contracts"].join(ids.select("id"), "id", "left_anti")}
    out |= {n: tables[n].join(gone, "contract_id", "left_anti") for n in ("clauses", "tasks") if n in tables}
    return out | {n: tables[n].join(dead, "task_id", "left_anti") for n in ("reminders", "notifications") if n in tables}


def surrogate_ids(rows: DataFrame, key: str, out: str = "surrogate_id") -> DataFrame:
    """Add an id that follows from the key alone (positive, 63 bits), so that a second run gives the same."""
    return rows.withColumn(out, F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1)))


def to_utc_midnight(day: Column) -> Column:
    """A date's first instant in UTC, whatever the session's zone; null stays null."""
    return F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
