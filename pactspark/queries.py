"""All registered queries and their SQL twins.

A query reads the views of :mod:`pactspark.sources.tables` and applies operators; its
twin says the same in SQL over the same views.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactspark.functions import dates as D
from pactspark.functions import numbers as N
from pactspark.functions import text as T
from pactspark.operators import relational as R
from pactspark.operators import segments as S
from pactspark.plans import curation as C
from pactspark.sources.tables import AS_OF, view, with_views
from pactspark.streaming import STAGE_PROGRESS, first_use, latest_progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TODAY = datetime.date.fromisoformat(AS_OF)
USER = 7
View = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None):
    """Register f(view) under a name, with its SQL twin."""

    def add(f: Callable[[View], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: view(spark, sf_dir, n))
        if sql:
            ORACLE[name] = with_views(sql)
        return f

    return add


_TASK = "id, contract_id, due_date, priority, status, requires_review"
_COLUMNS = _TASK.split(", ")

# --- owner scope, filters -------------------------------------------------------------------


@query("contracts_for_user", f"SELECT id, user_id, status FROM contracts WHERE user_id = {USER}")
def _(v):
    return R.owned(v("contracts"), USER).select("id", "user_id", "status")


@query("tasks_for_user", f"SELECT t.id, t.contract_id, t.priority FROM tasks t JOIN contracts c ON c.id = t.contract_id WHERE c.user_id = {USER}")
def _(v):
    return R.owned(v("tasks"), USER, v("contracts")).select("id", "contract_id", "priority")


@query("reminders_for_user", f"SELECT r.task_id, r.days_before, r.remind_on FROM reminders r JOIN contracts c ON c.id = r.contract_id WHERE c.user_id = {USER}")
def _(v):
    mine = v("contracts").where(F.col("user_id") == USER).select(F.col("id").alias("contract_id"))
    return v("reminders").join(mine, "contract_id", "left_semi").select("task_id", "days_before", "remind_on")


@query("owned_semi", f"SELECT status, count(*) AS n FROM tasks WHERE contract_id IN (SELECT id FROM contracts WHERE user_id = {USER}) GROUP BY status")
def _(v):
    return R.owned(v("tasks"), USER, v("contracts")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("tasks_filtered", f"SELECT {_TASK} FROM tasks WHERE priority = 'HIGH' AND due_date <= DATE '1998-12-31' AND due_date >= DATE '1995-01-01' AND NOT requires_review")
def _(v):
    return R.tasks_filtered(v("tasks"), priority="HIGH", due_before=datetime.date(1998, 12, 31), due_after=datetime.date(1995, 1, 1), requires_review=False).select(*_COLUMNS)


@query("calendar_window", f"SELECT {_TASK} FROM tasks WHERE due_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'")
def _(v):
    return R.calendar(v("tasks"), datetime.date(1997, 1, 1), datetime.date(1997, 3, 31)).select(*_COLUMNS)


@query("upcoming_deadlines", f"SELECT id, due_date FROM tasks WHERE due_date >= DATE '{AS_OF}' ORDER BY due_date, id LIMIT 5")
def _(v):
    return R.upcoming(v("tasks"), TODAY).select("id", "due_date")


@query("review_queue", f"SELECT {_TASK} FROM tasks WHERE requires_review")
def _(v):
    return R.deadline_first(v("tasks").where("requires_review")).select(*_COLUMNS)


@query("contracts_by_status", "SELECT id, user_id FROM contracts WHERE status = 'PROCESSING'")
def _(v):
    return v("contracts").where("status = 'PROCESSING'").select("id", "user_id")


@query("due_reminders", f"SELECT task_id, days_before FROM reminders WHERE remind_on <= DATE '{AS_OF}' AND NOT sent")
def _(v):
    return v("reminders").where((F.col("remind_on") <= F.lit(TODAY)) & ~F.col("sent")).select("task_id", "days_before")


_in = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"


@query("gate_clause_type", f"SELECT id, clause_type, clause_type NOT IN {_in(T.SKIPPED_BY_EXTRACTION)} AS extracted, clause_type NOT IN {_in(T.SKIPPED_BY_TASKS)} AS tasked FROM lines")
def _(v):
    c = F.upper("clause_type")
    return v("lines").select("id", "clause_type", (~c.isin(T.SKIPPED_BY_EXTRACTION)).alias("extracted"), (~c.isin(T.SKIPPED_BY_TASKS)).alias("tasked"))


@query("gate_recitals", f"SELECT id, body FROM lines WHERE NOT regexp_matches(upper(left(body, 200)), '{T.RECITAL}') AND length(trim(body)) >= 20")
def _(v):
    return v("lines").where(~F.upper(F.left("body", F.lit(200))).rlike(T.RECITAL) & (F.length(F.trim("body")) >= 20)).select("id", "body")


@query("modal_gate", f"SELECT id FROM lines WHERE regexp_matches(body, '{T.ANY_MODAL}')")
def _(v):
    return v("lines").where(F.col("body").rlike(T.ANY_MODAL)).select("id")


@query("drop_boilerplate", f"SELECT id, heading FROM lines WHERE NOT regexp_matches(heading, '{T.BOILERPLATE_HEADING}')")
def _(v):
    return v("lines").where(~F.col("heading").rlike(T.BOILERPLATE_HEADING)).select("id", "heading")


@query("length_filter", "SELECT id FROM lines WHERE length(body) BETWEEN 50 AND 1500 AND length(body) - length(replace(body, '.', '')) <= 15 AND length(body) - length(replace(body, '_', '')) <= 5")
def _(v):
    b = F.col("body")
    return v("lines").where(F.length(b).between(50, 1500) & (F.regexp_count(b, F.lit(r"\.")) <= 15) & (F.regexp_count(b, F.lit("_")) <= 5)).select("id")


_PLAUSIBLE = f"(party <> '' AND len(regexp_extract_all(party, '\\S+')) <= 8 AND NOT regexp_matches(party, '{T.NON_PARTY}'))"


def _gate(name: str, conf: float, agent: float) -> None:
    weak = f"({agent} > 0 AND agent_score <> 0 AND agent_score < {agent})"
    sql = f"SELECT id, requires_review OR {weak} OR NOT {_PLAUSIBLE} AS requires_review FROM tasks WHERE (confidence = 0 OR confidence >= {conf}) AND (NOT {weak} OR confidence >= 0.75)"
    query(name, sql)(lambda v: R.quality_gate(v("tasks"), T.plausible_party(F.col("party")), conf, agent).select("id", "requires_review"))


_gate("quality_gate", 0.55, 4.0)
_gate("quality_gate_permissive", 0.45, 0.0)
_gate("quality_gate_strict", 0.70, 6.0)


@query("plausible_party", f"SELECT id, {_PLAUSIBLE} AS plausible FROM tasks")
def _(v):
    return v("tasks").select("id", T.plausible_party(F.col("party")).alias("plausible"))


@query("filter_permissions", "SELECT id, obligation_type, priority FROM tasks WHERE obligation_type <> 'PERMISSION' AND priority IS DISTINCT FROM 'LOW'")
def _(v):
    return v("tasks").where((F.col("obligation_type") != "PERMISSION") & ~F.col("priority").eqNullSafe("LOW")).select("id", "obligation_type", "priority")


@query("unresolved_deadline", "SELECT id, upper(date_type) IN ('RELATIVE', 'CONDITIONAL') AND due_date IS NULL AS unresolved FROM tasks WHERE date_type IS NOT NULL")
def _(v):
    return v("tasks").where("date_type IS NOT NULL").select("id", (F.upper("date_type").isin("RELATIVE", "CONDITIONAL") & F.col("due_date").isNull()).alias("unresolved"))


@query("project_deadline_entry", "SELECT id, contract_id, concat(coalesce(priority, 'UNSET'), ' ', obligation_type) AS title, due_date, date_type, status FROM tasks WHERE due_date IS NOT NULL")
def _(v):
    return v("tasks").where("due_date IS NOT NULL").select("id", "contract_id", F.concat_ws(" ", F.coalesce("priority", F.lit("UNSET")), "obligation_type").alias("title"), "due_date", "date_type", "status")


@query("persist_tasks", "SELECT id, CASE WHEN upper(coalesce(date_type, '')) IN ('RELATIVE', 'CONDITIONAL') THEN NULL ELSE due_date END AS due_date, least(agent_score, 1.0::DOUBLE) AS agent_score, nullif(party, '') AS party, 'PENDING' AS status FROM tasks")
def _(v):
    open_ = F.upper(F.coalesce("date_type", F.lit(""))).isin("RELATIVE", "CONDITIONAL")
    return v("tasks").select("id", F.when(~open_, F.col("due_date")).alias("due_date"), N.clamp_unit(F.col("agent_score")).alias("agent_score"), F.nullif("party", F.lit("")).alias("party"), F.lit("PENDING").alias("status"))


# --- joins ----------------------------------------------------------------------------------


@query("contract_detail", """SELECT c.id, coalesce(k.clauses, '') AS clauses, coalesce(t.n, 0) AS n_tasks FROM contracts c
LEFT JOIN (SELECT contract_id, string_agg(concat(clause_index, ':', id), ',' ORDER BY clause_index, id) AS clauses FROM lines GROUP BY 1) k ON k.contract_id = c.id
LEFT JOIN (SELECT contract_id, count(*) AS n FROM tasks GROUP BY 1) t ON t.contract_id = c.id""")  # fmt: skip
def _(v):
    d = R.contract_detail(v("contracts").select("id"), v("lines").select("contract_id", "clause_index", "id"), v("tasks").select("contract_id", "id"))
    listed = F.array_join(F.transform("clauses", lambda x: F.concat(x["clause_index"].cast("string"), F.lit(":"), x["id"])), ",")
    return d.select("id", F.coalesce(listed, F.lit("")).alias("clauses"), F.coalesce(F.size("tasks"), F.lit(0)).cast("long").alias("n_tasks"))


@query("merge_clause_views", "SELECT l.id, l.body, coalesce(t.priority, '') AS priority, coalesce(t.confidence, 0) AS confidence, coalesce(t.requires_review, false) AS needs_review FROM lines l LEFT JOIN tasks t ON t.id = l.id AND t.status = 'PENDING'")
def _(v):
    t = v("tasks").where("status = 'PENDING'").select("id", "priority", "confidence", "requires_review")
    return v("lines").join(t, "id", "left").select("id", "body", F.coalesce("priority", F.lit("")).alias("priority"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("requires_review", F.lit(False)).alias("needs_review"))


@query("best_deadline", """SELECT contract_id, arg_min(id, (CASE upper(date_type) WHEN 'ABSOLUTE' THEN 0 WHEN 'RELATIVE' THEN 1 WHEN 'RECURRING' THEN 2 WHEN 'CONDITIONAL' THEN 3 ELSE 9 END, clause_index, id)) AS best
FROM tasks GROUP BY contract_id""")
def _(v):
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("ABSOLUTE", "RELATIVE", "RECURRING", "CONDITIONAL")]), F.upper("date_type")), F.lit(0))
    rank = F.when(rank == 0, 9).otherwise(rank - 1)
    return v("tasks").groupBy("contract_id").agg(F.min_by("id", F.struct(rank, "clause_index", "id")).alias("best"))


@query("overlap_anti", """SELECT a.id FROM lines a WHERE a.n % 2 = 0 AND NOT EXISTS (SELECT 1 FROM lines b WHERE b.contract_id = a.contract_id AND b.n % 2 = 1
AND a.n < b.n + 3 AND b.n < a.n + 3)""")
def _(v):
    spans = v("lines").select("contract_id", "id", F.col("n").alias("start"), (F.col("n") + 3).alias("end"))
    return S.overlap_anti(spans.where("start % 2 = 0"), spans.where("start % 2 = 1"), "contract_id").select("id")


# --- aggregates -----------------------------------------------------------------------------


@query("counts_by_priority", "SELECT c.user_id, coalesce(t.priority, 'UNSET') AS priority, count(*) AS n FROM tasks t JOIN contracts c ON c.id = t.contract_id GROUP BY 1, 2")
def _(v):
    return R.counts_by_priority(R.with_owner(v("tasks"), v("contracts")), "user_id")


@query("counts_by_status", "SELECT c.user_id, t.status, count(*) AS n FROM tasks t JOIN contracts c ON c.id = t.contract_id GROUP BY 1, 2")
def _(v):
    return R.with_owner(v("tasks"), v("contracts")).groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("review_count", "SELECT c.user_id, count(*) FILTER (t.requires_review) AS n FROM tasks t JOIN contracts c ON c.id = t.contract_id GROUP BY 1")
def _(v):
    return R.with_owner(v("tasks"), v("contracts")).groupBy("user_id").agg(F.count_if("requires_review").alias("n"))


@query("dashboard_summary", f"""SELECT (SELECT string_agg(concat(p, '=', n), ',' ORDER BY p) FROM (SELECT coalesce(priority, 'UNSET') AS p, count(*) AS n FROM tasks GROUP BY 1)) AS priority,
(SELECT string_agg(concat(status, '=', n), ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM tasks GROUP BY 1)) AS status, (SELECT count(*) FROM tasks WHERE requires_review) AS review,
(SELECT string_agg(id, ',' ORDER BY due_date, id) FROM (SELECT id, due_date FROM tasks WHERE due_date >= DATE '{AS_OF}' ORDER BY due_date, id LIMIT 5)) AS upcoming""")
def _(v):
    d = R.dashboard(v("tasks"), TODAY)
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return d.select(flat("priority").alias("priority"), flat("status").alias("status"), "review", F.array_join("upcoming", ",").alias("upcoming"))


@query("entity_summary", "SELECT contract_id, string_agg(clause_type, ',' ORDER BY first) AS types FROM (SELECT contract_id, clause_type, min((clause_index, id)) AS first FROM lines GROUP BY 1, 2) GROUP BY 1")
def _(v):
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("clause_index", "id", "clause_type"))), lambda x: x["clause_type"])
    return v("lines").groupBy("contract_id").agg(F.array_join(F.array_distinct(kinds), ",").alias("types"))


_TOKENS = "CAST(floor(len(regexp_extract_all(body, '\\S+')) * 1.3::DOUBLE) AS BIGINT)"


@query("clause_stats", f"SELECT clause_type, count(*) AS n, count(*) FILTER ({_TOKENS} > 15) AS oversized, round_even(avg({_TOKENS}), 1) AS avg_tokens, max({_TOKENS}) AS most, min({_TOKENS}) AS least FROM lines GROUP BY 1")
def _(v):
    n = T.token_count(F.col("body"))
    return v("lines").select("clause_type", n.alias("t")).groupBy("clause_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") > 15).alias("oversized"), F.bround(F.avg("t"), 1).alias("avg_tokens"), F.max("t").alias("most"), F.min("t").alias("least")
    )


@query("missing_sections", "SELECT contract_id, string_agg(CAST(g AS VARCHAR), ',' ORDER BY g) AS missing FROM (SELECT contract_id, unnest(generate_series(min(clause_index), max(clause_index))) AS g FROM lines GROUP BY 1) s WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.contract_id = s.contract_id AND l.clause_index = s.g) GROUP BY 1")
def _(v):
    found = v("lines").groupBy("contract_id").agg(F.collect_set("clause_index").alias("seen"), F.sequence(F.min("clause_index"), F.max("clause_index")).alias("all"))
    gaps = found.select("contract_id", F.array_sort(F.array_except("all", "seen")).alias("gaps")).where(F.size("gaps") > 0)
    return gaps.select("contract_id", F.array_join(F.col("gaps").cast("array<string>"), ",").alias("missing"))


@query("rank_contracts", "SELECT contract_id, count(*) AS tasks, count(due_date) AS dated, count(*) FILTER (requires_review) AS review FROM tasks GROUP BY 1 ORDER BY dated DESC, tasks DESC, contract_id LIMIT 20")
def _(v):
    t = v("tasks").groupBy("contract_id").agg(F.count(F.lit(1)).alias("tasks"), F.count("due_date").alias("dated"), F.count_if("requires_review").alias("review"))
    return t.orderBy(F.desc("dated"), F.desc("tasks"), "contract_id").limit(20)


@query("top3_alternatives", "SELECT vec_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) AS r FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)) WHERE r <= 3 GROUP BY 1")
def _(v):
    pairs = F.transform("embedding", lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return v("embeddings").select("vec_id", F.array_join(F.transform(F.slice(F.array_sort(pairs), 1, 3), lambda p: p["i"].cast("string")), ",").alias("top"))


@query("class_weights", "SELECT clause_type, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE), 6) AS weight FROM lines GROUP BY 1")
def _(v):
    n = v("lines").groupBy("clause_type").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))).select("clause_type", F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))


@query("rarest_class", "SELECT clause_type FROM lines GROUP BY 1 ORDER BY count(*), clause_type LIMIT 1")
def _(v):
    n = v("lines").groupBy("clause_type").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min_by("clause_type", F.struct("n", "clause_type")).alias("clause_type"))


@query("f1_scores", """WITH c AS (SELECT g, count(*) AS s FROM (SELECT quality AS g FROM labels) GROUP BY 1), p AS (SELECT g, count(*) AS q FROM (SELECT toxic AS g FROM labels) GROUP BY 1),
h AS (SELECT quality AS g, count(*) AS tp FROM labels WHERE quality = toxic GROUP BY 1),
a AS (SELECT coalesce(c.g, p.g) AS g, coalesce(s, 0) AS s, coalesce(q, 0) AS q, coalesce(tp, 0) AS tp FROM c FULL JOIN p ON c.g = p.g LEFT JOIN h ON h.g = coalesce(c.g, p.g))
SELECT round(sum(tp) / sum(s)::DOUBLE, 9) AS accuracy, round(avg(2.0::DOUBLE * tp / (s + q)), 9) AS macro_f1, round(sum(2.0::DOUBLE * tp / (s + q) * s) / sum(s), 9) AS weighted_f1 FROM a""")
def _(v):
    f = R.macro_f1(v("labels"), "quality", "toxic")
    return f.select(*[F.round(c, 9).alias(c) for c in f.columns])


@query("classification_summary", "SELECT count(*) FILTER (confidence < 0.75) AS needs_review, round(avg(confidence), 9) AS avg_confidence FROM tasks WHERE status <> 'DONE'")
def _(v):
    return v("tasks").where("status <> 'DONE'").agg(F.count_if(F.col("confidence") < 0.75).alias("needs_review"), F.round(F.avg("confidence"), 9).alias("avg_confidence"))


@query("high_conf_rate", "SELECT count(*) FILTER (status = 'DONE') AS filtered, count(*) FILTER (status <> 'DONE') AS classified, round(count(*) FILTER (status <> 'DONE' AND confidence >= 0.75) / count(*) FILTER (status <> 'DONE')::DOUBLE, 9) AS rate FROM tasks")
def _(v):
    c = F.col("status") != "DONE"
    t = v("tasks").agg(F.count_if(~c).alias("filtered"), F.count_if(c).alias("classified"), F.count_if(c & (F.col("confidence") >= 0.75)).alias("high"))
    return t.select("filtered", "classified", F.round(F.col("high") / F.col("classified"), 9).alias("rate"))


@query("overlap_f1", """WITH p AS (SELECT a.conv_id, a.turn, coalesce(a.text, '') AS x, coalesce(b.text, '') AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
w AS (SELECT conv_id, turn, side, word, count(*) AS n FROM (SELECT conv_id, turn, 1 AS side, unnest(regexp_extract_all(lower(x), '\\S+')) AS word FROM p UNION ALL SELECT conv_id, turn, 2, unnest(regexp_extract_all(lower(y), '\\S+')) FROM p) GROUP BY ALL),
c AS (SELECT a.conv_id, a.turn, sum(least(a.n, b.n)) AS common FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.word = b.word AND a.side = 1 AND b.side = 2 GROUP BY ALL),
s AS (SELECT conv_id, turn, coalesce(sum(n) FILTER (side = 1), 0) AS k, coalesce(sum(n) FILTER (side = 2), 0) AS g FROM w GROUP BY ALL)
SELECT p.conv_id, p.turn, round(CASE WHEN coalesce(k, 0) = 0 AND coalesce(g, 0) = 0 THEN 1.0 WHEN k = 0 OR g = 0 THEN 0.0 ELSE 2.0::DOUBLE * coalesce(common, 0) / (k + g) END, 9)::DOUBLE AS f1,
lower(trim(x)) = lower(trim(y)) AS exact FROM p LEFT JOIN s ON s.conv_id = p.conv_id AND s.turn = p.turn LEFT JOIN c ON c.conv_id = p.conv_id AND c.turn = p.turn""")
def _(v):
    turns = v("conversations").select("conv_id", "turn", F.col("text").alias("a"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return C.overlap_f1(turns.join(following, ["conv_id", "turn"]), "a", "b").select("conv_id", "turn", F.round("f1", 9).alias("f1"), "exact")


# --- order, windows, dedupe -----------------------------------------------------------------


@query("tasks_deadline_first", f"SELECT {_TASK} FROM tasks ORDER BY due_date ASC NULLS LAST, id LIMIT 100")
def _(v):
    return R.deadline_first(v("tasks")).limit(100).select(*_COLUMNS)


@query("contracts_newest", "SELECT id, created_on FROM contracts ORDER BY created_on DESC, id DESC LIMIT 50")
def _(v):
    return v("contracts").orderBy(F.desc("created_on"), F.desc("id")).limit(50).select("id", "created_on")


@query("paginate", "SELECT id, created_on FROM contracts ORDER BY created_on DESC, id DESC LIMIT 20 OFFSET 40")
def _(v):
    return R.page(v("contracts").orderBy(F.desc("created_on"), F.desc("id")), 20, 40).select("id", "created_on")


_RANK = "CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 99 END"


@query("priority_sort", f"SELECT id, {_RANK} AS rank, row_number() OVER (PARTITION BY contract_id ORDER BY {_RANK}, clause_index, id) AS place FROM tasks")
def _(v):
    w = W.partitionBy("contract_id").orderBy("rank", "clause_index", "id")
    return v("tasks").withColumn("rank", R.priority_rank()).select("id", "rank", F.row_number().over(w).cast("long").alias("place"))


@query("dedupe_first", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(party), obligation_type, due_date ORDER BY id) AS r FROM tasks) WHERE r = 1")
def _(v):
    return R.keep_first(v("tasks"), [F.lower("party"), "obligation_type", "due_date"], ["id"]).select("id")


@query("dedupe_prefix", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(left(text, 200)) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def _(v):
    return R.keep_first(v("documents").select("doc_id", "text"), [F.lower(F.substring("text", 1, 200))], ["doc_id"]).select("doc_id")


@query("dedupe_md5", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(trim(lower(text)))")
def _(v):
    return v("documents").groupBy(T.text_key(F.col("text")).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("cap_per_group", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY contract_id ORDER BY clause_index, id) AS r FROM lines) WHERE r <= 2")
def _(v):
    return R.keep_first(v("lines"), ["contract_id"], ["clause_index", "id"], 2).select("id")


@query("anchor_date", "SELECT contract_id, arg_min(day, (clause_index, id)) AS anchor FROM lines WHERE clause_index < 5 GROUP BY 1")
def _(v):
    return v("lines").where("clause_index < 5").groupBy("contract_id").agg(F.min_by("day", F.struct("clause_index", "id")).alias("anchor"))


@query("clause_index", "SELECT id, row_number() OVER (PARTITION BY contract_id ORDER BY clause_index, id) - 1 AS place FROM lines")
def _(v):
    return v("lines").select("id", (F.row_number().over(W.partitionBy("contract_id").orderBy("clause_index", "id")) - 1).cast("long").alias("place"))


@query("carry_forward", """SELECT id, CASE WHEN lag(heading LIKE 'EXHIBIT%') OVER w THEN concat(lag(heading) OVER w, ' — ', heading) ELSE heading END AS heading FROM lines WINDOW w AS (PARTITION BY contract_id ORDER BY clause_index, id)
QUALIFY heading NOT LIKE 'EXHIBIT%'""")
def _(v):
    n = F.row_number().over(W.partitionBy("contract_id").orderBy("clause_index", "id"))
    rows = v("lines").select("id", F.col("contract_id").alias("doc_id"), n.alias("clause_index"), "heading", F.lit("").alias("body"))
    return S.carry_forward(rows).select("id", "heading")


# --- segmentation on documents' lines -------------------------------------------------------


@query("scan_doc_items", "SELECT doc_id, CAST(pos - 1 AS INT) AS item_idx, length(line) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)")
def _(v):
    return v("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("item_idx", "line")).select("doc_id", "item_idx", F.length("line").cast("long").alias("n_chars"))


@query("segment_items", """WITH i AS (SELECT contract_id, clause_index, id, heading, row_number() OVER (PARTITION BY contract_id ORDER BY clause_index, id) AS item, n % 3 = 0 AS head, body FROM lines),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY contract_id ORDER BY item ROWS UNBOUNDED PRECEDING) AS grp FROM i)
SELECT contract_id AS doc_id, row_number() OVER (PARTITION BY contract_id ORDER BY grp) - 1 AS clause_index, coalesce(max(CASE WHEN head THEN concat('H', id) END), 'PREAMBLE') AS heading,
coalesce(string_agg(CASE WHEN NOT head THEN lower(body) END, ' ' ORDER BY item), '') AS body FROM g GROUP BY contract_id, grp""")
def _(v):
    n = F.row_number().over(W.partitionBy("contract_id").orderBy("clause_index", "id"))
    head = F.col("n") % 3 == 0
    items = v("lines").select(
        F.col("contract_id").alias("doc_id"), n.alias("item_idx"), F.when(head, "section_header").otherwise("text").alias("label"), F.when(head, F.concat(F.lit("H"), "id")).otherwise(F.lower("body")).alias("text"), F.lit(1).alias("page_no")
    )
    return S.segment_items(items).select("doc_id", F.col("clause_index").cast("long").alias("clause_index"), "heading", "body")


# --- scalar functions over clauses ----------------------------------------------------------

_MODAL_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(body, '(?i)\\b({m})\\b', 1), '')" for m in T.RANKED_MODALS) + ")"
_PROHIBITED = f"CASE WHEN kind = 'OBLIGATION' AND regexp_matches(body, '{T.PROHIBITION}') THEN 'PROHIBITION' ELSE kind END"
_VERBS = ", ".join(f"'{w}'" for w in T.ACTION_VERBS)
_CUT = "least(" + ", ".join(f"coalesce(nullif(instr(lower(body), '{m}'), 0) - 1, length(body))" for m in T.ACTION_MARKERS) + ")"
_LABEL_SQL = "CASE " + " ".join(f"WHEN regexp_matches(body, '(?i)\\b(?:{p})\\b') THEN '{k}'" for k, p in D.LABELS.items()) + " ELSE CASE clause_type " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in D.LABEL_OF_TYPE.items()) + " ELSE 'Contractual Deadline' END END"
_NUMBER_SQL = (
    "coalesce(TRY_CAST(nullif(regexp_extract(body, '\\(\\s*(\\d+)\\s*\\)', 1), '') AS INT), TRY_CAST(nullif(replace(regexp_extract(body, '^\\s*(\\d[\\d,]*)', 1), ',', ''), '') AS INT), "
    "CASE WHEN regexp_matches(body, '(?i)twenty-five') THEN 25 END, CASE WHEN regexp_matches(body, '(?i)\\bsixty\\b') THEN 60 END)"
)
#: key: columns as name: (Spark, DuckDB), over the view ``lines``.
SCALARS = {
    "token_count": {"tokens": (T.token_count, _TOKENS)},
    "heading_number": {"number": (lambda b: T.heading_number(F.col("heading")), f"nullif(regexp_extract(trim(heading), '{T.HEADING_NUMBER}', 1), '')")},
    "is_missed_heading": {"missed": (lambda b: T.is_missed_heading(F.col("heading")), "heading NOT IN ('RECITALS', '2. the parties shall agree')")},
    "is_title_like": {"title": (lambda b: T.is_title_like(F.col("heading")), "heading <> '2. the parties shall agree'")},
    "strip_page_tail": {"body": (lambda b: F.regexp_replace(b, T.PAGE_TAIL, ""), "regexp_replace(body, '\\s*Page\\s+\\d+\\s+of\\s+\\d+\\s*$', '')")},
    "primary_modal": {"modal": (T.primary_modal, _MODAL_SQL)},
    "obligation_subtype": {
        "kind": (
            lambda b: T.obligation_subtype(F.when(F.col("n") % 2 == 0, "OBLIGATION").otherwise("PERMISSION"), b),
            f"(SELECT CASE WHEN k IN ('OBLIGATION', 'PROHIBITION') AND regexp_matches(body, '{T.CONDITIONAL}') THEN 'CONDITIONAL' ELSE k END FROM (SELECT {_PROHIBITED} AS k FROM (SELECT CASE WHEN n % 2 = 0 THEN 'OBLIGATION' ELSE 'PERMISSION' END AS kind)))",
        )
    },
    "first_action_verb": {"verb": (T.first_action_verb, f"list_filter(list_slice(regexp_extract_all(lower(body), '[a-z]+'), 1, 30), lambda w: w IN ({_VERBS}))[1]")},
    "is_signature_block": {"signature": (lambda b: T.is_signature_block(F.col("heading"), b), "body LIKE 'By: Name%'")},
    "signature_rule2": {"signature": (lambda b: T.signature_rule2(b, T.token_count(b)), f"body LIKE 'By: Name%' OR ({_TOKENS} <= 20 AND NOT regexp_matches(lower(body), '{T.LEGAL_VERBS}'))")},
    "is_preamble": {"preamble": (lambda b: T.is_preamble(F.col("heading"), b, T.token_count(b)), "heading = 'RECITALS' OR body LIKE 'WHEREAS%'")},
    "renewal_signal": {"renewal": (T.renewal_signal, f"regexp_matches(lower(body), '{T.RENEWAL}')")},
    "estimate_modality": {"modality": (T.estimate_modality, f"CASE WHEN regexp_matches(lower(body), '{T.MODALITY_PROHIBITION}') THEN 'PROHIBITION' WHEN regexp_matches(lower(body), '{T.MODALITY_PERMISSION}') THEN 'PERMISSION' WHEN regexp_matches(lower(body), '{T.MODALITY_OBLIGATION}') THEN 'OBLIGATION' ELSE 'DECLARATIVE' END")},
    "trim_action": {"action": (T.trim_action, f"rtrim(left(body, {_CUT}), ' ,;:.-')")},
    "format_input": {"input": (lambda b: T.format_input(F.col("heading"), b), "concat(rtrim(trim(regexp_replace(heading, '^\\d+(\\.\\d+)*\\.?\\s*', '')), '.'), ': ', body)")},
    "parse_definition": {
        "term": (lambda b: T.parse_definition(b, 1), "CASE WHEN body LIKE '\"Net Revenue\"%' THEN 'Net Revenue' WHEN body LIKE 'By: Name%' THEN 'By' ELSE '' END"),
        "definition": (lambda b: T.parse_definition(b, 2), "CASE WHEN body LIKE '\"Net Revenue\"%' THEN 'all amounts received by the Company.' WHEN body LIKE 'By: Name%' THEN 'Name: J. Doe  Title: President' ELSE body END"),
    },
    "clamp_action": {"action": (T.clamp_action, "CASE WHEN len(regexp_extract_all(body, '\\S+')) <= 12 THEN body ELSE concat(array_to_string(list_slice(regexp_extract_all(body, '\\S+'), 1, 12), ' '), '…') END")},
    "span_offsets": {"start": (lambda b: T.span_start(b, F.lit("the ")), "CAST(nullif(instr(body, 'the '), 0) - 1 AS INT)")},
    "locate_span": {"start": (lambda b: T.locate_span(b, F.lit("THIS")), "CAST(coalesce(nullif(instr(body, 'THIS'), 0), nullif(instr(lower(body), 'this'), 0)) - 1 AS INT)")},
    "normalize_email": {"email": (lambda b: T.normalize_email(F.concat(F.lit(" User@"), F.col("id"))), "lower(trim(concat(' User@', id)))")},
    "find_durations": {"durations": (lambda b: F.array_join(F.regexp_extract_all(b, F.lit(T.DURATION), 0), "|"), f"array_to_string(regexp_extract_all(body, '{T.DURATION}'), '|')")},
    "inr_money": {"money": (lambda b: F.array_join(F.regexp_extract_all(b, F.lit(T.INR), 0), "|"), "array_to_string(regexp_extract_all(body, '(?i)\\bRs\\.?\\s*[\\d,]+'), '|')")},
    "alias_triggers": {"alias": (lambda b: F.nullif(F.regexp_extract(b, T.ALIAS, 1), F.lit("")), "nullif(regexp_extract(body, '\\(the \"([^\"]+)\"\\)', 1), '')")},
    "parse_number": {"n_found": (N.parse_number, _NUMBER_SQL)},
    "parse_unit": {"unit": (N.parse_unit, "CASE WHEN regexp_matches(body, '(?i)business\\s+days?') THEN 'business_days' WHEN regexp_matches(body, '(?i)\\bdays?\\b') THEN 'days' WHEN regexp_matches(body, '(?i)\\bmonths?\\b') THEN 'months' WHEN regexp_matches(body, '(?i)\\byears?\\b') THEN 'years' ELSE 'days' END")},
    "deadline_label": {"label": (lambda b: D.deadline_label(b, F.col("clause_type")), _LABEL_SQL)},
    "event_relative": {"event": (lambda b: D.event_relative(F.lit("days"), b), "regexp_matches(body, 'after receipt of notice')")},
    "date_kind": {"kind": (D.date_kind, f"CASE WHEN regexp_matches(body, '{D.RECURRING}') THEN 'RECURRING' ELSE 'CONDITIONAL' END")},
    "parse_absolute": {"day_found": (lambda b: D.parse_absolute(F.date_format("day", "MMMM d, yyyy")), "day")},
    "business_days": {"later": (lambda b: D.business_days(F.col("day"), F.col("n") % 12 + 1), "CAST(list_filter(generate_series(day + 1, day + 40, INTERVAL 1 DAY), lambda d: isodow(d) < 6)[n % 12 + 1] AS DATE)")},
    "resolve_relative": {"due": (lambda b: D.resolve_relative(F.concat(F.col("n").cast("string"), F.lit(" months")), F.col("day")), "CAST(day + to_months(n) AS DATE)")},
    "task_priority": {"priority": (lambda b: D.task_priority(F.col("clause_type"), F.lit("OBLIGATION"), F.when(F.col("n") % 2 == 0, F.col("day")), F.lit("ABSOLUTE"), F.lit(TODAY)), f"CASE WHEN clause_type = 'PAYMENT' AND n % 2 = 0 THEN CASE WHEN day - DATE '{AS_OF}' < 30 THEN 'CRITICAL' ELSE 'HIGH' END WHEN clause_type IN ('TERMINATION', 'RENEWAL') THEN 'HIGH' ELSE 'MEDIUM' END")},
    "reminder_dates": {"reminders": (lambda b: F.array_join(D.reminder_dates(F.col("day"), F.lit(TODAY)).cast("array<string>"), ","), f"array_to_string(list_filter([day - 90, day - 30, day - 7, day - 1], lambda d: d >= DATE '{AS_OF}'), ',')")},
    "clamp_unit": {"unit": (lambda b: N.clamp_unit(F.col("n") / 25), "least(n / 25::DOUBLE, 1.0)")},
    "clamp_pct": {"pct": (lambda b: N.clamp_pct(F.col("n") * 2.5), "CAST(least(round_even(n * 2.5::DOUBLE, 0), 100) AS INT)")},
    "clause_to_json": {"json": (lambda b: F.to_json(F.struct("clause_index", "heading")), "concat('{\"clause_index\":', clause_index, ',\"heading\":\"', heading, '\"}')")},
}


def _scalar(key: str, columns: dict) -> None:
    sql = "SELECT id, " + ", ".join(f"{s} AS {n}" for n, (_, s) in columns.items()) + " FROM lines"
    query(key, sql)(lambda v: v("lines").select("id", *[f(F.col("body")).alias(n) for n, (f, _) in columns.items()]))


for _key, _columns in SCALARS.items():
    _scalar(_key, _columns)


@query("clean_party", "SELECT id, CASE WHEN trim(regexp_replace(party, '\\s+', ' ', 'g'), ' .,;:\"''[](){}') = '' THEN trim(party) ELSE trim(regexp_replace(party, '\\s+', ' ', 'g'), ' .,;:\"''[](){}') END AS party FROM tasks")
def _(v):
    return v("tasks").select("id", T.clean_party(F.col("party")).alias("party"))


_WHO = "coalesce(nullif(trim(regexp_replace(party, '\\s+', ' ', 'g'), ' .,;:\"''[](){}'), ''), 'the party')"


@query("task_title", f"SELECT id, concat(CASE obligation_type WHEN 'PROHIBITION' THEN concat({_WHO}, ' must not pay') WHEN 'PERMISSION' THEN concat({_WHO}, ' may pay') WHEN 'CONDITIONAL' THEN concat('Conditional — ', {_WHO}, ' pay') ELSE concat({_WHO}, ' shall pay') END, coalesce(concat(' — by ', CAST(due_date AS VARCHAR)), '')) AS title FROM tasks WHERE due_date IS NOT NULL")
def _(v):
    return v("tasks").where("due_date IS NOT NULL").select("id", T.task_title(F.col("party"), F.col("obligation_type"), F.lit("pay"), F.col("due_date")).alias("title"))


@query("reminder_message", "SELECT id, CASE WHEN due_date IS NULL THEN 'Reminder: task without a date' ELSE concat('Reminder: due on ', CAST(due_date AS VARCHAR)) END AS message FROM tasks")
def _(v):
    return v("tasks").select("id", F.coalesce(F.concat(F.lit("Reminder: due on "), F.col("due_date").cast("string")), F.lit("Reminder: task without a date")).alias("message"))


@query("file_size_kb", "SELECT id, greatest(1, CAST(round_even(size_bytes / 1024.0::DOUBLE, 0) AS BIGINT)) AS kb FROM contracts")
def _(v):
    return v("contracts").select("id", N.size_kb(F.col("size_bytes")).alias("kb"))


@query("stage_progress", "SELECT stage, pct FROM (VALUES " + ", ".join(f"('{k}', {p})" for k, p in STAGE_PROGRESS.items()) + ") AS t(stage, pct)")
def _(v):
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(p)) for k, p in STAGE_PROGRESS.items()]))
    return v("region").limit(1).select(F.explode(pairs).alias("stage", "pct"))


# --- sets, JSON, changes, curation, increments ----------------------------------------------


@query("union_sources", "SELECT 'doc' AS origin, doc_id AS id FROM documents UNION ALL SELECT 'item', item_id FROM benchmark")
def _(v):
    a = v("documents").select(F.lit("doc").alias("origin"), F.col("doc_id").alias("id"))
    return a.unionByName(v("benchmark").select(F.lit("item").alias("origin"), F.col("item_id").alias("id")))


@query("resume_anti_join", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(v):
    return v("documents").select("doc_id").join(v("labels").select("doc_id"), "doc_id", "left_anti")


@query("claim_pending", "SELECT id, CASE WHEN status IN ('PENDING', 'FAILED') THEN 'PROCESSING' ELSE status END AS status, CASE WHEN status IN ('PENDING', 'FAILED') THEN 0 ELSE progress_pct END AS progress_pct, status IN ('PENDING', 'FAILED') AS claimed FROM contracts")
def _(v):
    return R.claim(v("contracts")).select("id", "status", "progress_pct", "claimed")


@query("reminder_scan", f"SELECT DISTINCT task_id, days_before FROM reminders r WHERE remind_on <= DATE '{AS_OF}' AND NOT sent")
def _(v):
    due = v("reminders").where(F.col("remind_on") <= F.lit(TODAY))
    return R.deliver_once(due, due.where("sent").select("task_id", "days_before"), ["task_id", "days_before"]).select("task_id", "days_before")


@query("constraint_violations", "SELECT id, 'x' AS \"constraint\" FROM contracts WHERE progress_pct NOT BETWEEN 0 AND 100 OR (status = 'FAILED') <> (error_message IS NOT NULL)")
def _(v):
    return R.violations(v("contracts"))


@query("audit_diff", "SELECT id, concat('{\"priority\":\"', priority, '\"}') AS \"before\", '{\"priority\":\"HIGH\"}' AS \"after\" FROM tasks WHERE status = 'DONE' AND priority <> 'HIGH'")
def _(v):
    changes = v("tasks").where("status = 'DONE' AND priority IS NOT NULL").select("id", F.lit("HIGH").alias("priority"))
    return R.patch(v("tasks").select("id", "priority"), changes, "id", ["priority"])


@query("grouped_split", "SELECT user_id, CASE WHEN p < 750 THEN 'train' WHEN p < 875 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT user_id, CAST(concat('0x', left(md5(concat(CAST(user_id AS VARCHAR), ':42')), 8)) AS BIGINT) % 1000 AS p FROM contracts)")
def _(v):
    return v("contracts").select("user_id").distinct().select("user_id", C.split_of(F.col("user_id")).alias("split"))


@query("latest_progress", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def _(v):
    return latest_progress(v("events"), "user_id", "event_type", "value")


@query("first_use", "SELECT user_id, min(ts) AS ts FROM events GROUP BY 1")
def _(v):
    return first_use(v("events"), "user_id")


@query("balanced_sample", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY clause_type ORDER BY md5(id), id) AS r FROM lines) WHERE r <= 25")
def _(v):
    return R.keep_first(v("lines"), ["clause_type"], [F.md5("id"), "id"], 25).select("id")


from pactspark import queries_contracts, queries_text  # noqa: E402, F401  (register their queries here)
