"""Queries of party, alias, directive and span functions, and of segment operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactspark.functions import dates as D
from pactspark.functions import numbers as N
from pactspark.functions import parties as P
from pactspark.functions import text as T
from pactspark.operators import segments as S
from pactspark.queries import query

_PLACE = "row_number() OVER (PARTITION BY contract_id ORDER BY clause_index, id)"


def _case(options: list[str], key: str = "n") -> str:
    """SQL text (both engines) that deals the options out by a number."""
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(options)) + " END"


def _in(names) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


# --- parties and aliases --------------------------------------------------------------------

_STEMS = {"Products": "product", "services": "service", "technologies": "technology", "boxes": "box", "class": "class", "its": "its", "states.": "stat", "prices": "price", "fees": "fee"}


@query("stem_word", f"SELECT id, {_case([*_STEMS.values()])} AS stem FROM lines")
def _(v):
    return v("lines").select("id", P.stem(F.expr(_case([*_STEMS]))).alias("stem"))


_ALIASES = {"ESSI": True, "Licensor": True, "Agreement": False, "The Products": False, "Service Corp": True, "Harvest Gold": True, "Rogers": True, "Notice": False, "Effective Date": False, "the thing": False, "AB Inc.": True}


@query("party_alias", f"SELECT id, ({_case(['true' if x else 'false' for x in _ALIASES.values()])}) = 'true' AS party FROM lines")
def _(v):
    return v("lines").select("id", P.is_party_alias(F.expr(_case([*_ALIASES]))).alias("party"))


_TRIGGER, _NAME = "n % 3 = 0", "CASE n % 4 WHEN 1 THEN 'Acme' ELSE concat('Firm ', clause_type) END"


@query("alias_antecedent", f"""WITH t AS (SELECT DISTINCT contract_id AS doc_id, clause_index * 60 AS pos FROM lines WHERE {_TRIGGER}),
e AS (SELECT contract_id AS doc_id, clause_index * 60 - 40 AS "start", clause_index * 60 - n AS "end", {_NAME} AS name FROM lines WHERE n % 2 = 1),
j AS (SELECT t.doc_id, t.pos, e.name, row_number() OVER (PARTITION BY t.doc_id, t.pos ORDER BY e."end" DESC, e."start", e.name DESC) AS r FROM t JOIN e ON e.doc_id = t.doc_id AND e."end" <= t.pos AND t.pos - e."end" <= 200
  AND length(e.name) >= 5 AND e.name LIKE '% %' WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.doc_id = t.doc_id AND o.pos >= e."end" AND o.pos < t.pos))
SELECT t.doc_id, t.pos, j.name FROM t LEFT JOIN j ON j.doc_id = t.doc_id AND j.pos = t.pos AND j.r = 1""")
def _(v):
    rows = v("lines")
    at = F.col("clause_index") * 60
    triggers = rows.where(_TRIGGER).select(F.col("contract_id").alias("doc_id"), at.alias("pos")).distinct()
    entities = rows.where("n % 2 = 1").select(F.col("contract_id").alias("doc_id"), (at - 40).alias("start"), (at - F.col("n")).alias("end"), F.expr(_NAME).alias("name"))
    return S.alias_antecedent(triggers, entities.where(P.is_antecedent(F.col("name"))))


@query("heading_party", f"SELECT id, nullif(regexp_extract(heading, '{P.HEADING_PARTY}', 1), '') AS party FROM lines")
def _(v):
    return v("lines").select("id", P.heading_party(F.col("heading")).alias("party"))


@query("jurisdiction_ctx", f"SELECT id, regexp_matches(lower(substr(body, greatest(instr(body, 'Delaware') - 61, 0) + 1, 128)), '{'|'.join(P.LAW_SIGNALS)}') AS kept FROM lines WHERE contains(body, 'Delaware')")
def _(v):
    start = F.position(F.lit("Delaware"), F.col("body")) - 1
    return v("lines").where(F.contains("body", F.lit("Delaware"))).select("id", P.is_jurisdiction(F.col("body"), start, start + 8).alias("kept"))


_VERB, _SUBJECT, _OBJECT = _case(["have", "pay", "define", "deliver", "be"]), "lower(clause_type)", "CASE n % 7 WHEN 0 THEN clause_type ELSE heading END"


@query("relation_noise", f"SELECT id, verb FROM (SELECT id, {_SUBJECT} AS s, {_VERB} AS verb, {_OBJECT} AS o FROM lines) AS r WHERE trim(lower(s)) <> trim(lower(o)) AND trim(verb) NOT IN {_in(P.STATIVE_VERBS)}")
def _(v):
    rows = v("lines").select("id", F.expr(_SUBJECT).alias("s"), F.expr(_VERB).alias("verb"), F.expr(_OBJECT).alias("o"))
    return rows.where((F.trim(F.lower("s")) != F.trim(F.lower("o"))) & ~F.trim("verb").isin(*P.STATIVE_VERBS)).select("id", "verb")


# --- directives and passives ----------------------------------------------------------------

_ITEMS = {"• 2.1 To Assign technicians": "assign technicians", "- Maintain the books": "maintain the books", "The site is open": None, "to pay": None, "3. Deliver": None, "Purchase all goods": "purchase all goods"}


@query("as_directive", f"SELECT id, nullif({_case([x or '' for x in _ITEMS.values()])}, '') AS action FROM lines")
def _(v):
    return v("lines").select("id", P.as_directive(F.expr(_case([*_ITEMS]))).alias("action"))


@query("passive_rewrite", f"SELECT id, CASE WHEN body LIKE 'Reports will be submitted%' THEN 'submit' END AS verb, coalesce(nullif(regexp_extract(heading, '{P.HEADING_PARTY}', 1), ''), CASE WHEN body LIKE 'The Company%' THEN 'The Company' WHEN body LIKE '%by the Company%' THEN 'the Company' ELSE 'Vendor' END) AS agent FROM lines")
def _(v):
    b = F.col("body")
    return v("lines").select("id", P.passive_verb(b).alias("verb"), P.passive_agent(b, F.col("heading"), F.lit("Vendor")).alias("agent"))


_LINES = "concat(body, chr(10), '- deliver all of the goods in time', chr(10), 'short')"


@query("gate_audit", f"SELECT id, count(*) AS n_lines FROM (SELECT id, unnest(string_split({_LINES}, chr(10))) AS line FROM lines) AS x WHERE length(line) > 25 AND NOT regexp_matches(line, '{T.ANY_MODAL}') AND regexp_matches(line, '^\\s*[-•*]|(?i)^\\s*to\\s') GROUP BY id")
def _(v):
    rows = v("lines").select("id", F.explode(F.split(F.expr(_LINES), "\n")).alias("line"))
    return rows.where((F.length("line") > 25) & ~F.col("line").rlike(T.ANY_MODAL) & F.col("line").rlike(r"^\s*[-•*]|(?i)^\s*to\s")).groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"))


_INLINE = "concat(" + _case(["11. Payment Terms. ", "", "7. the parties shall agree. ", "4.2 Term And Termination. "]) + ", body)"


@query("inline_heading", f"SELECT id, CASE WHEN ok THEN CASE n % 4 WHEN 0 THEN '11. Payment Terms.' ELSE '4.2 Term And Termination.' END END AS heading, CASE WHEN ok THEN body END AS rest FROM (SELECT *, n % 4 IN (0, 3) AND regexp_matches(body, '^[A-Z]') AS ok FROM lines) AS x")
def _(v):
    text = F.expr(_INLINE)
    return v("lines").select("id", P.inline_heading(text, 1).alias("heading"), P.inline_heading(text, 2).alias("rest"))


# --- spans, durations, answers --------------------------------------------------------------


@query("span_near", """SELECT id, CAST(CASE WHEN b > 0 THEN length(h) - b - 3 WHEN f > 0 THEN n + f - 1 END AS INT) AS "start" FROM (SELECT id, n, left(body, n) AS h, instr(reverse(left(body, n)), ' eht') AS b, instr(substr(body, n + 1), 'the ') AS f FROM lines) AS x""")
def _(v):
    return v("lines").select("id", P.span_near(F.col("body"), F.lit("the "), F.col("n")).alias("start"))


@query("compute_spans", """SELECT id, CAST(a AS INT) AS action_start, CAST(CASE WHEN a IS NOT NULL THEN CASE WHEN instr(reverse(left(body, a)), reverse('The')) > 0 THEN a - instr(reverse(left(body, a)), reverse('The')) - 2 WHEN instr(substr(body, a + 1), 'The') > 0 THEN a + instr(substr(body, a + 1), 'The') - 1 END ELSE nullif(instr(body, 'The'), 0) - 1 END AS INT) AS agent_start
FROM (SELECT id, body, nullif(instr(body, 'shall'), 0) - 1 AS a FROM lines) AS x""")
def _(v):
    b = F.col("body")
    action, agent = T.span_start(b, F.lit("shall")), F.lit("The")
    return v("lines").select("id", action.alias("action_start"), F.when(action.isNotNull(), P.span_near(b, agent, action)).otherwise(T.span_start(b, agent)).cast("int").alias("agent_start"))


@query("decode_answer", """WITH p AS (SELECT DISTINCT n FROM lines), s AS (SELECT n, i, (n * i * 7) % 11 AS x, row_number() OVER (PARTITION BY n ORDER BY (n * i * 7) % 11 DESC, i) AS r FROM p, range(0, 12) AS t(i)),
e AS (SELECT n, i, (n * i * 5 + 3) % 13 AS x, row_number() OVER (PARTITION BY n ORDER BY (n * i * 5 + 3) % 13 DESC, i) AS r FROM p, range(0, 12) AS t(i))
SELECT s.n, CAST(s.i AS INT) AS first, CAST(e.i AS INT) AS last, CAST(s.x + e.x AS INT) AS score FROM s JOIN e ON e.n = s.n AND e.i >= s.i AND e.i - s.i < 4 WHERE s.r <= 6 AND e.r <= 6 QUALIFY row_number() OVER (PARTITION BY s.n ORDER BY s.x + e.x DESC, s.r, e.r) = 1""")
def _(v):
    logits = lambda f: F.transform(F.sequence(F.lit(0), F.lit(11)), f)
    a = P.decode_answer(logits(lambda i: F.col("n") * i * 7 % 11), logits(lambda i: (F.col("n") * i * 5 + 3) % 13), 6, 4)
    return v("lines").select("n").distinct().select("n", a.alias("a")).where("a IS NOT NULL").select("n", "a.first", "a.last", F.col("a.score").cast("int").alias("score"))


@query("longest_spans", """SELECT id, CASE WHEN s >= 10 THEN concat('0-10|', s, '-', s + w) WHEN w > 10 THEN concat(s, '-', s + w) ELSE '0-10' END AS spans FROM (SELECT id, n % 20 AS s, n % 30 AS w FROM lines) AS x""")
def _(v):
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    s = F.col("n") % 20
    rows = v("lines").select("id", F.array(span(F.lit(0), F.lit(10)), span(s, s + F.col("n") % 30)).alias("spans"))
    return S.longest_spans(rows).select("id", F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), "|").alias("spans"))


@query("merge_rule_entities", """WITH e AS (SELECT contract_id, clause_index * 10 AS "start", clause_index * 10 + n % 15 + 1 AS "end", 'model' AS origin FROM lines WHERE n % 2 = 0), r AS (SELECT contract_id, clause_index * 10 + 7 AS "start", clause_index * 10 + 12 AS "end", 'rule' AS origin FROM lines)
SELECT * FROM e UNION ALL SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.contract_id = r.contract_id AND r."start" < e."end" AND e."start" < r."end")""")
def _(v):
    at = F.col("clause_index") * 10
    found = v("lines").where("n % 2 = 0").select("contract_id", at.alias("start"), (at + F.col("n") % 15 + 1).alias("end"), F.lit("model").alias("origin"))
    return S.merge_rule_entities(found, v("lines").select("contract_id", (at + 7).alias("start"), (at + 12).alias("end"), F.lit("rule").alias("origin")), "contract_id")


@query("parse_duration", "SELECT id, n AS number, CASE n % 3 WHEN 0 THEN 'months' WHEN 1 THEN 'weeks' ELSE 'business_days' END AS unit FROM lines")
def _(v):
    text = F.concat(F.col("n").cast("string"), F.lit(" "), F.expr(_case(["months", "weeks", "working days"])))
    return v("lines").select("id", N.parse_number(text).alias("number"), N.parse_unit(text).alias("unit"))


_DATES = {"January 5, 2020": ("ABSOLUTE", False), "each calendar month": ("RECURRING", False), "some later time": ("CONDITIONAL", True), "2021-03-04": ("ABSOLUTE", False)}


@query("classify_date_entity", f"SELECT id, {_case([k for k, _ in _DATES.values()])} AS kind, n % 4 = 2 AS review FROM lines")
def _(v):
    kind = D.date_kind(F.expr(_case([*_DATES])))
    return v("lines").select("id", kind.alias("kind"), (kind == "CONDITIONAL").alias("review"))


@query("classify_duration", "SELECT id, CASE WHEN e THEN 'CONDITIONAL' ELSE 'RELATIVE' END AS kind, CASE WHEN NOT e AND n % 2 = 0 THEN day + n END AS due, e OR n % 2 = 1 AS review FROM (SELECT *, contains(body, 'after receipt of notice') AS e FROM lines) AS x")
def _(v):
    text = F.concat(F.col("n").cast("string"), F.lit(" days"))
    event = D.event_relative(text, F.col("body"))
    due = F.when(~event, D.resolve_relative(text, F.when(F.col("n") % 2 == 0, F.col("day"))))
    return v("lines").select("id", F.when(event, "CONDITIONAL").otherwise("RELATIVE").alias("kind"), due.alias("due"), due.isNull().alias("review"))


# --- segments and sources -------------------------------------------------------------------


@query("drop_noise", "SELECT id FROM lines WHERE n % 3 <> 0 OR heading LIKE 'EXHIBIT%'")
def _(v):
    return S.drop_noise(v("lines").withColumn("body", F.when(F.col("n") % 3 == 0, "").otherwise(F.col("body")))).select("id")


@query("merge_orphans", f"""WITH a AS (SELECT contract_id, {_PLACE} - 1 AS place, heading, CASE WHEN n % 3 = 0 THEN '' ELSE body END AS body, n % 3 = 0 AS empty FROM lines),
b AS (SELECT *, sum(CASE WHEN empty AND place > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY contract_id ORDER BY place) AS grp FROM a)
SELECT contract_id AS doc_id, min(place) AS clause_index, string_agg(trim(concat(heading, ' ', body)), ' ' ORDER BY place) AS text FROM b GROUP BY contract_id, grp""")
def _(v):
    place = (F.row_number().over(W.partitionBy("contract_id").orderBy("clause_index", "id")) - 1).cast("long")
    rows = v("lines").select(F.col("contract_id").alias("doc_id"), place.alias("clause_index"), "heading", F.when(F.col("n") % 3 == 0, "").otherwise(F.col("body")).alias("body"), F.lit(1).alias("end_page"))
    return S.merge_orphans(rows.withColumn("token_count", T.token_count(F.concat_ws(" ", "heading", "body")))).select("doc_id", "clause_index", "text")


@query("split_oversized", "SELECT DISTINCT n, CASE WHEN n <= 4 THEN 1 ELSE 1 + CAST(ceil((n - 4) / 3.0) AS INT) END AS n_chunks FROM lines")
def _(v):
    rows = v("lines").select("n").distinct().withColumn("text", F.expr("rtrim(repeat('aa bb cc dd. ', n))"))
    return S.split_oversized(rows, "text", 20, 5).select("n", F.size("sub_chunks").alias("n_chunks"))


@query("definition_groups", """SELECT contract_id AS doc_id, CASE WHEN contract_id % 2 = 0 AND t > 0 THEN 'DEFINITION_GROUP' ELSE 'CLAUSE' END AS chunk_type, CASE WHEN contract_id % 2 = 0 THEN CAST(t AS INT) ELSE 0 END AS n_terms
FROM (SELECT contract_id, count(*) FILTER (WHERE body LIKE '"Net Revenue"%' OR body LIKE 'By: Name%') AS t FROM lines GROUP BY 1) AS x""")
def _(v):
    heading = F.when(F.col("contract_id") % 2 == 0, "1. DEFINITIONS").otherwise("2. Scope")
    chunks = v("lines").groupBy("contract_id").agg(F.collect_list("body").alias("bodies")).select(F.col("contract_id").alias("doc_id"), heading.alias("heading"), "bodies")
    return S.definition_groups(chunks).select("doc_id", "chunk_type", F.size("terms").alias("n_terms"))


@query("scan_pages_posexplode", "SELECT id, page, txt FROM (SELECT id, 1 AS page, heading AS txt FROM lines UNION ALL SELECT id, 2, body FROM lines) AS x")
def _(v):
    text = F.concat(F.lit("===== PAGE 1 =====\n"), "heading", F.lit("\n===== PAGE 2 =====\n"), "body")
    return v("lines").select("id", F.posexplode(F.split(text, r"\n?===== PAGE \d+ =====\n")).alias("page", "txt")).where("page > 0")


_TREE = "array<struct<paragraphs: array<struct<qas: array<struct<question: string, answers: array<struct<text: string, answer_start: int>>>>>>>>"


@query("nested_flatten", "SELECT id, clause_type AS category, heading AS answer, clause_index AS answer_start FROM lines")
def _(v):
    qa = F.struct(F.concat(F.lit('Parts related to "'), "clause_type", F.lit('" that matter')).alias("question"), F.array(F.struct(F.col("heading").alias("text"), F.col("clause_index").alias("answer_start"))).alias("answers"))
    stored = v("lines").select("id", F.to_json(F.array(F.struct(F.array(F.struct(F.array(qa).alias("qas"))).alias("paragraphs")))).alias("json"))
    rows = stored.select("id", F.explode(F.from_json("json", _TREE)).alias("d")).select("id", F.explode("d.paragraphs").alias("p")).select("id", F.explode("p.qas").alias("q"))
    rows = rows.select("id", F.regexp_extract("q.question", 'related to "([^"]+)"', 1).alias("category"), F.explode("q.answers").alias("a"))
    return rows.select("id", "category", F.col("a.text").alias("answer"), "a.answer_start")


@query("parse_report", "SELECT contract_id, CAST(clause_index AS INT) AS task, clause_type AS label FROM lines")
def _(v):
    block = F.concat(F.lit("### Task "), F.col("clause_index").cast("string"), F.lit("\n- **Label:** "), "clause_type", F.lit("\n"))
    report = v("lines").select("contract_id", block.alias("b")).groupBy("contract_id").agg(F.array_join(F.collect_list("b"), "").alias("report"))
    blocks = report.select("contract_id", F.explode(F.split("report", "### Task ")).alias("b")).where("b <> ''")
    return blocks.select("contract_id", F.regexp_extract("b", r"^(\d+)", 1).cast("int").alias("task"), F.regexp_extract("b", r"\*\*Label:\*\* (.*)", 1).alias("label"))


# --- records --------------------------------------------------------------------------------


@query("task_description", "SELECT id, concat('Obligation Type: ', obligation_type, chr(10), 'Obligated Party: ', party, chr(10), 'Confidence: ', CAST(round_even(confidence * 100, 0) AS INT), '%', CASE WHEN due_date IS NULL THEN '' ELSE concat(chr(10), '---', chr(10), 'Resolved Date: ', CAST(due_date AS VARCHAR)) END) AS description FROM tasks")
def _(v):
    labelled = lambda n, c: F.concat(F.lit(n), c.cast("string"))
    due = F.when(F.col("due_date").isNotNull(), F.lit("---\nResolved Date: "))
    parts = [labelled("Obligation Type: ", F.col("obligation_type")), labelled("Obligated Party: ", F.col("party")), F.concat(F.lit("Confidence: "), F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")), F.concat(due, F.col("due_date").cast("string"))]
    return v("tasks").select("id", P.description(parts).alias("description"))


@query("corrections_merge", """SELECT id, concat('{"due_date":"', CASE WHEN clause_index % 2 = 0 THEN 'new' ELSE 'old' END, '"', CASE WHEN clause_index % 2 = 0 THEN ',"party":"old"' ELSE ',"party":"old","priority":"new"' END, '}') AS corrections FROM tasks""")
def _(v):
    one = lambda k, x: F.create_map(F.lit(k), F.lit(x))
    old = F.map_concat(one("due_date", "old"), one("party", "old"))
    new = F.when(F.col("clause_index") % 2 == 0, one("due_date", "new")).otherwise(one("priority", "new"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return v("tasks").select("id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged)))).alias("corrections"))


@query("idempotent_rewrite", "SELECT id, contract_id, 'old' AS version FROM tasks WHERE contract_id % 5 <> 0 UNION ALL SELECT id, contract_id, 'new' FROM tasks WHERE contract_id % 5 = 0 AND clause_index = 1")
def _(v):
    new = v("tasks").where("contract_id % 5 = 0 AND clause_index = 1").select("id", "contract_id", F.lit("new").alias("version"))
    replaced = v("contracts").where("id % 5 = 0").select(F.col("id").alias("contract_id"))
    kept = v("tasks").join(replaced, "contract_id", "left_anti").select("id", "contract_id", F.lit("old").alias("version"))
    return kept.unionByName(new)


_LABELS = ["text", "Page_Header", "list_item", "section_header", "picture_1", "table", "footnote", "code"]


@query("filter_item_labels", f"SELECT id, {_case(_LABELS)} AS label FROM lines WHERE n % 8 IN (0, 2, 3, 5)")
def _(v):
    return S.filter_item_labels(v("lines").select("id", F.expr(_case(_LABELS)).alias("label")))
