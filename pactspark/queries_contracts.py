"""Queries on obligations, provisions, labels, state changes and files, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactspark.functions import labels as L
from pactspark.functions import parties as P
from pactspark.functions import text as T
from pactspark import streaming as X
from pactspark.operators import entities as E
from pactspark.operators import obligations as O  # noqa: E741
from pactspark.operators import provisions as V
from pactspark.operators import relational as R
from pactspark.operators import states as U
from pactspark.plans import curation as C
from pactspark.queries import USER, query
from pactspark.sources import files as S

_q = lambda x: x.replace("'", "''")
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_parties = lambda xs: F.array(*[F.lit(x) for x in xs])

# --- deadlines ---------------------------------------------------------------------------------

_ACTION = r"(?:shall|must|may|will) (?:not )?([a-z]+ [a-z]+)"
_SUBJECT = r"^The ([A-Z][a-z]+)"
_SPAN = r"(?:[a-z-]+ )?(?:\(\d+\) )?(?:business )?(?:days|months)"
_ORD = "concat(CAST(clause_index AS {0}), '/', id)"
_RAW = f"""o AS (SELECT contract_id AS clause_id, {_ORD.format('VARCHAR')} AS ord, regexp_extract(body, '{_ACTION}', 1) AS action, regexp_extract(body, '{_SUBJECT}', 1) AS party FROM lines),
d AS (SELECT contract_id AS clause_id, {_ORD.format('VARCHAR')} AS ord, regexp_extract(body, '{_SPAN}') AS raw, CASE n % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS rnk FROM lines WHERE regexp_extract(body, '{_SPAN}') <> '')"""


@query("associate_deadline", f"""WITH {_RAW},
p AS (SELECT o.*, b.body, CASE WHEN length(action) > 3 AND instr(body, action) > 0 THEN instr(body, action) - 1 WHEN party <> '' AND instr(body, party) > 0 THEN instr(body, party) - 1 END AS spot FROM o LEFT JOIN clause_texts b USING (clause_id)),
w AS (SELECT *, CASE WHEN instr(left(body, spot), '. ') = 0 THEN 0 ELSE spot - instr(reverse(left(body, spot)), ' .') + 1 END AS lo, CASE WHEN instr(substr(body, spot + 1), '. ') = 0 THEN length(body) ELSE spot + instr(substr(body, spot + 1), '. ') END AS hi FROM p),
j AS (SELECT w.clause_id, w.ord, w.spot, d.ord AS d_ord, d.raw, d.rnk, instr(substr(body, greatest(lo, spot - 400) + 1, least(hi, spot + 400) - greatest(lo, spot - 400)), d.raw) > 0 AS inside, abs(instr(body, d.raw) - 1 - spot) AS far FROM w LEFT JOIN d USING (clause_id))
SELECT clause_id, ord, CASE WHEN max(spot) IS NULL THEN CASE WHEN count(raw) = 1 THEN max(raw) END ELSE coalesce(arg_min(raw, (rnk, d_ord)) FILTER (inside), arg_min(raw, (far, d_ord)) FILTER (far <= 350)) END AS deadline FROM j GROUP BY clause_id, ord""")  # fmt: skip
def _(v):
    ord_ = F.concat(F.col("clause_index").cast("string"), F.lit("/"), "id")
    lines = v("lines").select(F.col("contract_id").alias("clause_id"), ord_.alias("ord"), "body", "n")
    obligations = lines.select("clause_id", "ord", F.regexp_extract("body", _ACTION, 1).alias("action"), F.regexp_extract("body", _SUBJECT, 1).alias("party"))
    kind = F.when(F.col("n") % 3 == 0, "ABSOLUTE").when(F.col("n") % 3 == 1, "RELATIVE").otherwise("CONDITIONAL")
    deadlines = lines.select("clause_id", "ord", F.regexp_extract("body", _SPAN, 0).alias("raw"), kind.alias("date_type")).where("raw <> ''")
    return O.associate(v("clause_texts"), obligations, deadlines).select("clause_id", "ord", "deadline")


_TASK_KIND = "CASE l.n % 3 WHEN 0 THEN 'OBLIGATION' WHEN 1 THEN 'PERMISSION' ELSE 'PROHIBITION' END"


@query("resolve_action", f"""WITH o AS (SELECT l.contract_id, t.obligation_type AS kind, concat(l.clause_index, '/', l.id) AS ord, regexp_extract(body, '{_ACTION}', 1) AS found FROM lines l JOIN tasks t ON t.id = l.id),
j AS (SELECT l.id, l.body, o.*, o.kind = {_TASK_KIND} AS same FROM lines l JOIN o ON o.contract_id = l.contract_id),
k AS (SELECT *, bool_or(same) OVER (PARTITION BY id) AS any_same FROM j)
SELECT l.id, coalesce(x.action, '') AS action FROM lines l LEFT JOIN (SELECT id, coalesce(arg_min(found, ord) FILTER (instr(body, found) > 0), arg_min(found, ord)) AS action FROM k WHERE found <> '' AND (same OR NOT any_same) GROUP BY id) x ON x.id = l.id""")  # fmt: skip
def _(v):
    ord_ = F.concat(F.col("clause_index").cast("string"), F.lit("/"), "id").alias("ord")
    lines = v("lines")
    kind = F.when(F.col("n") % 3 == 0, "OBLIGATION").when(F.col("n") % 3 == 1, "PERMISSION").otherwise("PROHIBITION")
    tasks = lines.select("id", F.col("contract_id").alias("clause_id"), kind.alias("kind"), F.col("body").alias("source_text"))
    found = lines.select("id", F.col("contract_id").alias("clause_id"), ord_, F.regexp_extract("body", _ACTION, 1).alias("found")).join(v("tasks").select("id", F.col("obligation_type").alias("kind")), "id").drop("id")
    return R.resolve(tasks, found).select("id", F.coalesce("found", F.lit("")).alias("action"))


@query("resolve_deadline_raw", f"""WITH d AS (SELECT contract_id, concat(clause_index, '/', id) AS ord, regexp_extract(body, '{_SPAN}') AS found, n % 2 AS kind FROM lines),
j AS (SELECT l.id, l.body, d.*, d.kind = l.n % 3 AS same FROM lines l JOIN d ON d.contract_id = l.contract_id),
k AS (SELECT *, bool_or(same) OVER (PARTITION BY id) AS any_same FROM j)
SELECT l.id, x.raw FROM lines l LEFT JOIN (SELECT id, coalesce(arg_min(found, ord) FILTER (instr(body, found) > 0), arg_min(found, ord)) AS raw FROM k WHERE found <> '' AND (same OR NOT any_same) GROUP BY id) x ON x.id = l.id""")  # fmt: skip
def _(v):
    ord_ = F.concat(F.col("clause_index").cast("string"), F.lit("/"), "id").alias("ord")
    lines = v("lines").withColumn("clause_id", F.col("contract_id"))
    tasks = lines.select("id", "clause_id", (F.col("n") % 3).alias("kind"), F.col("body").alias("source_text"))
    found = lines.select("clause_id", ord_, F.regexp_extract("body", _SPAN, 0).alias("found"), (F.col("n") % 2).alias("kind"))
    return R.resolve(tasks, found).select("id", F.col("found").alias("raw"))


# --- provisions --------------------------------------------------------------------------------


@query("provision_starts", f"""WITH m AS (SELECT clause_id, body, unnest(regexp_extract_all(body, '{V.MARKER}')) AS hit, unnest(regexp_split_to_array(body, '{V.MARKER}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(body, '{V.MARKER}'), 1) AS i FROM provision_texts),
s AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY clause_id ORDER BY i) AS BIGINT) AS stop FROM m WHERE hit IS NOT NULL)
SELECT clause_id, stop - length(hit) AS start, NOT regexp_matches(body[greatest(stop - length(hit) - 48, 0) + 1 : stop - length(hit)], '{V.CITED_BEFORE}') AND NOT regexp_matches(body[stop + 1 : stop + 48], '{V.CITED_AFTER}') AS genuine FROM s""")  # fmt: skip
def _(v):
    each = v("provision_texts").select("clause_id", "body", F.explode(V.match_spans(F.col("body"), V.MARKER)).alias("m"))
    return each.select("clause_id", F.col("m.start").cast("long").alias("start"), V.is_provision_start(F.col("body"), F.col("m.start"), F.col("m.end")).alias("genuine"))


_CUT = r"Section 4\.1 Payment Terms\. "


@query("split_provisions", f"""WITH p AS (SELECT clause_id, concat(body, ' ', body) AS body FROM provision_texts),
m AS (SELECT clause_id, body, regexp_split_to_array(body, '{_CUT}|ARTICLE 5 - OBLIGATIONS OF THE COMPANY\\. ') AS parts, regexp_extract_all(body, '{_CUT}|ARTICLE 5 - OBLIGATIONS OF THE COMPANY\\. ') AS hits FROM p),
s AS (SELECT *, CASE WHEN length(body) < 200 THEN 0 ELSE len(hits) END AS n FROM m),
e AS (SELECT clause_id, body, n, unnest(hits) AS hit, unnest(parts[2:]) AS rest FROM s UNION ALL SELECT clause_id, body, n, NULL, parts[1] FROM s)
SELECT clause_id, CASE WHEN n < 2 OR hit IS NULL THEN 'All' WHEN hit LIKE 'S%' THEN 'Section 4.1 — Payment Terms' ELSE 'ARTICLE 5' END AS heading, CAST(length(CASE WHEN n < 2 THEN body ELSE trim(concat(coalesce(hit, ''), rest)) END) AS INT) AS n_chars, CASE WHEN n < 2 THEN 1 ELSE 2 END AS level
FROM e WHERE (n < 2 AND hit IS NULL) OR (n >= 2 AND (hit IS NOT NULL OR len(list_filter(string_split(rest, ' '), lambda x: x <> '')) >= 5))""")  # fmt: skip
def _(v):
    rows = v("provision_texts").select("clause_id", F.lit("CLAUSE").alias("chunk_type"), F.lit("All").alias("heading"), F.concat("body", F.lit(" "), "body").alias("body"), F.lit(1).alias("level"))
    return V.split_provisions(rows).select("clause_id", "heading", F.length("body").alias("n_chars"), "level")


@query("carve_heading", r"""SELECT id, CASE regexp_extract(heading, '^(Section 4.1|ARTICLE 5)', 1) WHEN '' THEN NULL WHEN 'ARTICLE 5' THEN CASE WHEN n % 2 = 0 THEN concat('ARTICLE 5 — t', n) ELSE 'ARTICLE 5' END
ELSE CASE WHEN n % 2 = 0 THEN concat('Section 4.1 — t', n) ELSE 'Section 4.1 — Payment Terms' END END AS heading FROM lines""")
def _(v):
    bracket = F.when(F.col("n") % 2 == 0, F.concat(F.lit(" [ t"), F.col("n").cast("string"), F.lit(" ] "))).otherwise(" ")
    text = F.regexp_replace("heading", r"^(Section 4\.1|ARTICLE 5) ", "$1\u0001")
    text = F.concat(F.get(F.split(text, "\u0001"), 0), bracket, F.coalesce(F.get(F.split(text, "\u0001"), 1), F.lit("")), F.lit(". "), "body")
    return v("lines").select("id", V.carve_heading(text).alias("heading"))


# --- tables, parties, agents -------------------------------------------------------------------

_KNOWN = ("Acme Corp", "Buyer Holdings", "the Company")
_CELL = "CASE n % 6 WHEN 0 THEN 'Acme Corp' WHEN 1 THEN 'buyer' WHEN 2 THEN 'Zeta Trading Ltd.' WHEN 3 THEN 'Licensee' WHEN 4 THEN 'Totals' ELSE '' END"
_DUTY = "CASE WHEN clause_index % 4 = 3 THEN 'Audit' ELSE body END"


@query("duty_table", f"""WITH r AS (SELECT contract_id, id, {_CELL} AS cell, replace({_DUTY}, '|', '/') AS duty FROM lines WHERE contract_id % 3 <> 0),
p AS (SELECT *, CASE cell WHEN 'Acme Corp' THEN 'Acme Corp' WHEN 'buyer' THEN 'Buyer Holdings' WHEN 'Zeta Trading Ltd.' THEN cell WHEN 'Licensee' THEN 'Licensee' END AS party FROM r)
SELECT contract_id, party, concat(party, ' shall ', lower(left(duty, 1)), substr(duty, 2)) AS text FROM p WHERE party IS NOT NULL AND length(duty) >= 8""")  # fmt: skip
def _(v):
    rows = v("lines").select("contract_id", "id", F.expr(_CELL).alias("cell"), F.expr(_DUTY).alias("duty"))
    line = F.concat(F.lit("| "), "cell", F.lit(" | "), "duty", F.lit(" |"))
    header = F.when(F.col("contract_id") % 3 == 0, "| Item | Amount |").otherwise("| Party | Duties |")
    texts = rows.groupBy("contract_id").agg(F.array_join(F.collect_list(line), "\n").alias("rows")).select("contract_id", F.concat(header, F.lit("\n|:---|---|\n"), "rows").alias("text"))
    return texts.select("contract_id", F.explode(O.duty_table(F.col("text"), _parties(_KNOWN))).alias("x")).select("contract_id", "x.party", "x.text")


_NAME = "CASE n % 11 WHEN 0 THEN 'licensee' WHEN 1 THEN 'Acme' WHEN 2 THEN 'The Parties' WHEN 3 THEN 'each party' WHEN 4 THEN 'Net Revenue Rights' WHEN 5 THEN 'Globex Trading' WHEN 6 THEN 'all members of the board and their staff' WHEN 7 THEN 'The board' WHEN 8 THEN 'both parties' WHEN 9 THEN 'x ACME CORP y' ELSE '' END"


@query("validate_party", f"""WITH c AS (SELECT id, {_NAME} AS name FROM lines)
SELECT id, CASE name WHEN 'licensee' THEN 'Licensee' WHEN 'Acme' THEN 'Acme Corp' WHEN 'The Parties' THEN 'The Parties' WHEN 'Globex Trading' THEN 'Globex Trading' WHEN 'x ACME CORP y' THEN 'Acme Corp' END AS valid,
CASE WHEN lower(name) IN ({_list(O.ONE_PARTY)}) THEN 'Acme Corp' WHEN lower(name) IN ({_list(O.ALL_PARTIES)}) THEN 'Acme Corp and Buyer Holdings' ELSE name END AS resolved FROM c""")  # fmt: skip
def _(v):
    rows = v("lines").select("id", F.expr(_NAME).alias("name"))
    return rows.select("id", O.validate_party(F.col("name"), _parties(_KNOWN)).alias("valid"), O.resolve_generic(F.col("name"), _parties(_KNOWN)).alias("resolved"))


_AGENTS = ("Acme", "NVOS", "Acme Corp")
_SINGLE = _q(T.ANY_MODAL)


@query("governing_agent", f"""WITH i AS (SELECT clause_id, sent_idx, trim(text) AS raw, trim(regexp_replace(trim(text), '{P.ITEM_PREFIX}', '')) AS item, CASE WHEN heading LIKE '%OBLIGATIONS OF THE COMPANY' THEN 'COMPANY' END AS governing FROM sentences WHERE length(trim(text)) >= 10),
k AS (SELECT *, CASE WHEN regexp_matches(raw, '{O.LEAD_IN}') THEN 'lead_in' WHEN lower(item) IN ('acme', 'nvos', 'acme corp') THEN 'header' WHEN regexp_matches(raw, '{_SINGLE}') THEN 'modal' ELSE 'item' END AS kind FROM i),
l AS (SELECT *, CASE WHEN kind = 'item' AND lower(item) LIKE 'acme corp%' THEN 'Acme Corp' WHEN kind = 'item' AND lower(item) LIKE 'nvos%' THEN 'NVOS' END AS lead FROM k),
s AS (SELECT *, CASE WHEN lead IS NULL THEN item ELSE trim(regexp_replace(item[length(lead) + 1 :], '{P.ITEM_PREFIX}', '')) END AS source,
      CASE kind WHEN 'lead_in' THEN trim(regexp_extract(raw, '{O.SUBJECT}', 1)) WHEN 'header' THEN CASE lower(item) WHEN 'nvos' THEN 'NVOS' ELSE 'Acme Corp' END ELSE lead END AS sets FROM l),
a AS (SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER (PARTITION BY clause_id ORDER BY sent_idx ROWS UNBOUNDED PRECEDING), governing) AS agent,
      CASE WHEN regexp_matches(source, '(?i)^to [a-z]') THEN source[4:] WHEN regexp_extract(source, '^[A-Za-z]+') IN ('Provide', 'Assign', 'Complete', 'pay') THEN concat(lower(source[1]), source[2:]) END AS action,
      CASE WHEN raw LIKE 'Books%' THEN governing WHEN raw LIKE 'Payments%' THEN coalesce(governing, 'the Company') END AS passive FROM s)
SELECT clause_id, sent_idx, CASE kind WHEN 'lead_in' THEN raw WHEN 'item' THEN concat(agent, ' shall ', action)
  ELSE CASE WHEN passive IS NULL THEN raw WHEN raw LIKE 'Books%' THEN concat(passive, ' shall keep Books and records at the principal office') ELSE concat(passive, ' shall make Payments by the Company on demand') END END AS text,
  CASE kind WHEN 'item' THEN agent WHEN 'modal' THEN passive END AS hint, passive IS NOT NULL AS review
FROM a WHERE kind <> 'header' AND NOT (kind = 'item' AND (agent IS NULL OR action IS NULL))""")  # fmt: skip
def _(v):
    rows = v("sentences").withColumn("parties", _parties(_AGENTS))
    return O.candidates(rows).select("clause_id", "sent_idx", "text", "hint", "review")


# --- labels, entities, predictions -------------------------------------------------------------

_LABEL = "concat(lower(clause_type), '_', replace(heading, ' ', '-'))"
_LABEL_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(x, '{k}')" for k in ks) + f" THEN '{c}'" for c, ks in L.CATEGORY_KEYWORDS.items()) + f" ELSE '{L.DEFAULT_CATEGORY}' END"


@query("label_collapse", f"SELECT id, {_LABEL_SQL} AS label FROM (SELECT id, translate(lower({_LABEL}), '_-', '  ') AS x FROM lines)")
def _(v):
    return v("lines").select("id", L.collapse_label(F.expr(_LABEL)).alias("label"))


_WORD = "CASE n % 9 WHEN 0 THEN ' Monthly ' WHEN 1 THEN '2011' WHEN 2 THEN 'yesterday' WHEN 3 THEN 'May 5' WHEN 4 THEN 'this Agreement' WHEN 5 THEN 'a few dollars' WHEN 6 THEN '$5' WHEN 7 THEN 'Acme' ELSE body END"
_KIND = "CASE clause_index % 4 WHEN 0 THEN 'DATE' WHEN 1 THEN 'PARTY' WHEN 2 THEN 'MONEY' ELSE 'ORG' END"


@query("entity_noise", f"""SELECT id, text, label FROM (SELECT id, {_WORD} AS text, {_KIND} AS label FROM lines) WHERE NOT CASE label
WHEN 'DATE' THEN lower(trim(text)) IN ({_list(L.DATE_NOISE)}) OR (len(list_filter(string_split(text, ' '), lambda x: x <> '')) = 1 AND NOT regexp_matches(text, '[0-9]'))
WHEN 'PARTY' THEN contains(lower(text), 'agreement') OR contains(lower(text), 'between') WHEN 'MONEY' THEN NOT regexp_matches(text, '[0-9]') ELSE false END""")  # fmt: skip
def _(v):
    rows = v("lines").select("id", F.expr(_WORD).alias("text"), F.expr(_KIND).alias("label"))
    return rows.where(~L.entity_is_noise(F.col("text"), F.col("label")))


@query("resolve_aliases", f"""WITH e AS (SELECT id, {_WORD} AS text, {_KIND} AS label FROM lines),
a AS (SELECT alias, arg_max(name, place) AS name FROM (VALUES (' Monthly ', 'first', 1), (' Monthly ', 'Monthly Inc.', 2), ('Acme', 'Acme Corporation', 3), ('2011', 'Class of 2011 LLC', 4)) t(alias, name, place) GROUP BY alias)
SELECT id, label, CASE WHEN label IN ('PARTY', 'ORG') THEN coalesce(a.name, e.text) END AS resolved_name, CASE WHEN label IN ('PARTY', 'ORG') THEN a.name IS NOT NULL END AS is_alias FROM e LEFT JOIN a ON a.alias = e.text""")  # fmt: skip
def _(v):
    rows = v("lines").select("id", F.expr(_WORD).alias("text"), F.expr(_KIND).alias("label"))
    pairs = rows.sparkSession.createDataFrame([(" Monthly ", "first", 1), (" Monthly ", "Monthly Inc.", 2), ("Acme", "Acme Corporation", 3), ("2011", "Class of 2011 LLC", 4)], "alias string, name string, place int")
    return R.resolve_aliases(rows, R.alias_map(pairs)).select("id", "label", "resolved_name", "is_alias")


_LAW = " OR ".join(f"contains(around, '{x}')" for x in P.LAW_SIGNALS)


@query("jurisdiction_labels", f"""SELECT id, CASE label WHEN 'PERSON' THEN 'PARTY' WHEN 'PERCENT' THEN 'PERCENTAGE' WHEN 'GPE' THEN CASE WHEN {_LAW} THEN 'JURISDICTION' END ELSE label END AS label
FROM (SELECT id, lower(body[greatest(start - 60, 0) + 1 : start + 68]) AS around, label FROM (SELECT id, body, greatest(instr(body, 'Delaware') - 1, 0) AS start, CASE n % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'GPE' WHEN 2 THEN 'PERCENT' WHEN 3 THEN 'GPE' ELSE 'ORG' END AS label FROM lines WHERE length(body) > 50))""")  # fmt: skip
def _(v):
    label = F.expr("CASE n % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'GPE' WHEN 2 THEN 'PERCENT' WHEN 3 THEN 'GPE' ELSE 'ORG' END")
    start = F.greatest(F.instr("body", "Delaware") - 1, F.lit(0))
    return v("lines").where("length(body) > 50").select("id", P.entity_label(label, F.col("body"), start, start + 8).alias("label"))


@query("avg_prob_vectors", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
m AS (SELECT label, pos, avg(x) AS p FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p DESC, pos) AS r FROM m),
c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT r.label, c.n, max(pos) FILTER (r = 1) AS top, round(max(p) FILTER (r = 1), 6) AS confidence, string_agg(pos, ',' ORDER BY r) FILTER (r <= 3) AS top3 FROM r JOIN c ON c.label = r.label GROUP BY r.label, c.n""")
def _(v):
    names = [str(i) for i in range(512)]
    out = L.predict(L.mean_vectors(v("embeddings"), "label", "embedding"), labels=names)
    return out.select("label", "n", F.col("clause_type").cast("long").alias("top"), F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("alternatives", lambda x: x["label"]), ",").alias("top3"))


_PROBS = "array(CAST(n AS DOUBLE) / 60, 1 - CAST(n AS DOUBLE) / 60, CAST(clause_index AS DOUBLE) / 100)"


@query("renewal_review", """WITH p AS (SELECT id, body, n / 60.0::DOUBLE AS a, 1 - n / 60.0::DOUBLE AS b, clause_index / 100.0::DOUBLE AS c FROM lines)
SELECT id, CASE WHEN a >= b AND a >= c THEN 'RENEWAL' WHEN b >= c THEN 'PAYMENT' ELSE 'NOTICES' END AS clause_type, greatest(a, b, c) < 0.75 OR (a >= b AND a >= c AND NOT body LIKE '%automatically renew%') AS needs_review FROM p""")
def _(v):
    rows = v("lines").select("id", "body", F.expr(_PROBS).alias("probs"))
    return L.predict(rows, "probs", "body", ["RENEWAL", "PAYMENT", "NOTICES"]).select("id", "clause_type", "needs_review")


@query("bio_tags", r"""WITH w AS (SELECT id, body, unnest(regexp_extract_all(body, '\S+')) AS token, generate_subscripts(regexp_extract_all(body, '\S+'), 1) AS i FROM lines WHERE body LIKE 'The Buyer shall pay%'),
p AS (SELECT *, CAST(coalesce(sum(length(token) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM w)
SELECT id, string_agg(CASE WHEN start + length(token) > 0 AND start < 9 THEN CASE WHEN i = 1 THEN 'B-AGENT' ELSE 'I-AGENT' END WHEN start + length(token) > 16 AND start < 27 THEN CASE WHEN i = 4 THEN 'B-ACTION' ELSE 'I-ACTION' END ELSE 'O' END, ' ' ORDER BY i) AS tags FROM p GROUP BY id""")
def _(v):
    rows = v("lines").where("body LIKE 'The Buyer shall pay%'")
    return rows.select("id", F.array_join(F.transform(L.bio_tags(F.col("body"), F.lit("the buyer"), F.lit("PAY INVOICE")), lambda x: x["tag"]), " ").alias("tags"))


@query("strided_windows", """WITH t AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 384 THEN 1 ELSE CAST(ceil((n - 384) / 256.0) AS BIGINT) + 1 END)) AS i FROM t)
SELECT doc_id, CAST(i * 256 AS INT) AS first, CAST(least(384, n - i * 256) AS INT) AS n_tokens FROM w""")
def _(v):
    each = v("documents").select("doc_id", F.explode(L.strided_windows(F.split("text", " ", -1))).alias("w"))
    return each.select("doc_id", "w.first", F.size("w.tokens").alias("n_tokens"))


# --- audits and reports ------------------------------------------------------------------------

@query("audit_segments", """WITH t AS (SELECT *, CAST(ceil(length(body) / 4.0) AS BIGINT) AS tok FROM lines)
SELECT count(*) FILTER (length(trim(body)) < 10) AS heading_only, count(*) FILTER (tok < 20) AS tiny, count(*) FILTER (tok > 1500) AS huge,
count(*) FILTER (tok < 30 AND regexp_matches(lower(concat(heading, ' ', body)), 'table of contents|exhibit|- i -|- ii -|page')) AS noise FROM t""")
def _(v):
    return R.audit(v("lines").select("heading", "body", F.ceil(F.length("body") / 4).alias("token_count")))


@query("grounding_report", f"""WITH o AS (SELECT l.clause_type, regexp_extract(body, '{_ACTION}', 1) AS action, coalesce(t.party, '') AS party, l.body, t.confidence AS score FROM lines l JOIN tasks t ON t.id = l.id)
SELECT coalesce(clause_type, 'TOTAL') AS clause_type, count(*) AS n, count(*) FILTER (action <> '' AND instr(body, upper(left(action, 3)) || substr(action, 4)) = 0) AS ungrounded,
count(*) FILTER (party <> '' AND instr(lower(body), lower(party)) = 0) AS fabricated, count(*) FILTER (action = '') AS abstained, round(avg(score) FILTER (score > 0), 6) AS mean_score FROM o GROUP BY ROLLUP (clause_type)""")  # fmt: skip
def _(v):
    t = v("tasks").select("id", "party", F.col("confidence").alias("score"))
    action = F.regexp_extract("body", _ACTION, 1)
    rows = v("lines").join(t, "id").select("clause_type", F.concat(F.upper(F.left(action, F.lit(3))), F.substring(action, 4, 1000)).alias("action"), "party", "body", "score")
    return R.grounding(rows, "clause_type")


@query("class_distribution", "SELECT clause_type AS class, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () < 10 AS rare FROM lines GROUP BY 1")
def _(v):
    return C.rare_classes(v("lines"), "clause_type")


# --- stored state ------------------------------------------------------------------------------


@query("get_owned", f"SELECT id, user_id, status FROM contracts WHERE id = (SELECT min(id) FROM contracts WHERE user_id = {USER}) AND user_id = {USER}")
def _(v):
    first = v("contracts").where(F.col("user_id") == USER).agg(F.min("id").alias("id")).first().id
    return R.require_owned(v("contracts"), first, USER).select("id", "user_id", "status")


@query("fail_contracts", """SELECT id, CASE WHEN status = 'PROCESSING' THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'PROCESSING' THEN CASE id % 3 WHEN 0 THEN 'Pipeline failed' WHEN 1 THEN 'Timeout: no answer' ELSE 'Timeout' END ELSE error_message END AS error_message FROM contracts""")
def _(v):
    told = F.when(F.col("id") % 3 == 0, "").otherwise(U.error_text(F.lit("Timeout"), F.when(F.col("id") % 3 == 1, " no answer ")))
    return U.fail(v("contracts"), v("contracts").where("status = 'PROCESSING'").select("id", told.alias("message"))).select("id", "status", "error_message")


_NOTES = "SELECT event_id AS id, user_id, event_id % 3 = 0 AS read FROM events"


@query("mark_read", f"SELECT id, user_id, CASE WHEN user_id = {USER} AND id % 2 = 0 THEN true ELSE read END AS read FROM ({_NOTES})")
def _(v):
    notes = v("events").select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 3 == 0).alias("read"))
    return U.mark_read(notes, notes.where("id % 2 = 0").select("id"), USER)


_EMAIL = "concat(CASE WHEN c_custkey % 2 = 0 THEN ' User' ELSE 'user' END, CAST(c_custkey % 50 AS {0}), '@Example.com ')"


@query("register", f"""WITH w AS (SELECT c_custkey AS place, lower(trim({_EMAIL.format('VARCHAR')})) AS email FROM customer)
SELECT email, place, row_number() OVER (PARTITION BY email ORDER BY place) = 1 AND email NOT IN ('user3@example.com', 'user4@example.com') AS accepted FROM w""")  # fmt: skip
def _(v):
    wanted = v("customer").select(F.col("c_custkey").alias("place"), F.expr(_EMAIL.format("STRING")).alias("email"))
    users = wanted.sparkSession.createDataFrame([(" USER3@example.com",), ("user4@example.com",)], "email string")
    return U.register(users, wanted)


@query("login", """SELECT c_custkey AS place, c_custkey % 4 = 0 AND c_custkey % 3 <> 0 AS ok FROM customer""")
def _(v):
    users = v("customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@x.org")).alias("email"), F.md5(F.col("c_custkey").cast("string")).alias("password_hash"))
    word = F.when(F.col("c_custkey") % 3 == 0, "wrong").otherwise(F.md5(F.col("c_custkey").cast("string")))
    tries = v("customer").select(F.concat(F.lit(" U"), F.col("c_custkey").cast("string"), F.lit("@X.org")).alias("email"), word.alias("password_hash"))
    return U.login(users, tries).select(F.regexp_extract("email", r"u(\d+)@", 1).cast("long").alias("place"), "ok")


_PATCHED = ["priority", "status"]


@query("apply_patch", """WITH c AS (SELECT id, priority, status, CASE WHEN clause_index % 2 = 0 THEN 'HIGH' END AS new_priority, CASE WHEN clause_index % 3 = 0 THEN 'DONE' END AS new_status FROM tasks),
d AS (SELECT *, new_priority IS NOT NULL AND new_priority IS DISTINCT FROM priority AS p, new_status IS NOT NULL AND new_status <> status AS s FROM c)
SELECT id, CASE WHEN p THEN new_priority ELSE priority END AS priority, CASE WHEN s THEN new_status ELSE status END AS status, CASE WHEN p THEN concat(coalesce(priority, 'null'), '>', new_priority) ELSE 'old>older' END AS corrected, p OR s AS audited FROM d""")
def _(v):
    rows = v("tasks").select("id", "priority", "status").withColumn("corrected", F.expr("map('priority', named_struct('old', 'old', 'new', 'older'))"))
    changes = v("tasks").select("id", F.when(F.col("clause_index") % 2 == 0, "HIGH").alias("priority"), F.when(F.col("clause_index") % 3 == 0, "DONE").alias("status"))
    state, audit = U.apply_patch(rows, changes, _PATCHED)
    entry = F.col("corrected")["priority"]
    shown = F.concat(F.coalesce(entry["old"], F.lit("null")), F.lit(">"), entry["new"])
    return state.join(audit.select("id", F.lit(True).alias("audited")), "id", "left").select("id", "priority", "status", shown.alias("corrected"), F.coalesce("audited", F.lit(False)).alias("audited"))


@query("delete_cascade", f"""WITH gone AS (SELECT id FROM contracts WHERE user_id = {USER}), dead AS (SELECT id FROM tasks WHERE contract_id IN (FROM gone))
SELECT 'contracts' AS part, count(*) AS n FROM contracts WHERE id NOT IN (FROM gone) UNION ALL SELECT 'clauses', count(*) FROM lines WHERE contract_id NOT IN (FROM gone)
UNION ALL SELECT 'tasks', count(*) FROM tasks WHERE contract_id NOT IN (FROM gone) UNION ALL SELECT 'reminders', count(*) FROM reminders WHERE task_id NOT IN (FROM dead)
UNION ALL SELECT 'notifications', count(*) FROM tasks WHERE id NOT IN (FROM dead) OR clause_index % 2 = 0""")  # fmt: skip
def _(v):
    notes = v("tasks").select(F.when(F.col("clause_index") % 2 == 1, F.col("id")).alias("task_id"))
    tables = {"contracts": v("contracts"), "clauses": v("lines"), "tasks": v("tasks"), "reminders": v("reminders"), "notifications": notes}
    left = U.cascade(v("contracts").where(F.col("user_id") == USER).select("id"), tables)
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query("utc_midnight", "SELECT id, CAST(epoch(CAST(due_date AS TIMESTAMP)) AS BIGINT) AS seconds FROM tasks")
def _(v):
    return v("tasks").select("id", F.unix_timestamp(U.to_utc_midnight(F.col("due_date"))).alias("seconds"))


@query("surrogate_ids", "SELECT count(*) AS n, count(DISTINCT id) AS keys FROM lines")
def _(v):
    return U.surrogate_ids(v("lines").select("id"), "id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("surrogate_id").alias("keys"))


# --- files, JSON, curation ---------------------------------------------------------------------

_BROKEN = "CASE event_id % 6 WHEN 0 THEN 'not json' WHEN 1 THEN left(props, 5) WHEN 2 THEN '[1]' WHEN 3 THEN NULL ELSE props END"


@query("json_parse_props", f"SELECT event_id, CAST(json_extract_string(p, '$.k') AS INT) AS k FROM (SELECT event_id, {_BROKEN} AS p FROM events) WHERE json_valid(p) AND json_type(p) = 'OBJECT'")
def _(v):
    rows = v("events").select("event_id", F.expr(_BROKEN).alias("p"))
    return S.parse_json(rows, "p", "k int").select("event_id", "parsed.k")


_REPLY = "CASE n % 5 WHEN 0 THEN concat('```json\\n', r, '\\n```') WHEN 1 THEN concat('```', r, '```') WHEN 2 THEN concat('  ', r) WHEN 3 THEN 'sorry' ELSE replace(r, 'modality', 'kind') END"


@query("clean_replies", """SELECT id, CASE WHEN clause_index % 5 = 4 THEN NULL ELSE m END AS modality FROM (SELECT *, CASE clause_index % 4 WHEN 0 THEN 'OBLIGATION' WHEN 1 THEN 'DECLARATIVE' ELSE 'DUTY' END AS m FROM lines) WHERE n % 5 < 3 AND m <> 'DUTY' AND clause_index % 5 <> 4""")
def _(v):
    kind = F.when(F.col("clause_index") % 5 == 4, "").when(F.col("clause_index") % 4 == 0, "OBLIGATION").when(F.col("clause_index") % 4 == 1, "DECLARATIVE").otherwise("DUTY")
    rows = v("lines").select("id", "n", F.to_json(F.struct(kind.alias("modality"))).alias("r"))
    rows = rows.select("id", F.expr(_REPLY).alias("reply"))
    return C.clean_replies(rows, "reply").select("id", "modality")


@query("upload_errors", """SELECT id, CASE WHEN id % 7 = 0 THEN 'unsupported type' WHEN size_bytes > 200000 THEN 'too large' WHEN id % 5 = 0 THEN 'empty' WHEN id % 3 = 0 THEN 'not a PDF' END AS error FROM contracts""")
def _(v):
    c = v("contracts")
    size = F.when(F.col("size_bytes") > 200000, S.MOST_BYTES + 1).when(F.col("id") % 5 == 0, 0).otherwise(F.col("size_bytes"))
    head = F.when(F.col("id") % 3 == 0, "PK..").otherwise("%PDF-1.7").cast("binary")
    kind = F.when(F.col("id") % 7 == 0, "text/html").otherwise(" Application/PDF; charset=x")
    return c.select("id", S.upload_error(kind, size, head).alias("error"))


@query("rank_candidates", """WITH f AS (SELECT concat('/a/', p_partkey, '_', replace(lower(p_type), ' ', '_'), '.pdf') AS path, p_size * 4096 AS size, lower(p_type) AS t FROM part),
s AS (SELECT *, CAST(contains(path, 'brushed') AS INT) + CAST(contains(path, 'steel') AS INT) + CAST(contains(path, 'small') AS INT) AS score, left(regexp_extract(path, '[^_]*$'), 18) AS kind FROM f WHERE size BETWEEN 15360 AND 184320),
k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, size, path) AS r FROM s WHERE score > 0)
SELECT path, CAST(size AS BIGINT) AS size, score FROM k WHERE r = 1 ORDER BY score DESC, size, path LIMIT 14""")
def _(v):
    path = F.concat(F.lit("/a/"), F.col("p_partkey").cast("string"), F.lit("_"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit(".pdf"))
    return S.rank_files(v("part").select(path.alias("path"), (F.col("p_size") * 4096).cast("long").alias("size")), ["brushed", "Steel", "small"])


@query("label_names", "SELECT vec_id, n_name AS label_name FROM embeddings LEFT JOIN nation ON n_nationkey = CAST(regexp_extract(CAST(label AS VARCHAR), '[0-9]+') AS INT)")
def _(v):
    number = F.regexp_extract(F.col("label").cast("string"), "[0-9]+", 0)
    rows = v("embeddings").select("vec_id", F.try_to_number(number, F.lit("999999")).cast("int").alias("label"))
    return S.label_names(rows, v("nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("name"))).select("vec_id", "label_name")


@query("curate", f"""WITH a AS (SELECT id, clause_type AS category, concat(n, ' ', body) AS text, CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN 'OBLIGATION' WHEN 2 THEN 'PERMISSION' ELSE 'DECLARATIVE' END AS modality, regexp_extract(body, '{_SUBJECT}', 1) AS agent, regexp_extract(body, '{_ACTION}', 1) AS action FROM lines),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(left(text, 150)) ORDER BY id) AS r1 FROM a),
w AS (SELECT *, modality <> 'DECLARATIVE' AND agent = '' AND ({" OR ".join(f"contains(lower(text), '{k}')" for k in C.NOTICE_WORDS)}) AS down FROM f WHERE r1 = 1 AND modality IS NOT NULL AND length(text) >= 80),
g AS (SELECT *, row_number() OVER (PARTITION BY md5(trim(lower(text))) ORDER BY id) AS r2 FROM w WHERE modality = 'DECLARATIVE' OR down OR (agent <> '' AND action <> '')),
c AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(id), id) AS r3 FROM g WHERE r2 = 1)
SELECT id, category, CASE WHEN down THEN 'DECLARATIVE' ELSE modality END AS modality, CASE WHEN s < 750 THEN 'train' WHEN s < 875 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, CAST(concat('0x', left(md5(concat(id, ':42')), 8)) AS BIGINT) % 1000 AS s FROM c WHERE r3 <= 25)""")  # fmt: skip
def _(v):
    modality = F.expr("CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN 'OBLIGATION' WHEN 2 THEN 'PERMISSION' ELSE 'DECLARATIVE' END")
    rows = v("lines").select("id", F.col("clause_type").alias("category"), F.concat(F.col("n").cast("string"), F.lit(" "), "body").alias("text"), modality.alias("modality"), F.regexp_extract("body", _SUBJECT, 1).alias("agent"), F.regexp_extract("body", _ACTION, 1).alias("action"))
    return C.curate(rows).select("id", "category", "modality", "split")


@query("squad_examples", f"""WITH r AS (SELECT id, trim(body) AS context, n, CASE n % 4 WHEN 0 THEN 'OBLIGATION' WHEN 1 THEN 'PROHIBITION' WHEN 2 THEN 'PERMISSION' ELSE 'DECLARATIVE' END AS modality, lower(regexp_extract(body, '{_SUBJECT}', 1)) AS agent, regexp_extract(body, '{_ACTION}', 1) AS action FROM lines),
k AS (SELECT *, modality = 'DECLARATIVE' AS none, CASE WHEN modality <> 'DECLARATIVE' THEN modality ELSE CASE n % 3 WHEN 0 THEN 'OBLIGATION' WHEN 1 THEN 'PROHIBITION' ELSE 'PERMISSION' END END AS frame,
  CASE WHEN instr(context, agent) > 0 THEN instr(context, agent) ELSE instr(lower(context), agent) END AS a, CASE WHEN instr(context, action) > 0 THEN instr(context, action) ELSE instr(lower(context), action) END AS b FROM r WHERE modality = 'DECLARATIVE' OR (agent <> '' AND action <> '')),
e AS (SELECT *, unnest(['agent', 'action']) AS field FROM k WHERE none OR (a > 0 AND b > 0))
SELECT concat(id, '-', field) AS id, CASE concat(frame, field) {" ".join(f"WHEN '{m}{f}' THEN '{x}'" for m, fs in C.QUESTIONS.items() for f, x in fs.items())} END AS question,
CASE WHEN NOT none THEN CASE field WHEN 'agent' THEN context[a : a + length(agent) - 1] ELSE context[b : b + length(action) - 1] END END AS answer, none AS is_impossible FROM e""")  # fmt: skip
def _(v):
    modality = F.expr("CASE n % 4 WHEN 0 THEN 'OBLIGATION' WHEN 1 THEN 'PROHIBITION' WHEN 2 THEN 'PERMISSION' ELSE 'DECLARATIVE' END")
    rows = v("lines").select("id", F.col("n").alias("place"), F.col("body").alias("context"), modality.alias("modality"), F.lower(F.regexp_extract("body", _SUBJECT, 1)).alias("agent"), F.regexp_extract("body", _ACTION, 1).alias("action"), F.lit(None).cast("string").alias("source"))
    return C.squad_examples(rows).select("id", "question", "answer", "is_impossible")


@query("alias_map", "SELECT clause_type, arg_max(id, (clause_index, id)) AS last_id FROM lines GROUP BY 1")
def _(v):
    pairs = v("lines").select(F.col("clause_type").alias("alias"), F.col("id").alias("name"), F.struct("clause_index", "id").alias("place"))
    return R.alias_map(pairs).select(F.col("alias").alias("clause_type"), F.col("name").alias("last_id"))


@query("flatten_parts", "SELECT contract_id, id FROM lines")
def _(v):
    nested = v("lines").groupBy("contract_id", "clause_index").agg(F.collect_list("id").alias("ids")).groupBy("contract_id").agg(F.collect_list("ids").alias("parts"))
    return nested.select("contract_id", F.explode(F.flatten("parts")).alias("id"))


@query("token_entity", """WITH e AS (SELECT contract_id, id, n AS start, n + 3 AS stop FROM lines WHERE clause_index % 2 = 0), t AS (SELECT contract_id, id, n AS start, n + 2 AS stop FROM lines WHERE clause_index % 2 = 1)
SELECT t.id, arg_min(e.id, (e.start, e.stop, e.id)) AS entity FROM t LEFT JOIN e ON e.contract_id = t.contract_id AND e.start < t.stop AND t.start < e.stop GROUP BY t.id""")
def _(v):
    spans = v("lines").select("contract_id", "id", "clause_index", F.col("n").alias("start"))
    entities = spans.where("clause_index % 2 = 0").select("contract_id", "id", "start", (F.col("start") + 3).alias("end"))
    tokens = spans.where("clause_index % 2 = 1").select("contract_id", "id", "start", (F.col("start") + 2).alias("end"))
    return R.first_overlap(tokens, entities, "contract_id").select("id", "entity")


@query("distinct_paths", "SELECT DISTINCT filename FROM contracts WHERE user_id % 2 = 0")
def _(v):
    return v("contracts").where("user_id % 2 = 0").select("filename").distinct()


# --- progress, entities ------------------------------------------------------------------------

_STAGE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in (X.STAGE_PROGRESS | {"complete": 100}).items()) + " END"
_STAGE = "CASE event_id % 10 WHEN 0 THEN 'extract' WHEN 1 THEN 'segment' WHEN 2 THEN 'classify' WHEN 3 THEN 'ner' WHEN 4 THEN 'obligations' WHEN 5 THEN 'normalize_dates' WHEN 6 THEN 'generate_tasks' WHEN 7 THEN 'complete' WHEN 8 THEN 'other' END"


@query("progress_events", f"SELECT user_id AS contract_id, event_type AS stage, {_STAGE_SQL} AS progress_pct, CASE event_type WHEN 'complete' THEN 'COMPLETE' ELSE 'PROCESSING' END AS status FROM (SELECT user_id, {_STAGE} AS event_type FROM events) WHERE {_STAGE_SQL} IS NOT NULL")
def _(v):
    return X.progress_events(v("events").select(F.col("user_id").alias("contract_id"), F.expr(_STAGE).alias("stage")))


@query("progress_until_terminal", """WITH e AS (SELECT event_id, user_id, CASE event_id % 9 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'FAILED' ELSE 'PROCESSING' END AS status, ts FROM events),
f AS (SELECT user_id, min((ts, event_id)) AS stop FROM e WHERE status <> 'PROCESSING' GROUP BY 1)
SELECT e.event_id, e.user_id, e.status FROM e LEFT JOIN f ON f.user_id = e.user_id WHERE f.stop IS NULL OR (e.ts, e.event_id) <= f.stop""")
def _(v):
    status = F.when(F.col("event_id") % 9 == 0, "COMPLETE").when(F.col("event_id") % 9 == 1, "FAILED").otherwise("PROCESSING")
    return X.until_terminal(v("events").withColumn("status", status), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "status")


@query("consume_tokens", "SELECT event_id, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 3 DAY, true) AS accepted FROM events")
def _(v):
    return X.consume(v("events"), "user_id", "ts", "event_id", "3 days").select("event_id", "accepted")


_TEXT = "concat('On ', strftime(day, '%Y-%m-%d'), ' the Buyer shall pay $', n, ',000 or ', n, '.5% within ', n, ' business days to ACME corp.')"
_TEXT_SPARK = "concat('On ', date_format(day, 'yyyy-MM-dd'), ' the Buyer shall pay $', n, ',000 or ', n, '.5% within ', n, ' business days to ACME corp.')"


@query("rule_entities", f"""WITH t AS (SELECT id, {_TEXT} AS body, strftime(day, '%Y-%m-%d') AS d, n FROM lines),
e AS (SELECT id, body, unnest([d, concat('$', n, ',000'), concat(n, '.5%'), concat(n, ' business days')]) AS text, unnest(['DATE', 'MONEY', 'PERCENTAGE', 'DURATION']) AS label FROM t)
SELECT id, label, text, CAST(instr(body, CASE label WHEN 'PERCENTAGE' THEN concat('or ', text) WHEN 'DURATION' THEN concat('within ', text) ELSE text END) - 1 + CASE label WHEN 'PERCENTAGE' THEN 3 WHEN 'DURATION' THEN 7 ELSE 0 END AS INT) AS start FROM e""")  # fmt: skip
def _(v):
    rows = v("lines").select("id", F.expr(_TEXT_SPARK).alias("body"))
    return rows.select("id", F.explode(E.rule_entities(F.col("body"))).alias("e")).select("id", "e.label", "e.text", "e.start")


@query("phrase_entities", f"""WITH t AS (SELECT id, {_TEXT} AS body FROM lines) SELECT id, unnest(['Buyer', 'ACME corp']) AS text, CAST(unnest([instr(body, 'Buyer') - 1, instr(body, 'ACME corp') - 1]) AS INT) AS start FROM t""")
def _(v):
    rows = v("lines").select("id", F.expr(_TEXT_SPARK).alias("body"))
    return rows.select("id", F.explode(E.phrase_entities(F.col("body"), _parties(("Acme", "Acme Corp", "buyer", "Zeta")))).alias("e")).select("id", "e.text", "e.start")


@query("relations", f"""WITH t AS (SELECT id, {_TEXT} AS body FROM lines WHERE n % 2 = 0) SELECT id, 'Buyer' AS subject, 'shall' AS modal, 'pay' AS verb, regexp_extract(body, 'pay ([^.;]+)', 1) AS object FROM t""")
def _(v):
    text = F.when(F.col("n") % 2 == 0, F.expr(_TEXT_SPARK)).otherwise("No party is here, and it must be so.")
    rows = v("lines").select("id", text.alias("text"))
    return E.relations(rows.withColumn("entities", E.phrase_entities(F.col("text"), _parties(("buyer",)))))
