"""Scans of stored tables, and the contract tables that stand on the driver's ones.

``VIEWS`` maps a name to SQL that Spark and DuckDB both run. A view reads base tables
or other views; ``with_views`` writes the common table expressions a query needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The day that stands for today in every query.
AS_OF = "1998-09-02"

_BODIES = [
    "concat('The Buyer shall pay invoice ', CAST(l_orderkey AS STRING), ' within thirty (', CAST(l_linenumber * 5 AS STRING), ') days of the date hereof.')",
    "'The Seller shall not assign this Agreement, and must give written notice of twenty-five days.'",
    "'The Company may terminate this Agreement upon written notice, provided that sixty days have passed.'",
    "'Reports will be submitted by the Vendor each calendar month and quarterly statements follow.'",
    "'In the event that the Licensee fails to cure a breach within ten (10) business days after receipt of notice, the Licensor must notify the Lender.'",
    "'\"Net Revenue\" shall mean all amounts received by the Company.'",
    "'By: Name: J. Doe  Title: President'",
    "'This Agreement is governed by the laws of Delaware. Page 3 of 39'",
    "'WHEREAS the parties desire to cooperate and to share the cost of the program;'",
    "concat('The Distributor agrees to deliver the products to the Customer, except as waived in writing, within ', CAST(l_linenumber AS STRING), ' months of the effective date.')",
    "'This Agreement shall automatically renew for successive one-year terms unless either party elects to cancel.'",
    "'The Agent is required to keep records for five (25) business days and Rs. 1,00,000 is payable to Acme Corp. (the \"Acme\").'",
]
_HEADINGS = ["'11. Entire Agreement'", "'ARTICLE 5 - OBLIGATIONS OF THE COMPANY'", "'GOVERNING LAW'", "'Section 4.1 Payment Terms'", "'TABLE OF CONTENTS'", "'RECITALS'", "'2. the parties shall agree'", "'EXHIBIT A'", "'A. Term and Termination'"]
_ITEMS = [
    "'The Vendor shall perform the services as follows:'", "'5.1 To maintain all financial records of the program'", "'5.1.1 Acme Corp'", "'Acme Corp ● Complete and finalize the plan'",
    "'• Provide monthly statements to the Buyer'", "'Books and records shall be kept at the principal office'", "'Payments will be made by the Company on demand'", "'short'",
    "'The Licensee must not disclose the terms'", "'No duty is stated in this line at all'", "'2.3 NVOS'", "'NVOS - pay the fees of the auditor'", "'Each of the Parties shall contribute capital as follows:'", "'9.2 Assign and direct operational staff'",
]
_TYPES = ["'PAYMENT'", "'TERMINATION'", "'RENEWAL'", "'DELIVERY_OBLIGATIONS'", "'GOVERNING_LAW'", "'PREAMBLE'", "'CONFIDENTIALITY'", "'NO_WAIVER'", "'INDEMNIFICATION'"]


def _pick(key: str, options: list[str]) -> str:
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options)) + " END"


VIEWS = {
    "contracts": """
SELECT o_orderkey AS id, o_custkey AS user_id, concat('contract-', CAST(o_orderkey AS STRING), '.pdf') AS filename,
       CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'PENDING' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'PROCESSING' END END AS status,
       CASE WHEN o_orderstatus <> 'F' AND o_orderstatus <> 'O' AND o_orderkey % 3 = 0 THEN 'Timeout: no answer' END AS error_message,
       CAST(o_orderdate AS DATE) AS created_on, CAST(o_orderkey % 101 AS INT) AS progress_pct, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes
FROM orders""",
    "lines": f"""
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',
              CAST(CAST(l_quantity AS BIGINT) AS STRING), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS id,
       l_orderkey AS contract_id, CAST(l_linenumber AS INT) AS clause_index,
       {_pick("(l_partkey + l_linenumber)", _BODIES)} AS body, {_pick("(l_suppkey + l_linenumber)", _HEADINGS)} AS heading,
       {_pick("(l_partkey + l_suppkey)", _TYPES)} AS clause_type, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS INT) AS n
FROM lineitem""",
    "clause_texts": "SELECT contract_id AS clause_id, string_agg(body, ' ' ORDER BY clause_index, id) AS body FROM lines GROUP BY contract_id",
    "provision_texts": "SELECT contract_id AS clause_id, string_agg(concat(heading, '. ', body), ' ' ORDER BY clause_index, id) AS body FROM lines GROUP BY contract_id",
    "sentences": f"""
SELECT contract_id AS clause_id, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY clause_index, id) AS INT) AS sent_idx,
       {_pick("(n * 5 + clause_index)", _ITEMS)} AS text, {_pick("contract_id", _HEADINGS)} AS heading FROM lines""",
    "tasks": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',
              CAST(CAST(l_quantity AS BIGINT) AS STRING), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS id,
       l_orderkey AS contract_id, CAST(l_linenumber AS INT) AS clause_index,
       CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(l_shipdate AS DATE) END AS due_date,
       CASE l_linenumber % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' END AS priority,
       CASE l_suppkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'DONE' WHEN 2 THEN 'SNOOZED' ELSE 'DISMISSED' END AS status,
       CASE l_partkey % 5 WHEN 0 THEN 'ABSOLUTE' WHEN 1 THEN 'RELATIVE' WHEN 2 THEN 'RECURRING' WHEN 3 THEN 'Conditional' END AS date_type,
       CASE l_partkey % 4 WHEN 0 THEN 'OBLIGATION' WHEN 1 THEN 'PROHIBITION' WHEN 2 THEN 'PERMISSION' ELSE 'CONDITIONAL' END AS obligation_type,
       CASE l_suppkey % 6 WHEN 0 THEN 'the Company' WHEN 1 THEN ' "Licensee". ' WHEN 2 THEN 'if the Buyer accesses the site' WHEN 3 THEN '' WHEN 4 THEN 'Acme  Corp' ELSE 'a party of more than eight words in its whole long name' END AS party,
       l_returnflag = 'R' AS requires_review, CAST(CAST(l_quantity AS INT) AS DOUBLE) / 50 AS confidence, CAST(CAST(round(l_tax * 100) AS INT) AS DOUBLE) AS agent_score
FROM lineitem""",
    "reminders": f"""
SELECT id AS task_id, contract_id, o AS days_before, due_date - o AS remind_on, clause_index % 2 = 0 AS sent
FROM tasks CROSS JOIN (SELECT 90 AS o UNION ALL SELECT 30 UNION ALL SELECT 7 UNION ALL SELECT 1) offsets WHERE due_date IS NOT NULL""",
}
_SPARK = {"due_date - o": "date_sub(due_date, o)", ", ' ' ORDER BY clause_index, id)": ", ' ') WITHIN GROUP (ORDER BY clause_index, id)"}


def _needs(sql: str, among: tuple[str, ...]) -> list[str]:
    return [n for n in among if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table by Spark's reader, timestamps as instants in the session's zone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view as a DataFrame; nothing is registered in the session."""
    if name in BASE:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    for a, b in _SPARK.items():
        sql = sql.replace(a, b)
    used = _needs(sql, (*VIEWS, *BASE))
    for n in used:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in used})


def with_views(sql: str) -> str:
    """The query with the views it reads as common table expressions (DuckDB)."""
    found: list[str] = []

    def add(text: str) -> None:
        for n in _needs(text, tuple(VIEWS)):
            if n not in found:
                add(VIEWS[n])
                found.append(n)

    add(sql)
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in found]
    body = sql.strip()
    if parts and body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
