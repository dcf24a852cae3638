"""A corpus pipeline of five stages; each reads all that its predecessor kept.

Stages take and return the columns of ``documents`` (doc_id, text, lang, source, n_chars) and drop any
others; n_chars is brought up to date where a stage changes texts. The last returns the pieces of
``packing.pack``. Null ids and texts go through all stages; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactspark.llm import line_dedup, near_dup, packing, secrets, toxicity
from pactspark.llm.common import materialise, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dup", near_dup.stage),
    ("secrets", secrets.stage),
    ("packing", packing.stage),
]

#: Segment search, Order MinHash and tokenising are beyond SQL; tests/llm/test_plain.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; what each stage kept is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
