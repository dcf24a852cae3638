"""Functions and operators on small examples and by properties."""

import datetime
import json

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactspark.functions import dates as D
from pactspark.functions import numbers as N
from pactspark.functions import text as T
from pactspark.operators import relational as R
from pactspark.operators import segments as S
from pactspark.streaming import first_use, latest_progress, reminder_scan

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]


def test_numbers(spark):
    texts = ["thirty (30) days", "five (25) business days", "TWELVE (12) MONTHS", "sixty days", "twenty-five days", "three months", "10,000 months", "soon", "", None]
    assert one(spark, texts, N.parse_number) == [30, 25, 12, 60, 25, 3, 10000, None, None, None]
    assert one(spark, texts[:3] + ["five working days", "x"], N.parse_unit) == ["days", "business_days", "months", "business_days", "days"]
    assert one(spark, ["-3", "150", "5.6", "4.4", "2.5", "oops", None, "NaN", "Infinity", "-Infinity"], N.clamp_pct) == [0, 100, 6, 4, 2, 0, 0, 0, 100, 0]
    assert one(spark, ["-1", "0.3", "7", "x", None], N.clamp_unit) == [0.0, 0.3, 1.0, 0.0, 0.0]


def test_business_days(spark):
    start = datetime.date(2024, 1, 1)
    rows = [(start + datetime.timedelta(d), n) for d in range(7) for n in range(0, 13)]
    got = spark.createDataFrame(rows, "d date, n int").select("d", "n", D.business_days(F.col("d"), F.col("n"))).collect()
    assert all(r[2] == (pd.Timestamp(r[0]) + pd.offsets.BDay(r[1])).date() for r in got)


def test_headings(spark):
    texts = ["11. Entire Agreement", "2. The parties shall agree", "GOVERNING LAW", "SCHEDULE A", "Article I", "one", "", None]
    assert [bool(x) for x in one(spark, texts, T.is_missed_heading)] == [True, False, True, True, True, False, False, False]


def test_event_relative(spark):
    f = lambda b: D.event_relative(F.lit("days"), b)
    assert one(spark, ["ten (10) working days after having advised", "three (3) days of the date hereof"], f) == [True, False]


def test_parties(spark):
    assert one(spark, ['"the Company".', "[Licensee]", "a  b"], T.clean_party) == ["the Company", "Licensee", "a b"]
    assert one(spark, ["the Company", "if the Buyer pays", "", None], T.plausible_party) == [True, False, False, False]


@few
@given(st.lists(st.text(alphabet="ab ,;.\n", max_size=40).map(lambda s: s + ", provided that x"), min_size=1, max_size=5))
def test_trimmed_action_is_a_prefix(spark, texts):
    assert all(t.startswith(x) for t, x in zip(texts, one(spark, texts, T.trim_action)))


@few
@given(st.lists(st.tuples(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=3)), min_size=1, max_size=8))
def test_spans_are_slices(spark, pairs):
    rows = spark.createDataFrame(pairs, "t string, s string").select("t", "s", T.span_start(F.col("t"), F.col("s")).alias("at")).collect()
    assert all((r.at is None and (not r.s or r.s not in r.t)) or r.t[r.at : r.at + len(r.s)] == r.s for r in rows)


def test_scope_and_pages(spark):
    contracts = spark.createDataFrame([(1, 1), (2, 2)], "id int, user_id int")
    tasks = spark.createDataFrame([("a", 1), ("b", 2)], "id string, contract_id int")
    assert [r.id for r in R.owned(tasks, 1, contracts).collect()] == ["a"]
    assert R.require_owned(tasks, "a", 1, contracts=contracts).count() == 1
    with pytest.raises(R.NotOwned):
        R.require_owned(tasks, "b", 1, contracts=contracts)
    with pytest.raises(ValueError):
        R.page(tasks, 0)
    with pytest.raises(ValueError):
        R.calendar(tasks, datetime.date(2024, 1, 2), datetime.date(2024, 1, 1))


def test_segments(spark):
    items = [("d", 0, "text", "Before any heading we say this.", 1), ("d", 1, "section_header", "1. Payment Terms", 1), ("d", 2, "text", "The Buyer shall pay.", 2), ("d", 3, "text", "GOVERNING LAW", 2), ("d", 4, "text", "x", 3)]
    rows = S.segment_items(spark.createDataFrame(items, "doc_id string, item_idx int, label string, text string, page_no int")).orderBy("clause_index").collect()
    assert [(r.heading, r.body, r.end_page) for r in rows] == [("PREAMBLE", "Before any heading we say this.", 1), ("1. Payment Terms", "The Buyer shall pay.", 2), ("GOVERNING LAW", "x", 3)]
    merged = S.merge_orphans(S.segment_items(spark.createDataFrame(items, "doc_id string, item_idx int, label string, text string, page_no int"))).orderBy("clause_index").collect()
    assert merged[-1].text.endswith("GOVERNING LAW x")


def test_split_and_longest(spark):
    text = " ".join(f"Sentence {i} has exactly six words." for i in range(200))
    (r,) = S.split_oversized(spark.createDataFrame([(text,)], "text string")).collect()
    assert len(r.sub_chunks) > 2 and all(7 * c.count(".") <= 480 + 50 for c in r.sub_chunks)
    assert r.sub_chunks[1].split(". ")[0] in r.sub_chunks[0]
    spans = spark.createDataFrame([([(0, 3), (2, 9), (9, 10)],)], "spans array<struct<start: int, end: int>>")
    assert [tuple(x) for x in S.longest_spans(spans).first().spans] == [(2, 9), (9, 10)]


def test_audit_and_claims(spark):
    rows = spark.createDataFrame([(1, "LOW"), (2, "HIGH")], "id int, priority string")
    changes = spark.createDataFrame([(1, "HIGH"), (2, "HIGH")], "id int, priority string")
    (r,) = R.patch(rows, changes, "id", ["priority"]).collect()
    assert (r.id, json.loads(r.before), json.loads(r.after)) == (1, {"priority": "LOW"}, {"priority": "HIGH"})


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1), (1, 1), (2, 7)], "task_id int, days int").write.parquet(src)
    out = str(tmp_path / "out")
    empty = spark.createDataFrame([], "task_id int, days int")

    def delivered():
        return spark.read.schema("task_id int, days int").parquet(out) if (tmp_path / "out").exists() else empty

    for i in range(2):
        stream = spark.readStream.schema("task_id int, days int").parquet(src)
        reminder_scan(stream, delivered, lambda df: df.write.mode("append").parquet(out), ["task_id", "days"], str(tmp_path / f"cp{i}"), None).awaitTermination(120)
    assert sorted(map(tuple, delivered().collect())) == [(1, 1), (2, 7)]
    events = spark.createDataFrame([(1, 1, "a", datetime.datetime(2024, 1, 1)), (2, 1, "b", datetime.datetime(2024, 1, 2))], "event_id int, user_id int, event_type string, ts timestamp")
    assert latest_progress(events, "user_id", "event_type").first().event_type == "b"
    assert first_use(events, "user_id").first().ts.day == 1
