"""Operators on contracts against plain versions, on random and on odd input."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from pactspark.functions import labels as L
from pactspark.functions import text as T
from pactspark.operators import obligations as O  # noqa: E741
from pactspark.operators import provisions as V
from pactspark.operators import relational as R
from pactspark.operators import states as U
from pactspark.plans import curation as C
from pactspark.sources import files as S


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_provisions(spark):
    """Whole bodies are cut at markers that aren't cited; short introductions go, small pieces join the one before."""
    rng = random.Random(1)
    pieces = ["Section 3.01 [Cards] . Printing is done. ", "section 4 applies to all of it and more. ", "as in Section 5 hereof, ", "Article IV. Payment Terms. Any amounts due. ", "under Clause 2.1 the party ", "Clause 9 of this part. ", "Sec. 7 ", "plain words of no special kind here. ", "one two. ", "Sections 3 and 4 "]
    texts = [None, "", "Section 1 a"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 16))) for _ in range(300)]
    marker, before, after = (re.compile(x) for x in (V.MARKER, V.CITED_BEFORE, V.CITED_AFTER))

    def head(seg):
        m = re.match(V.MARKER_HEAD, seg)
        if not m:
            return None
        if (m[2] or "").strip():
            return f"{m[1].strip()} — {m[2].strip()}"
        t = re.match(V.TITLE, seg[m.end() :])
        return f"{m[1].strip()} — {t[1].strip()}" if t and len(t[1].split()) <= 9 else m[1].strip()

    def plain(body):
        if body is None or len(body) < 200:
            return [("H", body, 1)]
        at = [m.start() for m in marker.finditer(body) if not before.search(body[max(0, m.start() - 48) : m.start()]) and not after.match(body[m.end() : m.end() + 48])]
        if len(at) < 2:
            return [("H", body, 1)]
        found = [("H", body[: at[0]].strip())] if len(body[: at[0]].split()) >= 5 else []
        for a, b in zip(at, [*at[1:], len(body)]):
            seg = body[a:b].strip()
            found.append((head(seg) or "H", seg))
        out = []
        for h, t in found:
            if out and len(t) < 40:
                out[-1] = (out[-1][0], f"{out[-1][1]} {t}")
            else:
                out.append((h, t))
        return [(h, t, 2) for h, t in out] if len(out) > 1 else [("H", body, 1)]

    df = rows(spark, [(i, "CLAUSE", "H", t, 1) for i, t in enumerate(texts)], "id int, chunk_type string, heading string, body string, level int")
    got = {}
    for r in V.split_provisions(df).orderBy("id", "piece").collect():
        got.setdefault(r.id, []).append((r.heading, r.body, r.level))
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert sum(len(x) > 1 for x in got.values()) > 30
    table = df.withColumn("chunk_type", F.lit("TABLE"))
    assert V.split_provisions(table).count() == len(texts)


def test_provisions_of_long_bodies(spark):
    """Markers are found once, not anew for each piece; their offsets hold over blocks."""
    n = T.BLOCK * 2 + 3
    body = " ".join(f"Section {i}. Words of a provision that is long enough." for i in range(n))
    df = V.split_provisions(rows(spark, [(1, "CLAUSE", "H", body, 1), (2, "CLAUSE", "H", None, 1)], "id int, chunk_type string, heading string, body string, level int"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = df.orderBy("id", "piece").collect()
    assert [(r.body, r.level, r.piece) for r in got[:-1]] == [(f"Section {i}. Words of a provision that is long enough.", 2, i) for i in range(n)]
    assert tuple(got[-1]) == (2, "CLAUSE", "H", None, 1, 0)
    for k in (0, 1, T.BLOCK - 1, T.BLOCK, T.BLOCK + 1):
        (r,) = rows(spark, [("ab1, " * k,)], "t string").select(T.match_spans(F.col("t"), r"\d,").alias("x")).collect()
        assert [tuple(x) for x in r.x] == [(5 * i + 2, 5 * i + 4) for i in range(k)]


def test_duty_table(spark):
    known = ["Acme Corp", "XY"]
    texts = [
        "| Party | Duties |\n|---|:--:|\n| **Acme** | Deliver the goods | monthly |\n| xy | Keep the books |\n| Foo GmbH | short |\n| members | Attend all meetings |\n| Total | Pay all of it |\n| | Nothing at all |",
        "| Party | Royalty |\n|---|---|\n| Acme Corp | Ten per cent of sales |",
        "Party | Duties\nno table here",
        None,
        "",
    ]
    df = rows(spark, list(enumerate(texts)), "id int, text string")
    got = {r.id: [tuple(x) for x in r.x] for r in df.select("id", O.duty_table(F.col("text"), F.array(*map(F.lit, known))).alias("x")).collect()}
    assert got == {0: [("Acme Corp shall deliver the goods monthly", "Acme Corp", "Deliver the goods monthly"), ("XY shall keep the books", "XY", "Keep the books"), ("Members shall attend all meetings", "Members", "Attend all meetings")], 1: [], 2: [], 3: [], 4: []}


def test_candidates(spark):
    lines = [
        "9.1 To maintain all financial records",  # the heading's party
        "Each of the Parties shall contribute as follows:",
        "● Provide the premises",  # now the subject of the lead-in
        "5.1.1 NVOS Group",
        "Assign operational staff",
        "Acme - deliver the parts on time",  # Acme, from here on
        "Pay the auditor's fees",
        "Records shall be kept by the secretary",
        "The Buyer may inspect the goods",
        "tiny",
        "Nothing is said here at all",
    ]
    df = rows(spark, [(1, i, t, "ARTICLE 9 - OBLIGATIONS OF THE VENDOR", ["Acme", "NVOS Group"]) for i, t in enumerate(lines)] + [(2, 0, "Assign operational staff", "GENERAL", ["Acme"]), (3, 0, None, None, None)], "clause_id int, sent_idx int, text string, heading string, parties array<string>")
    got = [(r.text, r.hint, r.review) for r in O.candidates(df).orderBy("clause_id", "sent_idx").collect()]
    assert got == [
        ("VENDOR shall maintain all financial records", "VENDOR", False),
        ("Each of the Parties shall contribute as follows:", None, False),
        ("Each of the Parties shall provide the premises", "Each of the Parties", False),
        ("NVOS Group shall assign operational staff", "NVOS Group", False),
        ("Acme shall deliver the parts on time", "Acme", False),
        ("Acme shall pay the auditor's fees", "Acme", False),
        ("VENDOR shall keep Records by the secretary", "VENDOR", True),
        ("The Buyer may inspect the goods", None, False),
    ]


def test_associate(spark):
    """The nearest or the most specific deadline, as a plain version finds it."""
    rng = random.Random(2)
    rank = {k: i for i, k in enumerate(O.DATE_RANK)}
    clauses, obligations, deadlines = [(999, None)], [(999, "a", "pay it", None)], []
    for c in range(120):
        marks = [f"d{j}" for j in range(rng.randint(0, 4))]
        words = [rng.choice(["pay rent", "act", "Buyer", ". ", "x" * rng.randint(1, 150), *marks]) for _ in range(rng.randint(1, 25))]
        clauses.append((c, " ".join(words)))
        obligations += [(c, o, rng.choice(["pay rent", "act", "", None, "missing"]), rng.choice(["Buyer", "Seller", "", None])) for o in "ab"]
        deadlines += [(c, j, m if rng.random() < 0.9 else "", rng.choice([*rank, "OTHER"])) for j, m in enumerate(marks)]

    def plain(body, action, party, dates):
        body, action, party = body or "", (action or "").strip(), (party or "").strip()
        at = body.find(action) if len(action) > 3 else -1
        if at < 0 and party:
            at = body.find(party)
        if not dates:
            return None
        if at < 0:
            return dates[0][2] if len(dates) == 1 else None
        a = body.rfind(". ", 0, at)
        b = body.find(". ", at)
        sent = body[max(a + 2 if a >= 0 else 0, at - 400) : min(b + 1 if b >= 0 else len(body), at + 400)]
        inside = [d for d in dates if d[2] and d[2] in sent]
        if inside:
            return min(inside, key=lambda d: (rank.get(d[3], 99), d[1]))[2]
        near = [(abs(body.find(d[2]) - at), d[1], d[2]) for d in dates if d[2] and d[2] in body]
        return min(near)[2] if near and min(near)[0] <= 350 else None

    got = O.associate(rows(spark, clauses, "clause_id int, body string"), rows(spark, obligations, "clause_id int, ord string, action string, party string"), rows(spark, deadlines, "clause_id int, ord int, raw string, date_type string")).collect()
    bodies = dict(clauses)
    want = {(c, o): plain(bodies[c], a, p, sorted(d for d in deadlines if d[0] == c)) for c, o, a, p in obligations}
    assert {(r.clause_id, r.ord): r.deadline for r in got} == want
    assert sum(x is not None for x in want.values()) > 40


def test_parties(spark):
    known = ["Acme Corp", "Zeta Ltd"]
    cases = {"licensee": "Licensee", "acme": "Acme Corp", "The Acme Corp of X": "Acme Corp", "Force Majeure": None, "The board": None, "The Board": "The Board", "a b c d e f g": None, "x" * 51: None, "globex": None, "Globex": "Globex", "": None, None: None}
    df = rows(spark, [(k,) for k in cases], "name string")
    assert {r.name: r.v for r in df.select("name", O.validate_party(F.col("name"), F.array(*map(F.lit, known))).alias("v")).collect()} == cases
    generic = df.sparkSession.createDataFrame([("Either Party",), ("all parties",), ("Acme",), (None,)], "name string")
    assert [r[0] for r in generic.select(O.resolve_generic(F.col("name"), F.array(*map(F.lit, known)))).collect()] == ["Acme Corp", "Acme Corp and Zeta Ltd", "Acme", None]
    assert [r[0] for r in generic.select(O.resolve_generic(F.col("name"), F.lit(None).cast("array<string>"))).collect()] == ["Either Party", "all parties", "Acme", None]


def test_labels(spark):
    names = ["Payment_Terms", "Non-Compete Covenant", "governing-law", "zzz", "", None, "Late Fee"]
    got = [r[0] for r in rows(spark, [(n,) for n in names], "n string").select(L.collapse_label(F.col("n"))).collect()]
    assert got == ["PAYMENT", "NON_COMPETE", "GOVERNING_LAW", "ENTIRE_AGREEMENT", "ENTIRE_AGREEMENT", None, "PAYMENT"]
    probs = rows(spark, [(1, [0.2, 0.8, 0.0], "renews"), (2, [0.5, 0.5, 0.0], "x"), (3, [0.1, 0.1, 0.8], "x"), (4, [], "x"), (5, None, "x")], "id int, probs array<double>, body string")
    found = {r.id: r for r in L.predict(probs, "probs", "body", ["A", "B", "RENEWAL"]).collect()}
    assert (found[1].clause_type, found[1].needs_review, found[1].alternatives) == ("B", False, [])
    assert (found[2].clause_type, found[2].needs_review, [x.label for x in found[2].alternatives]) == ("A", True, ["A", "B", "RENEWAL"])
    assert (found[3].clause_type, found[3].needs_review) == ("RENEWAL", True)
    assert found[4].confidence is None and found[5].confidence is None


def test_bio_tags(spark):
    rng = random.Random(3)
    words = ["the", "Buyer", "shall", "pay", "rent", "the buyer", "now"]
    data = [(" " * rng.randint(0, 2) + "  ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), rng.choice(["the buyer", "Buyer", None, "null", "zz"]), rng.choice(["pay rent", "buyer  shall", "", None])) for _ in range(200)]

    def plain(text, agent, action):
        tokens = [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        tags = ["O"] * len(tokens)
        for span, label in ((agent, "AGENT"), (action, "ACTION")):
            if not span or span.lower() == "null" or (a := text.lower().find(span.lower())) < 0:
                continue
            first = True
            for i, (_, s, e) in enumerate(tokens):
                if e > a and s < a + len(span) and tags[i] == "O":
                    tags[i] = ("B-" if first else "I-") + label
                    first = False
        return [(t, x) for (t, _, _), x in zip(tokens, tags)]

    got = rows(spark, data, "text string, agent string, action string").select("text", "agent", "action", L.bio_tags(F.col("text"), F.col("agent"), F.col("action")).alias("x")).collect()
    assert all([tuple(y) for y in r.x] == plain(r.text, r.agent, r.action) for r in got)


def test_bio_tags_of_long_texts(spark):
    """Words and places are found once, not anew for each word."""
    made = L.bio_tags(F.col("text"), F.lit("the buyer"), F.lit("pay rent"))
    df = rows(spark, [("x " * 3000 + "The Buyer shall  pay the rent",), (None,)], "text string").select(made.alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2
    long, none = (r.x for r in df.collect())
    assert [t["tag"] for t in long] == ["O"] * 3000 + ["B-AGENT", "I-AGENT", "O", "O", "O", "O"] and none is None
    (r,) = rows(spark, [("x " * 1000 + "the buyer must pay rent",)], "text string").select(made.alias("x")).collect()
    assert [t["tag"] for t in r.x][1000:] == ["B-AGENT", "I-AGENT", "O", "B-ACTION", "I-ACTION"]


def test_strided_windows(spark):
    for n in (0, 1, 4, 5, 6, 8, 9, 10, 31):
        (r,) = rows(spark, [([str(i) for i in range(n)],)], "t array<string>").select(L.strided_windows(F.col("t"), 5, 2).alias("w")).collect()
        at, want = 0, []
        while True:
            want.append((at, [str(i) for i in range(at, min(n, at + 5))]))
            if at + 5 >= n:
                break
            at += 3
        assert [(w["first"], w["tokens"]) for w in r.w] == want


def test_malformed_json(spark, tmp_path):
    lines = ['{"k": 1}', "not json", '{"k": 2', "[1]", "", None, '{"k": null}', '{"other": 3}', '  {"k": 4}  ', '{"k": "x"}', "null", "7"]
    got = S.parse_json(rows(spark, list(enumerate(lines)), "id int, p string"), "p", "k int")
    assert {(r.id, r.parsed.k) for r in got.collect()} == {(0, 1), (6, None), (7, None), (8, 4)}
    (tmp_path / "x.jsonl").write_text("\n".join(x or "" for x in lines))
    assert sorted(r.k or 0 for r in S.read_jsonl(spark, str(tmp_path / "x.jsonl"), "k int").collect()) == [0, 0, 1, 4]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text(" first \fsecond\f")
    pages = S.read_pages(spark, str(tmp_path / "a"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, " first "), (2, "second"), (3, "")]
    assert S.page_dump(pages).first().text == "===== PAGE 1 =====\nfirst\n===== PAGE 2 =====\nsecond\n===== PAGE 3 =====\n"
    assert [(r.path.rpartition("/")[2], r["size"]) for r in S.list_files(spark, str(tmp_path / "a")).collect()] == [("one.txt", 15)]
    df = rows(spark, [(1, "train"), (2, "test"), (3, "train")], "id int, split string")
    S.write_jsonl(df, str(tmp_path / "out"), "split")
    assert sorted(r.id for r in S.read_jsonl(spark, str(tmp_path / "out" / "split=train"), "id int").collect()) == [1, 3]
    S.write_report(rows(spark, [(2, "b"), (1, "a"), (3, None)], "place int, line string"), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 3
    S.replace_folder(df, str(tmp_path / "table"))
    S.replace_folder(spark.read.parquet(str(tmp_path / "table")).where("id > 1"), str(tmp_path / "table"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [2, 3]
    assert sorted(p.name for p in tmp_path.iterdir() if "table" in p.name) == ["table"]


def test_object_store(spark, tmp_path):
    store = S.ObjectStore(spark, str(tmp_path / "root"))
    store.put("x/y.pdf", b"%PDF\x00\xff")
    assert store.get("/x/y.pdf") == b"%PDF\x00\xff" and store.exists("x//./y.pdf") and not store.exists("x/z")
    store.put("x/y.pdf", b"")
    assert store.get("x/y.pdf") == b""
    assert store.delete("x/y.pdf") and not store.delete("x/y.pdf")
    with pytest.raises(KeyError):
        store.get("x/y.pdf")
    for bad in ("", " ", "../z", "a/../../z", "..\\z"):
        with pytest.raises(ValueError):
            store.url(bad)


def test_states(spark):
    contracts = rows(spark, [(1, "PROCESSING", None), (2, "COMPLETE", None)], "id int, status string, error_message string")
    told = rows(spark, [(1, "")], "id int, message string")
    assert sorted(map(tuple, U.fail(contracts, told).collect())) == [(1, "FAILED", "Pipeline failed"), (2, "COMPLETE", None)]
    users = rows(spark, [(" A@x.org", "h1")], "email string, password_hash string")
    wanted = rows(spark, [("a@X.org", 1), ("b@x.org ", 2), ("B@x.org", 3), ("  ", 4)], "email string, place int")
    assert {r.place: r.accepted for r in U.register(users, wanted).collect()} == {1: False, 2: True, 3: False, 4: False}
    tries = rows(spark, [("a@x.org", "h1"), ("a@x.org", "no"), ("q@x.org", "h1"), ("a@x.org", None)], "email string, password_hash string")
    assert sorted(r.ok for r in U.login(users, tries).collect()) == [False, False, False, True]
    day = rows(spark, [(datetime.date(2024, 2, 29),), (None,)], "d date")
    assert [r[0] for r in day.select(F.unix_timestamp(U.to_utc_midnight(F.col("d")))).collect()] == [1709164800, None]
    ids = U.surrogate_ids(rows(spark, [("a",), ("b",), ("a",)], "k string"), "k").collect()
    assert ids[0].surrogate_id == ids[2].surrogate_id != ids[1].surrogate_id and min(r.surrogate_id for r in ids) >= 0


def test_patch(spark):
    data = [(1, "LOW", "PENDING", {"priority": ("HIGH", "LOW")}), (2, "LOW", "PENDING", None), (3, None, "DONE", {"title": ("a", "b")})]
    state = rows(spark, data, "id int, priority string, status string, corrected map<string, struct<old: string, new: string>>")
    changes = rows(spark, [(1, "MEDIUM", "DONE"), (2, "LOW", None), (3, "HIGH", None)], "id int, priority string, status string")
    new, audit = U.apply_patch(state, changes, ["priority", "status"])
    assert {r.id: (r.priority, r.status, {k: tuple(v) for k, v in r.corrected.items()}) for r in new.collect()} == {
        1: ("MEDIUM", "DONE", {"priority": ("LOW", "MEDIUM")}),
        2: ("LOW", "PENDING", {}),
        3: ("HIGH", "DONE", {"title": ("a", "b"), "priority": (None, "HIGH")}),
    }
    assert {r.id: (r.before, r.after) for r in audit.collect()} == {1: ('{"priority":"LOW","status":"PENDING"}', '{"priority":"MEDIUM","status":"DONE"}'), 3: ("{}", '{"priority":"HIGH"}')}


def test_curation(spark):
    long = " ".join(f"w{i}" for i in range(45))
    action = "pay " + " ".join(f"a{i}" for i in range(30)) + ", unless excused, " + " ".join(f"b{i}" for i in range(20))
    data = [
        (1, "c", "x" * 80, "DECLARATIVE", None, "gone"),
        (2, "c", "short", "DECLARATIVE", None, None),
        (3, "c", long + " notice is given", "OBLIGATION", None, "act"),
        (4, "c", long + " other", "OBLIGATION", "", "other"),
        (5, "c", long + " agent", "OBLIGATION", "A", None),
        (6, "c", f"The A shall {action}", "OBLIGATION", "A", action),
        (7, "c", long + " absent", "OBLIGATION", "A", "not there"),
        (8, None, "y" * 80, None, None, None),
    ]
    df = rows(spark, data, "id int, category string, text string, modality string, agent string, action string")
    got = {r.id: (r.modality, r.action) for r in C.repair(df).collect()}
    assert got == {1: ("DECLARATIVE", "gone"), 3: ("DECLARATIVE", None), 6: ("OBLIGATION", action.partition(", unless")[0])}
    many = rows(spark, [(i, f"c{i % 2}", f"{i} " + "z" * 80, "DECLARATIVE", None, None) for i in range(80)], df.schema)
    out = C.curate(many).collect()
    assert len(out) == 50 and {r.split for r in out if r.category == "c0"} == {"train", "val", "test"} and len(C.curate(df.limit(0)).collect()) == 0


def test_resolve(spark):
    tasks = rows(spark, [(1, 1, "A", "do this now"), (2, 1, "Z", "do that"), (3, 2, "A", "x"), (4, 3, None, "x")], "id int, clause_id int, kind string, source_text string")
    found = rows(spark, [(1, 1, "A", "else"), (1, 2, "A", "this"), (1, 3, "B", "do that"), (1, 0, "B", " "), (2, 1, "A", ""), (3, 1, None, "n")], "clause_id int, ord int, kind string, found string")
    assert {r.id: r.found for r in R.resolve(tasks, found).collect()} == {1: "this", 2: "do that", 3: None, 4: "n"}


def test_entities(spark):
    from pactspark.operators import entities as E

    text = "ACME Corp and acme met on May 5, 2011; Acme Corporation owes $1,000 and 5 percent within thirty (30) days."
    df = rows(spark, [(1, text, ["Acme", "acme corp", "x.*", ""]), (2, None, ["a"]), (3, "", None)], "id int, t string, names array<string>")
    got = {r.id: r for r in df.select("id", E.rule_entities(F.col("t")).alias("e"), E.phrase_entities(F.col("t"), F.col("names")).alias("p")).collect()}
    assert [(e.label, e.text) for e in got[1].e] == [("DATE", "May 5, 2011"), ("MONEY", "$1,000"), ("PERCENTAGE", "5 percent"), ("DURATION", "thirty (30) days")]
    assert [(e.text, e.start) for e in got[1].p] == [(text[a:b], a) for a, b in ((0, 9), (14, 18), (39, 48))]
    assert all(text[e.start : e.end] == e.text for e in [*got[1].e, *got[1].p])
    assert got[2].e == got[2].p == got[3].e == got[3].p == []


def test_streamed_progress(spark, tmp_path):
    from pactspark import streaming as X

    rows(spark, [(1, "extract"), (1, "complete"), (2, "odd"), (3, None)], "contract_id int, stage string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("contract_id int, stage string").json(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        X.publish(X.progress_events(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((r.progress_pct, r.status) for r in spark.read.json(str(tmp_path / "out")).collect()) == [(5, "PROCESSING"), (100, "COMPLETE")]


def test_segments(spark):
    from pactspark.operators.segments import segment_items

    items = [
        (1, 0, "text", "before any heading", 1),
        (1, 1, "table", "| a | b |", 1),
        (1, 2, "section_header", "Payment", 2),
        (1, 3, "text", "pay now", 2),
        (1, 4, "Table", "| c | d |", 3),
        (1, 5, "text", "and later", 4),
        (1, 6, "text", "11. Entire Agreement. This is the whole of it all.", 5),
        (1, 7, "text", "nothing else", 6),
        (2, 0, "title", "Alone", None),
    ]
    got = segment_items(rows(spark, items, "doc_id int, item_idx int, label string, text string, page_no int")).orderBy("doc_id", "clause_index").collect()
    assert [(r.doc_id, r.clause_index, r.chunk_type, r.heading, r.body, r.start_page, r.end_page) for r in got] == [
        (1, 0, "CLAUSE", "PREAMBLE", "before any heading", 1, 1),
        (1, 1, "TABLE", None, "| a | b |", 1, 1),
        (1, 2, "CLAUSE", "Payment", "pay now and later", 2, 4),
        (1, 3, "TABLE", None, "| c | d |", 3, 3),
        (1, 4, "CLAUSE", "11. Entire Agreement.", "This is the whole of it all. nothing else", 5, 6),
        (2, 0, "CLAUSE", "Alone", "", None, None),
    ]
