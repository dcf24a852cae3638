"""The training-data operators against brute force, and their defined results for odd input."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from pactspark.llm import ann, bpe, common, langid, line_dedup, media, near_dup, packing, secrets, token_counts, toxicity
from pactspark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: Nulls, empty and long texts, repeated rows, and extra columns whose names clash with inner ones.
ODD = [
    (1, "plain words, nothing else here", "en", "a", 5),
    (1, "plain words, nothing else here", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (None, "token: abcdef123 \x01 \x1f é́  😀", "fr", "b", 9),
    (4, "long " * 30_000 + "\nend", "en", "b", 1),
    (5, "日本語 のテキスト\n\n\r\n  ", None, "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS spans", "1 AS label", "2 AS n_lines", "3 AS _id", "4 AS _lines")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_twins(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    twin = c.sql(SQL[name])
    names = [d[0] for d in twin.description]
    assert sorted(map(repr, twin.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in QUERIES[name](spark, SF).collect())


def test_secrets(spark, docs, odd):
    kinds = [
        ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    extra = ["token=token: abcdef", "AKIA" * 8, "ſecret: abcdefgh PASSWD='a.b+c/d=' api_key:  \"x\"", "😀 secret = zzzzzz😀" + "0f" * 30]
    rows = spark.createDataFrame([*docs.items(), *((10**6 + i, t) for i, t in enumerate(extra))], "doc_id long, text string")
    for r in secrets.find_spans(rows).collect():
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(r.text) if ok(m))
        assert [tuple(s) for s in r.base_spans] == found
        assert {tuple(s) for s in r.base_spans} <= {tuple(s) for s in r.spans}
    assert secrets.redact(odd).columns == odd.columns
    assert secrets.redact(odd).where("doc_id IS NULL").first().text.startswith("[REDACTED] ")


def test_entropy_windows(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(rng.choice(["0123456789abcdef", "ab1", secrets.ALPHABET, "ABCDEFGH123"])) for _ in range(rng.randint(20, 70))) for _ in range(150)]
    scale = lambda c: round(c * np.log2(c) * secrets._SCALE) if c > 1 else 0
    for r in secrets.find_spans(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allow_list=()).collect():
        kind = 3 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", r.text) else 4 if re.fullmatch("[A-Z0-9]+", r.text) else 5
        limit = round((np.log2(20) - [*secrets.THRESHOLDS.values()][kind - 3]) * 20 * secrets._SCALE)
        good = [i for i in range(len(r.text) - 19) if sum(scale(r.text[i : i + 20].count(c)) for c in set(r.text[i : i + 20])) <= limit] if re.search("[0-9]", r.text) else []
        assert [tuple(s) for s in r.spans if s.kind >= 3] == ([(good[0], kind, good[-1] + 20)] if good else [])


def test_joined_keys(spark):
    """Keys of one class are found and redacted as a whole, whatever name is joined to them."""
    rng = random.Random(4)
    lower, upper, hexes = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789ABCDEF"
    texts = []
    for name in ("", "key=", "SESSION=", "sk_live_", "/a/b/"):
        for letters, n in ((lower, 20), (lower, 32), (upper, 32), (hexes, 32)):
            texts += [(name, "".join(rng.choice(letters) for _ in range(n))) for _ in range(30)]
    rows = spark.createDataFrame([(i, f"see {a}{k} here") for i, (a, k) in enumerate(texts)], "doc_id long, text string")
    left = [k for r in secrets.redact(rows).collect() for k in [texts[r.doc_id][1]] if any(k[j : j + 8] in r.text for j in range(len(k) - 7))]
    assert len(left) < 0.05 * len(texts)
    assert secrets.redact(spark.createDataFrame([(1, "see 12345678901234567890123 and abcdefghij0123456789 or internationalisationally")], "doc_id long, text string")).first().text.startswith("see 12345678901234567890123 and abcdefghij0123456789 or")


def test_media(spark, odd):
    for r in media.read_features(media.store_texts(odd.select("doc_id", "text"))).collect():
        raw = (next(t for i, t, *_ in ODD if i == r.doc_id) or "").encode()
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (9, 13), dtype=np.uint8)
    good = media.encode_png(pixels)
    assert (media.decode_png(good) == pixels).all()
    for i in range(8, len(good)):  # every flipped byte is noticed
        with pytest.raises(ValueError):
            media.decode_png(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :])
    lines = np.zeros((5, 14), np.uint8)
    lines[:, 0] = range(5)
    lines[:, 1:] = rng.integers(0, 256, (5, 13))
    out = media._unfilter(lines, 13).astype(int)
    for y, x in itertools.product(range(5), range(13)):
        a, b, c = (out[y, x - 1] if x else 0), (out[y - 1, x] if y else 0), (out[y - 1, x - 1] if x and y else 0)
        paeth = min((abs(a + b - c - v), i, v) for i, v in enumerate((a, b, c)))[2]
        assert out[y, x] == (int(lines[y, x + 1]) + [0, a, b, (a + b) // 2, paeth][y]) % 256
    images = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no")), (3, None)], "id long, png binary")
    assert [(r.width, r.phash is None) for r in media.hash_images(images, "id", "png").orderBy("id").collect()] == [(13, False), (None, True), (None, True)]


def test_ann(spark):
    rows = common.table(spark, SF, "embeddings")
    ids, x = zip(*[(r.vec_id, r.embedding) for r in rows.orderBy("vec_id").collect()])
    ids, x = np.array(ids), np.array(x, float)
    hits = 0
    found = {}
    for r in QUERIES["op3_ann"](spark, SF).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    for q in ids[ids % 20 == 0]:
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hits += len({*ids[np.lexsort((ids, -s))[:20]]} & {*found[q]})
    assert hits >= 0.9 * 20 * len(found)
    few = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 2.0]), (6, [0.0, 2.0]), (7, [])]
    got = ann.search(spark.createDataFrame(few, "vec_id long, embedding array<float>"), "id % 20 = 0").collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 20), (0, 3, 6), (20, 1, 0), (20, 2, 1), (20, 3, 6)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "id % 20 = 0").count() == 0


def test_langid(spark, odd):
    found = QUERIES["op4_langid"](spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "documents"), "doc_id")
    assert found.where("held_out").selectExpr("avg(int(lang_pred = lang))").first()[0] > 0.95
    got = langid.predict(odd, langid.train(odd)).collect()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (2, 3)} == {2: "und", 3: "und"}
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}


def test_near_dup(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in common.table(spark, sf, "documents").collect()}
    got = {r.doc_id: r.class_id for r in QUERIES["op5_near_dup"](spark, sf).collect()}
    assert set(got) == set(texts)
    shingles = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in texts.items()}
    at: dict = {}
    for i, s in shingles.items():
        for x in s:
            at.setdefault(x, []).append(i)
    above = {i: i for i in texts}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for a, b in {p for v in at.values() for p in itertools.combinations(v, 2)}:
        same = len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
        if texts[a] == texts[b] or (same > 0.05 and near_dup.near(texts[a], texts[b])):
            above[max(top(a), top(b))] = min(top(a), top(b))
        if same >= 0.8:
            assert got[a] == got[b]
    by: dict = {}
    for i, c in got.items():
        by.setdefault(c, []).append(i)
    assert all(len({top(i) for i in v if texts[i].split()}) <= 1 for v in by.values())


def test_near_dup_odd(spark, odd):
    got = {(r.doc_id, r.class_id) for r in near_dup.classes(odd).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (None, None)}
    assert near_dup.stage(spark, odd.limit(0), SF).count() == 0
    kept = near_dup.stage(spark, odd, SF)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 4, 5]


def test_near_dup_repeats(spark):
    """All words count: repeats make texts alike or unlike as any other words do, and no link is lost in a bucket."""
    rng = random.Random(5)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    phrase = "so it is "
    texts = [phrase * 60 + own(rng.choice([20, 36, 45, 60, 90])) for _ in range(60)] + [phrase * n for n in (10, 11, 40, 45)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    above = [*range(len(texts))]
    for a, b in itertools.combinations(above[:], 2):
        if near_dup.near(texts[a], texts[b]) and above[a] != above[b]:
            low, high = sorted((above[a], above[b]))
            above = [low if x == high else x for x in above]
    assert got == dict(enumerate(above))
    assert len({*above}) > 3


def test_near_dup_scattered_edits(spark):
    """Pairs just above the limit are linked wherever their edits stand, in short and long texts."""
    rng = random.Random(8)
    texts = []
    for n in [5, 9, 10, 19, 25, 39, 40, 47, 50, 80, 150, 300, 390, 400, 410, 500, 900] * 4:
        a = [f"w{int(rng.paretovariate(0.4)) % 10**6}" for _ in range(n)]
        b = list(a)
        for i in rng.sample(range(n), n // 5):
            b[i] = f"new{rng.randrange(10**9)}"
        gone = {*rng.sample(range(n), n // 5)}
        c = [x for i, x in enumerate(a) if i not in gone]
        texts += [" ".join(x) for x in (a, b, c)]
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    linked = [(a, b) for a in range(0, len(texts), 3) for b in (a + 1, a + 2) if near_dup.near(texts[a], texts[b])]
    assert len(linked) > 0.9 * len(texts) * 2 / 3
    assert [(a, b) for a, b in linked if got[a] != got[b]] == []


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randint(0, rng.choice([2, 30])) for _ in range(rng.randint(1, 90))]
        b = list(a)
        for _ in range(rng.randint(0, 60)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = [rng.randint(0, 5)] * rng.randint(0, 1)
        row = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        limit = rng.choice([row[-1], max(0, row[-1] - 1), 40, 100])
        assert near_dup.edit_distance(np.array(a), np.array(b, int), limit) == min(row[-1], limit + 1)


def test_segments_are_maximal():
    def plain(x, lo, hi):
        best = max(((sum(x[i:j]), i - j, -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        return [] if best[0] <= 0 else [*plain(x, lo, best[3]), (best[3], best[4]), *plain(x, best[4], hi)]

    rng = random.Random(2)
    for _ in range(300):
        x = [-0.5 if rng.random() < 0.6 else rng.choice([1, -1]) * rng.uniform(0.6, 4) for _ in range(rng.randint(1, 20))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments([(i, s) for i, s in enumerate(x) if s != -0.5], len(x))] == plain(x, 0, len(x))


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.1"
    joined = QUERIES["op6_toxicity"](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in joined.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8 and n.get((0, 1), 0) / n[0, 0] < 0.02
    none = toxicity.train(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.keep_clean(odd, none).count() == len(ODD)


def test_line_dedup(spark, odd):
    rows = [(i, f"menu \nbody {i}\n\nfoot" if i else "menu", "h") for i in range(20)] + [(90, None, "h"), (91, "menu", None), (92, "", "h")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3] == ("body 3\n", 2) and got[0] == ("", 1) and got[90] == (None, 0) and got[91] == ("menu", 0) and got[92] == ("", 0)
    assert line_dedup.drop_lines(odd).count() == len(ODD) and line_dedup.drop_lines(odd.limit(0)).count() == 0


def test_rollups_are_idempotent(spark, tmp_path):
    store = token_counts.RollupStore(spark, str(tmp_path / "store"))
    assert store.totals().count() == 0
    change = spark.createDataFrame([("insert", "a", "en", "v", 5), ("insert", "a", "en", "v", None), ("insert", None, "en", "v", 2)], "op string, source string, lang string, version string, tokens long")
    assert store.commit("1", change) and not store.commit("1", change)
    store.commit("2", spark.createDataFrame([("revise", "a", "en", "w", 7, "a", "en", "v", 5)], "op string, source string, lang string, version string, tokens long, old_source string, old_lang string, old_version string, old_tokens long"))
    store.commit("3", spark.createDataFrame([("delete", None, "en", "v", 2)], change.schema))
    assert sorted(map(tuple, store.totals().collect())) == [("a", "en", "v", 1, 0), ("a", "en", "w", 1, 7)]


def test_bpe(spark, docs, odd):
    path = public_tokenizers.path(bpe.VOCABULARY)
    codec = bpe.Codec(path, remember=500)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for t in [*docs.values(), *(x[1] or "" for x in ODD), "don't  a \n\n b's", "   ", " \x1c a", "a" * 300, "　x  \n y"]:
        assert codec.encode(t)[0].tolist() == own.encode_ordinary(t)
    keys = [*codec.ranks][:2000]
    whole = bpe.PerfectHash(keys)
    assert [whole.index(k) for k in keys] == [*range(2000)] and whole.index(b"\xff\xfe nothing") == -1
    back = bpe.decode_documents(bpe.encode_documents(odd, path, keep_ids=True), path).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, *_ in ODD)


def test_packing(spark, odd):
    path = public_tokenizers.path(packing.TOKENIZER)
    tok = Tokenizer.from_file(path)
    for rows in (odd, common.table(spark, SF, "documents")):
        texts = [(r.doc_id, r.text or "") for r in rows.collect()]
        left = {}
        for i, t in texts:
            left.setdefault(i, []).append(np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4"))
        pieces = packing.pack(rows.coalesce(1), path, with_ids=True).orderBy("sequence_id", "offset").collect()
        sizes: dict = {}
        for p in pieces:
            assert p.offset == sizes.get(p.sequence_id, 0) and 0 < p.length <= 4096
            sizes[p.sequence_id] = p.offset + p.length
            assert any(len(x) == p.doc_tokens and (x[p.start : p.start + p.length] == p.ids).all() and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in left[p.doc_id])
        total = sum(len(x) for v in left.values() for x in v)
        assert sum(sizes.values()) == total and max(sizes.values()) <= 4096
        assert sum(4096 - n for n in sizes.values() if n & (n - 1)) < 0.03 * total


def test_packing_ids():
    """Ids are those of the plain library: special tokens, combining marks, odd white space and letters whose small forms differ."""
    path = public_tokenizers.path(packing.TOKENIZER)
    tok, own = Tokenizer.from_file(path), packing.Tokens(path, remember=300)
    parts = ["a <|endoftext|> b", "<|STARTOFTEXT|>", "J\u030c H\u0331 T\u0308 \u03aa\u0301", "\u0130. \u01c5, \ufb01.", "\u03a3\u03a3 \u03a3.", "\u0958.", "\u00b2, x\u00b2.", "\u1e9e", "don't DON'T.", "e\u0301. E\u0301,", "\u3000a\u00a0b\x85c", "\u0345\u0301 \u0301x", "\x01", "a\x1fb", "\U0001f600.", "\u212a.", "A.B,C."]
    rng = random.Random(9)
    letters = "aAzZ\u00e9\u00c9\u0301\u0308\u030c\u0331JHT\u03a3\u03c3\u0130I.,' \n\u00df\u1e9e\u0958\u093c\uac00\u11a8\u1100\u11611"
    texts = [*parts, *(" ".join(rng.sample(parts, 4)) for _ in range(200)), *("".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000))]
    for i in range(0, len(texts), 100):
        for t, ids in zip(texts[i : i + 100], own.ids(texts[i : i + 100])):
            assert ids.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], t


def test_cuts_are_cheapest():
    rng = random.Random(5)
    for _ in range(200):
        at = np.cumsum([rng.randint(1, 9) for _ in range(rng.randint(1, 14))])
        price = np.array([rng.choice([0, 1, 3]) for _ in at], float)
        cost = lambda cuts: sum(10 - (b - a) for a, b in zip([0, *cuts], cuts[:-1])) + sum(price[list(at).index(c)] for c in cuts[:-1])  # noqa: E731, B023
        every = [[*c, at[-1]] for k in range(len(at)) for c in itertools.combinations(at[:-1], k)]
        ok = [c for c in every if all(b - a <= 10 for a, b in zip([0, *c], c))]
        assert cost(packing.choose_cuts(at, price, 10)) == min(map(cost, ok))


def test_pipeline(spark):
    """run() equals a plain version of its decisions: what is packed is what the stages before keep."""
    docs = common.table(spark, SF, "documents")
    for _, f in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.materialise(f(spark, docs, SF), "test")
        assert docs.columns == [*common.DOCUMENT_COLUMNS] and docs.count() <= before.count()
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = {r.doc_id: r.n for r in corpus_pipeline.run(spark, SF).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert got == want
    assert docs.count() > 100
